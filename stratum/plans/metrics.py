"""Business metrics (inventory N). Every metric takes frames by name and returns a DataFrame.

Frames have business names: po_items (po_number, po_item, material_id, vendor_id, ordered_quantity,
unit_price, net_value), po_headers (po_number, po_date), po_schedules (po_number, po_item where it
is not the same for all of an order's items, scheduled_date), receipts (document_id, po_number, po_item, movement_type, quantity, posting_date),
requisitions (po_number, requisition_date), movements (document_id, material_id, plant, movement_type,
quantity, posting_date), stock (material_id, plant, location, unrestricted, inspection, blocked),
invoices (invoice_id, po_number, vendor_id, amount, quantity, invoice_date), vendors, materials,
customers, devices (device_id, material_id), device_events (device_id, status, status_date), and for the shop orders (order_id,
customer_id, person_id, status, purchased_at, delivered_at, estimated_at), order_items (order_id,
item_id, product_id, seller_id, price, freight), products, sellers.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.functions.scalars import age_days, band, date_parts, days_between, decode, decode_groups, decode_like, hash_key, health, is_present, month_diff, pct, period, ratio, signed_qty, within_days, within_pct
from stratum.operators.scan import carried_last
from stratum.operators.relational import calendar, cross_one_row, grand_total, running_sum, share_of_total
from stratum.sources.scratch import written

Frames = Mapping[str, DataFrame]
# Movement codes of receipt and reversal, of issues and returns, and decoded states.
RECEIPT, REVERSAL = "101", "102"
VENDOR_RETURN, ISSUE = "122", "201"
INBOUND, OUTBOUND = ("101", "161", "202", "561"), ("102", "122", "201")
DEVICE_STATES = EQUIPMENT_STATES = {"INST": "deployed", "AVLB": "in_stock", "RET": "returned", "DLFL": "defective"}
PROCESS_STEPS = {"101": "goods_receipt", "102": "gr_reversal", "122": "vendor_return", "161": "customer_return", "201": "installation", "202": "gi_reversal", "301": "stock_transfer", "561": "initial_load"}
SERVICE_PLANS = {"SVC-FIB": "fiber", "SVC-TV": "TV", "SVC-CBL": "cable", "SVC-BIZ": "business"}
PLAN_CATEGORIES = {"SVC-FIB": "Fiber Broadband", "SVC-TV": "IPTV Bundle", "SVC-CBL": "Cable Broadband", "SVC-BIZ": "Business Connectivity"}
LOCATION_TYPES = [(["%Main%", "%Central%"], "primary"), (["%Defective%", "%Return%"], "returns"), (["%Ready%", "%Deploy%"], "staging"), (["%Regional%"], "regional")]
EQUIPMENT_CATEGORIES = {"CPE-RTR": "Router", "CPE-ONT": "ONT", "CPE-STB": "Set-Top Box", "CPE-SWT": "Switch", "CPE-MDM": "Modem"}


def money(c: str | Column) -> Column:
    """Sum as an exact decimal, given as double."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")


def dim_date(spark: SparkSession, start: str = "2016-01-01", end: str = "2027-12-31") -> DataFrame:
    """The calendar."""
    return calendar(spark, start, end).select("date_day", *date_parts("date_day"))


def dim_customer(frames: Frames, segments: Mapping[str, str], default: str = "other") -> DataFrame:
    """Current customers with their segment."""
    return frames["customers"].withColumn("segment", decode("account_group", segments, default))


def dim_vendor(frames: Frames, regions: Mapping[str, list], default: str = "other") -> DataFrame:
    """Current vendors with their region."""
    return frames["vendors"].withColumn("vendor_region", decode_groups("country_code", regions, default))


def dim_material(frames: Frames, groups: Mapping[str, str], default: str = "other") -> DataFrame:
    """Materials with a readable group."""
    return frames["materials"].withColumn("material_group_name", decode("material_group", groups, default))


def dim_movement_type(frames: Frames) -> DataFrame:
    """Direction, process step and stock effect of each movement code, by its category and debit/credit indicator."""
    out, category, side = frames["movement_types"], F.col("movement_category"), F.col("debit_credit_indicator")
    by = lambda x, s, h, other: F.when(category == "X", x).when(side == "S", s).when(side == "H", h).otherwise(other)
    return out.withColumn("direction", by("transfer", "inbound", "outbound", "unknown")).withColumn("process_step", decode("movement_type", PROCESS_STEPS, "other")).withColumn("stock_impact_sign", by(0, 1, -1, 0)).withColumn("stock_impact_description", by("neutral", "increase", "decrease", "neutral"))


def dim_plant(frames: Frames) -> DataFrame:
    """Plants with their company, as far as the organisation tables know them."""
    out = frames["plants"].join(frames["companies"], "company_code", "left")
    return out.select(hash_key("plant_code").alias("hk_plant"), "plant_code", "plant_name", "company_code", "company_name")


def dim_service_plan(frames: Frames) -> DataFrame:
    """Service plans with the category of their group."""
    return frames["service_plans"].select(hash_key("service_plan_id").alias("hk_service_plan"), "service_plan_id", "service_plan_group", decode("service_plan_group", PLAN_CATEGORIES, "Other").alias("plan_category"))


def dim_storage_location(frames: Frames) -> DataFrame:
    """Storage locations with their plant's name and a type by their own name."""
    out = frames["storage_locations"].join(frames["plants"].select("plant_code", "plant_name"), "plant_code", "left")
    return out.select(hash_key("plant_code", "storage_location_code").alias("hk_storage_location"), "plant_code", "storage_location_code", "storage_location_name", "plant_name", decode_like("storage_location_name", LOCATION_TYPES, "other").alias("location_type"))


def dim_equipment(frames: Frames, as_of: str) -> DataFrame:
    """Devices with their newest state, its age, and the days since their receipt and deployment."""
    newest = Window.partitionBy("device_id").orderBy(F.desc("status_date"), F.desc("status"))
    now = frames["device_events"].withColumn("_r", F.row_number().over(newest)).filter("_r = 1")
    now = now.select("device_id", decode("status", DEVICE_STATES, "unknown").alias("lifecycle_status"), "status_date", age_days("status_date", as_of).alias("days_in_status"))
    ages = {"days_since_receipt": age_days("received_on", as_of), "days_since_deployment": age_days("started_on", as_of)}
    return now.join(frames["equipment"], "device_id", "left").withColumns(ages).drop("received_on", "started_on", "manufacturer")


def _po_facts(frames: Frames) -> DataFrame:
    """PO items with what is stored about them and their order, before anything is worked out.

    Items and receipts meet in one window by order, in which the rows of one item stand together, and the other
    frames are joined by order, so that every row travels once. An item's receipts are summed, and the first one is the order's.
    """
    moved = lambda code, other: F.when(F.col("movement_type") == code, F.col("quantity")).when(F.col("movement_type") == other, F.lit(0.0))
    r = frames["receipts"].filter(is_present("po_number")).select("po_number", "po_item", moved(RECEIPT, REVERSAL).alias("received_quantity"), moved(REVERSAL, RECEIPT).alias("reversed_quantity"), F.col("posting_date").alias("first_gr_date"))
    rows = frames["po_items"].withColumn("_is_item", F.lit(True)).unionByName(r.repartition("po_number"), allowMissingColumns=True)
    by = Window.partitionBy("po_number").orderBy("po_item")
    order, item = by.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing), by.rangeBetween(Window.currentRow, Window.currentRow)
    got = lambda c: F.when(F.col("po_item").isNotNull(), F.sum(c).over(item))
    out = rows.withColumns({"first_gr_date": F.min("first_gr_date").over(order), "received_quantity": got("received_quantity"), "reversed_quantity": got("reversed_quantity")}).filter("_is_item").drop("_is_item")
    out, due = out.join(frames["po_headers"], "po_number", "left"), frames["po_schedules"]
    if "po_item" in due.columns:
        out = out.join(due, ["po_number", "po_item"], "left")
    else:
        out = out.join(due.withColumnRenamed("po_number", "_order"), (F.col("po_number") == F.col("_order")) & F.col("po_item").isNotNull(), "left").drop("_order")
    return out.join(frames["requisitions"], "po_number", "left")


def purchase_orders(frames: Frames, tolerance_days: int = 2) -> DataFrame:
    """PO items with lead time, punctuality, cycle time, delivery status and received quantity and value.

    The first receipt is per order, not per item; movement quantities are per item.
    """
    return _po_measures(_po_facts(frames), tolerance_days)


def _po_measures(out: DataFrame, tolerance_days: int = 2) -> DataFrame:
    """What N10 works out from :func:`_po_facts`."""
    gr, there = F.col("first_gr_date"), F.coalesce("received_quantity", F.lit(0.0))
    status = F.when(gr.isNull(), "pending").when(F.col("received_quantity") >= F.col("ordered_quantity"), "fully_received").when(F.col("received_quantity") > 0, "partially_received").otherwise("pending")
    return (
        out.withColumn("lead_time_days", days_between("po_date", gr))
        .withColumn("is_on_time", within_days(gr, "scheduled_date", tolerance_days))
        .withColumn("po_cycle_days", days_between("requisition_date", "po_date"))
        .withColumn("delivery_status", status)
        .withColumn("received_quantity", there)
        .withColumn("reversed_quantity", F.coalesce("reversed_quantity", F.lit(0.0)))
        .withColumn("received_value", there * F.col("unit_price"))
    )


def goods_movements(frames: Frames) -> DataFrame:
    """Movements with direction and signed quantity."""
    m = frames["movements"]
    return m.withColumn("direction", decode_groups("movement_type", {"inbound": INBOUND, "outbound": OUTBOUND}, "internal")).withColumn("signed_quantity", signed_qty("quantity", "movement_type", INBOUND, OUTBOUND))


def receipt_accuracy(frames: Frames) -> DataFrame:
    """Per vendor and quarter, receipt lines whose quantity is the ordered one."""
    ordered = frames["po_items"].filter("ordered_quantity is not null").select("po_number", "po_item", "material_id", "ordered_quantity")
    r = frames["receipts"].filter((F.col("movement_type") == RECEIPT) & F.col("vendor_id").isNotNull() & F.col("quantity").isNotNull()).join(ordered, ["po_number", "po_item", "material_id"])
    out = r.groupBy("vendor_id", period("posting_date", "quarter").alias("quarter")).agg(F.count("*").alias("total_receipts"), F.count_if(F.col("quantity") == F.col("ordered_quantity")).alias("accurate_receipts"), F.min("posting_date").alias("first_receipt_date"), F.max("posting_date").alias("last_receipt_date"))
    return out.withColumn("accuracy_percentage", pct("accurate_receipts", "total_receipts"))


def receipts_monthly(frames: Frames) -> DataFrame:
    """Receipt documents, lines and quantity per month."""
    r = frames["receipts"].filter(F.col("movement_type") == RECEIPT)
    return r.groupBy(period("posting_date", "month").alias("month")).agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("lines"), F.sum("quantity").alias("quantity"))


def inventory(frames: Frames) -> DataFrame:
    """Stock with flags."""
    s = frames["stock"].withColumn("total_stock", F.col("unrestricted") + F.col("inspection") + F.col("blocked"))
    return s.withColumn("is_zero_stock", F.col("total_stock") == 0).withColumn("has_blocked_stock", F.col("blocked") > 0)


def invoices(frames: Frames) -> DataFrame:
    """Invoices with days from the order."""
    return frames["invoices"].join(frames["po_headers"], "po_number", "left").withColumn("days_po_to_invoice", days_between("po_date", "invoice_date"))


def three_way_match(frames: Frames, tolerance: float = 0.05) -> DataFrame:
    """Per vendor and month of the order, the share of order lines whose ordered, received and invoiced quantities agree, and approvals of exceptions.

    Each side is summed per line before the join. Received is held against ordered, invoiced against received;
    a line without either is unmatched.
    """
    keys = ["po_number", "po_item"]
    po = frames["po_items"].filter("ordered_quantity > 0").join(frames["po_headers"], "po_number")
    got = frames["receipts"].filter((F.col("movement_type") == RECEIPT) & (F.col("quantity") > 0) & is_present("po_number")).groupBy(*keys).agg(F.sum("quantity").alias("received"))
    billed = frames["invoice_items"].filter("invoice_quantity > 0").groupBy(*keys).agg(F.sum("invoice_quantity").alias("invoiced"))
    said = frames["approvals"].groupBy(*keys).agg(F.count("*").alias("exceptions"), F.count_if(F.col("approval_status") == "02").alias("approved"))
    out = po.join(got, keys, "left").join(billed, keys, "left").join(said, keys, "left")
    matched = within_pct("ordered_quantity", "received", tolerance) & (F.col("received") > 0) & within_pct("received", F.coalesce("invoiced", F.lit(0.0)), tolerance)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = out.groupBy("vendor_id", period("po_date", "month").alias("month")).agg(F.count("*").alias("total_po_lines"), F.count_if(matched).alias("_matched"), total("exceptions").alias("exception_count"), total("approved").alias("approved_exception_count"))
    return out.withColumn("matched_pct", pct("_matched", "total_po_lines")).withColumn("open_exception_count", F.col("exception_count") - F.col("approved_exception_count")).drop("_matched")


def equipment_lifecycle(frames: Frames, as_of: str) -> DataFrame:
    """Device states in order, with the days spent in them (for the open one, until ``as_of``) and, for deployments, the days since receipt."""
    e = _states(frames).join(frames["equipment"].select("device_id", "received_on"), "device_id", "left")
    until = F.coalesce("next_date", F.lit(as_of).cast("date"))
    return e.withColumn("days_in_status", days_between("status_date", until)).withColumn("days_receipt_to_deployment", F.when(F.col("status") == "INST", days_between("received_on", "status_date"))).drop("received_on")


def _states(frames: Frames) -> DataFrame:
    """Device states in order, and whether they are the newest."""
    up = Window.partitionBy("device_id").orderBy("status_date", "status")
    down = Window.partitionBy("device_id").orderBy(F.desc("status_date"), F.desc("status"))
    e = frames["device_events"].withColumn("next_date", F.lead("status_date").over(up)).withColumn("sequence_no", F.row_number().over(up)).withColumn("is_current", F.row_number().over(down) == 1)
    return e.withColumn("lifecycle_status", decode("status", DEVICE_STATES, "unknown"))


def contribution_margin(frames: Frames, months: int = 24) -> DataFrame:
    """Revenue less cost per service plan, tenure band and month of billing.

    Tenure counts from the customer's first billing. Cost is charged in the billing months from the deployment's date on (from
    the first billing where it is unknown), for so many months.
    """
    b = frames["billing"]
    b = b.join(b.groupBy("customer_id").agg(F.min("bill_month").alias("_first")), "customer_id", "left")
    start = F.coalesce("deployed_on", "_first")
    window = (F.col("bill_month") >= start) & (F.col("bill_month") < F.add_months(start, months))
    b = b.withColumn("_cost", F.when(window, F.col("cost")).otherwise(0))
    tenure = band(month_diff("_first", "bill_month"), (12, 24, 48), ("0-12", "12-24", "24-48", "48+"), "unknown")
    out = b.groupBy(decode("service_plan_group", SERVICE_PLANS, "unknown").alias("service_plan"), tenure.alias("tenure_band"), F.col("bill_month").alias("billing_month")).agg(money("revenue").alias("revenue"), money("_cost").alias("cost"), F.countDistinct("customer_id").alias("customers"), F.countDistinct("billing_doc").alias("billing_docs"))
    return out.withColumn("margin", F.round(F.col("revenue") - F.col("cost"), 2))


def wide_margin(frames: Frames) -> DataFrame:
    """Margin rate (null unless there is revenue), margin per customer, whether there is one, and date parts."""
    out = contribution_margin(frames).withColumn("margin_pct", F.when(F.col("revenue") > 0, pct("margin", "revenue"))).withColumn("margin_per_customer", ratio("margin", "customers"))
    return out.withColumns({"is_margin_positive": F.col("margin") >= 0, "billing_year": F.year("billing_month"), "billing_month_num": F.month("billing_month")})


def _year_quarter(c: str) -> Column:
    return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))


def vendor_scorecard(frames: Frames, flag_above: float = 0.60) -> DataFrame:
    """Vendor by quarter: spend, share of the quarter, concentration flag, lead time, punctuality, fulfilment.

    Items of unknown punctuality count as late here (N35 leaves them out).
    """
    po = purchase_orders(frames).filter("po_date is not null")
    out = po.groupBy("vendor_id", _year_quarter("po_date").alias("year_quarter")).agg(
        F.count("*").alias("total_po_items"), money("net_value").alias("total_spend"), F.round(F.avg(F.col("lead_time_days").cast("double")), 6).alias("avg_lead_time_days"), F.round(F.avg(F.when(F.col("is_on_time"), 1.0).otherwise(0.0)), 6).alias("on_time_rate"), F.sum("ordered_quantity").alias("ordered"), F.sum("received_quantity").alias("received")
    )
    return _with_shares(out, flag_above).withColumn("fulfillment_rate", F.round(F.coalesce(ratio("received", "ordered"), F.lit(0.0)), 4))


def _with_shares(out: DataFrame, flag_above: float = 0.60) -> DataFrame:
    """Vendors by quarter with the share of ``total_spend`` in the quarter, and whether it is a risk."""
    whole = out.groupBy("year_quarter").agg(F.sum(F.col("total_spend").cast("decimal(18,2)")).cast("double").alias("_quarter"))
    share = F.coalesce(ratio("total_spend", "_quarter"), F.lit(0.0))
    return out.join(whole, "year_quarter").withColumn("spend_share", F.round(share, 4)).withColumn("concentration_risk", share > flag_above).drop("_quarter")


def wide_scorecard(frames: Frames, regions: Mapping[str, list[str]]) -> DataFrame:
    """The scorecard with the vendor's name, region and payment terms."""
    vendors = dim_vendor(frames, regions).select("vendor_id", "vendor_name", "vendor_region").join(frames["vendor_terms"], "vendor_id", "left")
    return vendor_scorecard(frames).join(vendors, "vendor_id")


def procurement_health(frames: Frames) -> DataFrame:
    """One row of KPIs of orders, the most concentrated vendor and stock, with their states.

    Order items are read once, into sums of vendors by quarter, of which both the totals and the shares are made.
    """
    nth = F.row_number().over(Window.partitionBy("po_number").orderBy("po_number"))  # an order counts with one of its items
    po = purchase_orders(frames).withColumns({"_new": (nth == 1) & F.col("po_number").isNotNull(), "lead_time_days": F.col("lead_time_days").cast("double"), "po_cycle_days": F.col("po_cycle_days").cast("double")})
    counts = {"total_pos": F.col("_new"), "pending_deliveries": F.col("delivery_status") == "pending", "partial_deliveries": F.col("delivery_status") == "partially_received", "_on_time": F.col("is_on_time")}
    means = {"avg_lead_time_days": "lead_time_days", "avg_po_cycle_days": "po_cycle_days"}
    sums = [F.count("*").alias("total_po_items"), F.sum(F.col("net_value").cast("decimal(18,2)")).alias("_spend"), *(F.count_if(c).alias(n) for n, c in counts.items()), *(f(c).alias(k + c) for c in means.values() for k, f in (("_n_", F.count), ("_sum_", F.sum)))]
    by = written(po.groupBy("vendor_id", _year_quarter("po_date").alias("year_quarter")).agg(*sums), "vendor-quarters")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    a = by.agg(total("total_pos"), total("total_po_items"), *(F.round(ratio(F.sum(f"_sum_{c}"), F.sum(f"_n_{c}")), 1).alias(n) for n, c in means.items()), F.round(ratio(F.sum("_on_time"), F.sum("total_po_items")) * 100, 1).alias("otd_rate_pct"), F.sum("_spend").cast("double").alias("total_spend"), total("pending_deliveries"), total("partial_deliveries"))
    card = _with_shares(by.filter("year_quarter is not null").select("vendor_id", "year_quarter", F.col("_spend").cast("double").alias("total_spend")))
    card = card.groupBy("vendor_id").agg(F.round(F.max("spend_share") * 100, 1).alias("highest_concentration_pct"), F.bool_or("concentration_risk").alias("has_concentration_risk"))
    named = card.join(frames["vendors"].select("vendor_id", F.col("vendor_name").alias("highest_concentration_vendor")), "vendor_id")
    top = named.drop("vendor_id").orderBy(F.desc("highest_concentration_pct"), "highest_concentration_vendor").limit(1)
    b = inventory(frames).agg(F.count_if("is_zero_stock").alias("zero_stock_locations"), F.count_if("has_blocked_stock").alias("blocked_stock_locations"), F.round(F.sum("total_stock"), 0).alias("total_stock_units"))
    concentration = F.when(F.col("has_concentration_risk"), "RED").when(F.col("highest_concentration_pct") > 50, "YELLOW").otherwise("GREEN")
    states = {"otd_health": health("otd_rate_pct", 80, 60), "lead_time_health": health("avg_lead_time_days", 35, 50, False), "cycle_time_health": health("avg_po_cycle_days", 5, 10, False), "concentration_health": concentration, "inventory_health": health("zero_stock_locations", 0, 5, False)}
    return cross_one_row(a, top, b).withColumns(states)


def vendor_performance(frames: Frames) -> DataFrame:
    """Orders, spend, lead time, punctuality, fulfilment, grade and health of every vendor, those without orders too."""
    out = frames["vendors"].join(purchase_orders(frames), "vendor_id", "left")
    on_time = F.avg(F.when(F.col("is_on_time"), 1.0).otherwise(0.0))
    out = out.groupBy("vendor_id", "vendor_name", "country_code").agg(F.countDistinct("po_number").alias("total_pos"), money("net_value").alias("total_spend"), F.round(F.avg(F.col("lead_time_days").cast("double")), 1).alias("avg_lead_time_days"), on_time.alias("_rate"), F.sum("ordered_quantity").alias("total_ordered_qty"), F.sum("received_quantity").alias("total_received_qty"))
    grade = F.when(F.col("_rate") >= 0.80, "A").when(F.col("_rate") >= 0.60, "B").when(F.col("_rate") >= 0.40, "C").otherwise("D")
    return out.withColumns({"otd_rate_pct": F.round(F.col("_rate") * 100, 1), "fulfillment_rate_pct": F.round(ratio("total_received_qty", "total_ordered_qty") * 100, 1), "performance_grade": grade, "health_status": health("_rate", 0.80, 0.60)}).drop("_rate")


def lifecycle_metrics(frames: Frames) -> DataFrame:
    """Devices by state with rates of deployment and return, in one row; :func:`lifecycle_by_group` is N27."""
    now = _states(frames).filter("is_current")
    out = now.agg(F.count("*").alias("devices"), F.count_if(F.col("lifecycle_status") == "deployed").alias("deployed"), F.count_if(F.col("lifecycle_status") == "returned").alias("returned"))
    return out.withColumn("deployment_rate", pct("deployed", "devices")).withColumn("return_rate", pct("returned", "devices")).withColumn("return_state", health("return_rate", 5, 10, False))


def lifecycle_by_group(frames: Frames, states: Mapping[str, str] = EQUIPMENT_STATES, categories: Mapping[str, str] = EQUIPMENT_CATEGORIES) -> DataFrame:
    """Per material group, devices by newest state with rates and their health; devices without events count too."""
    newest = Window.partitionBy("device_id").orderBy(F.desc("status_date"), F.desc("status"))
    now = frames["device_events"].withColumn("_r", F.row_number().over(newest)).filter("_r = 1").select("device_id", decode("status", states, "unknown").alias("_state"))
    devices = frames["devices"].select("device_id", "material_id").join(now, "device_id", "left")
    counts = [F.count_if(F.col("_state") == s).alias(s) for s in ("deployed", "in_stock", "returned", "defective")]
    out = devices.join(frames["materials"].select("material_id", "material_group"), "material_id", "left").groupBy("material_group").agg(F.count("*").alias("total_devices"), *counts)
    share = lambda c: F.lit(100.0) * F.col(c) / F.col("total_devices")
    return (
        out.withColumn("equipment_category", decode("material_group", categories, "Other"))
        .withColumn("deployment_rate_pct", pct("deployed", "total_devices", 1))
        .withColumn("defect_rate_pct", pct("defective", "total_devices"))
        .withColumn("return_rate_pct", pct("returned", "total_devices"))
        .withColumn("defect_health", health(share("defective"), 3, 5, False))
        .withColumn("return_health", health(share("returned"), 5, 10, False))
    )


def inventory_alerts(frames: Frames, excess: float = 5000) -> DataFrame:
    """Locations without free stock, with blocked stock or with too much, with alert and colour."""
    free, blocked = F.col("unrestricted"), F.col("blocked")
    s = inventory(frames).filter((free == 0) | (blocked > 0) | (free > excess))
    by = lambda zero, held, much, other: F.when((free == 0) & (F.col("total_stock") == 0), zero).when(blocked > 0, held).when(free > excess, much).otherwise(other)
    return s.select("material_id", "plant", "location", "unrestricted", "blocked", "total_stock", by("ZERO_STOCK", "BLOCKED_STOCK", "EXCESS_STOCK", "OK").alias("alert_type"), by("RED", "YELLOW", "YELLOW", "GREEN").alias("health_status"))


def active_devices(frames: Frames) -> DataFrame:
    """Devices whose newest state is deployed."""
    return _states(frames).filter("is_current and lifecycle_status = 'deployed'").agg(F.countDistinct("device_id").alias("active_devices"))


def days_of_stock(frames: Frames, as_of: str, days: int = 30) -> DataFrame:
    """Current stock over the mean daily issues of the trailing days, per material."""
    end = F.lit(as_of).cast("date")
    out = goods_movements(frames).filter((F.col("direction") == "outbound") & (F.col("posting_date") > F.date_sub(end, days)) & (F.col("posting_date") <= end)).groupBy("material_id").agg(F.sum("quantity").alias("issued"))
    stock = frames["stock"].groupBy("material_id").agg(F.sum("unrestricted").alias("stock"))
    return stock.join(out, "material_id", "left").withColumn("days_of_stock", F.round(ratio("stock", F.col("issued") / days), 2))


def inventory_turnover(frames: Frames) -> DataFrame:
    """Goods issues (code 201) over mean month-end stock, per material group and quarter."""
    m = goods_movements(frames).join(frames["materials"].select("material_id", "material_group"), "material_id")
    monthly = m.groupBy("material_group", period("posting_date", "month").alias("month")).agg(F.sum("signed_quantity").alias("net"), F.sum(F.when(F.col("movement_type") == ISSUE, F.col("quantity")).otherwise(0.0)).alias("issued"))
    monthly = running_sum(monthly, ["month"], "net", ["material_group"], "level")
    out = monthly.groupBy("material_group", period("month", "quarter").alias("quarter")).agg(F.sum("issued").alias("issued"), F.avg("level").alias("avg_stock"))
    return out.withColumn("turnover", F.round(ratio("issued", "avg_stock"), 4)).withColumn("avg_stock", F.round("avg_stock", 4))


def return_ratio(frames: Frames) -> DataFrame:
    """Returned over deployed devices per category."""
    e = frames["device_events"]
    out = e.groupBy("category").agg(F.count_if(F.col("status") == "INST").alias("deployed"), F.count_if(F.col("status") == "RET").alias("returned"))
    return out.withColumn("return_ratio_pct", pct("returned", "deployed"))


def returns_within_days(frames: Frames, days: int = 90) -> DataFrame:
    """Receipts followed by a return of the same material to the vendor (code 122) within the days, per material, vendor and quarter.

    Both kinds stand in one order from the latest on, and each receipt meets the return that came last, the next one at or
    after it: no pairs of receipts and returns are made, and a material of one vendor may hold any share of the rows.
    """
    pair = ["material_id", "vendor_id"]
    r = frames["receipts"].filter(F.col("movement_type") == RECEIPT).select(*pair, "document_id", F.col("posting_date").alias("on"), F.lit(None).cast("date").alias("back"))
    back = frames["movements"].filter(F.col("movement_type") == VENDOR_RETURN).select(*pair, F.lit(None).cast(r.schema["document_id"].dataType).alias("document_id"), F.col("posting_date").alias("on"), F.col("posting_date").cast("date").alias("back")).distinct()
    # Missing materials or vendors match nothing.
    both = carried_last(r.unionByName(back), [F.desc("on"), F.col("back").asc_nulls_last()], "back", pair, "_next").filter("back is null")
    hit = (F.col("_next") <= F.date_add("on", days)) & F.col("material_id").isNotNull() & F.col("vendor_id").isNotNull()
    # A document counts as returned wherever it stands if one of its receipts is.
    docs = both.filter(hit).select("document_id").distinct().withColumn("_hit", F.lit(1))
    out = both.join(docs, "document_id", "left").groupBy(*pair, period("on", "quarter").alias("quarter")).agg(F.countDistinct("document_id").alias("receipts"), F.countDistinct(F.when(F.col("_hit") == 1, F.col("document_id"))).alias("returned"))
    return out.withColumn("return_rate_pct", pct("returned", "receipts"))


def po_volume(frames: Frames) -> DataFrame:
    """Orders, items and value per month."""
    po = frames["po_items"].join(frames["po_headers"], "po_number")
    return po.groupBy(period("po_date", "month").alias("month")).agg(F.countDistinct("po_number").alias("orders"), F.count("*").alias("items"), money("net_value").alias("value"))


def vendor_lead_otd(frames: Frames) -> DataFrame:
    """Lead time and punctuality per vendor; items of unknown punctuality are left out."""
    po = purchase_orders(frames)
    return po.groupBy("vendor_id").agg(F.round(F.avg(F.col("lead_time_days").cast("double")), 6).alias("avg_lead_time"), F.round(100 * F.avg(F.col("is_on_time").cast("int").cast("double")), 6).alias("on_time_pct"))


def delivery_status_dist(frames: Frames) -> DataFrame:
    """Items by delivery status."""
    return purchase_orders(frames).groupBy("delivery_status").agg(F.count("*").alias("n"))


def vendor_summary(frames: Frames) -> DataFrame:
    """Spend, mean quarterly lead time and rate, and mean share of every vendor."""
    return vendor_scorecard(frames).groupBy("vendor_id").agg(money("total_spend").alias("spend"), F.round(F.avg("avg_lead_time_days"), 6).alias("mean_lead_time"), F.round(F.avg("on_time_rate"), 4).alias("mean_on_time"), F.sum("total_po_items").alias("po_items"), F.round(F.avg("spend_share"), 4).alias("mean_share"))


def concentration_by_quarter(frames: Frames, least: float = 0.01) -> DataFrame:
    """Vendors above the share per quarter, and how many are flagged."""
    return vendor_scorecard(frames).groupBy("year_quarter").agg(F.count_if(F.col("spend_share") > least).alias("vendors"), F.count_if("concentration_risk").alias("flagged"), F.max("spend_share").alias("top_share"))


def otd_matrix(frames: Frames, quarters: list[str]) -> DataFrame:
    """On-time rate, vendor by quarter."""
    return vendor_scorecard(frames).groupBy("vendor_id").pivot("year_quarter", quarters).agg(F.first("on_time_rate"))


def inventory_kpis(frames: Frames, by: str = "plant") -> DataFrame:
    """Stock by plant, category or location type."""
    return inventory(frames).groupBy(by).agg(F.sum("total_stock").alias("total_stock"), F.sum("blocked").alias("blocked"), F.count_if("is_zero_stock").alias("zero_locations"))


def stock_flow(frames: Frames) -> DataFrame:
    """Net units per month and their running sum."""
    monthly = goods_movements(frames).groupBy(period("posting_date", "month").alias("month")).agg(F.sum("signed_quantity").alias("net"))
    return running_sum(monthly, ["month"], "net", name="cumulative")


def movement_kpis(frames: Frames) -> DataFrame:
    """Lines and quantity per month and direction."""
    return goods_movements(frames).groupBy(period("posting_date", "month").alias("month"), "direction").agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity"))


def movements_by_category(frames: Frames) -> DataFrame:
    """Lines and quantity per material group and direction."""
    m = goods_movements(frames).join(frames["materials"], "material_id", "left")
    return m.groupBy("material_group", "direction").agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity"))


def recent_movements(frames: Frames, n: int = 50) -> DataFrame:
    """The newest movements."""
    m = goods_movements(frames).select("posting_date", "document_id", "movement_type", "direction", "material_id", "quantity", "plant")
    m = m.orderBy(F.desc("posting_date"), "document_id").limit(n)
    return m.join(frames["materials"], "material_id", "left")


def lifecycle_activity(frames: Frames, start: str, end: str) -> DataFrame:
    """In a window, devices received (first state), deployed, returned and defective, and the net change of stock: received less deployed and defective."""
    e = _states(frames).filter((F.col("status_date") >= F.lit(start).cast("date")) & (F.col("status_date") <= F.lit(end).cast("date")))
    out = e.agg(F.count_if(F.col("sequence_no") == 1).alias("received"), F.count_if(F.col("lifecycle_status") == "deployed").alias("deployed"), F.count_if(F.col("lifecycle_status") == "returned").alias("returned"), F.count_if(F.col("lifecycle_status") == "defective").alias("defective"))
    return out.withColumn("net_change", F.col("received") - F.col("deployed") - F.col("defective"))


def lifecycle_trends(frames: Frames) -> DataFrame:
    """Per month, states entered and the share of returns."""
    e = _states(frames).groupBy(period("status_date", "month").alias("month")).agg(F.count("*").alias("events"), F.count_if(F.col("lifecycle_status") == "deployed").alias("deployed"), F.count_if(F.col("lifecycle_status") == "returned").alias("returned"))
    return e.withColumn("return_share_pct", pct("returned", "events"))


def status_by_category(frames: Frames) -> DataFrame:
    """Newest states by category."""
    return _now(frames).groupBy("category", "lifecycle_status").agg(F.count("*").alias("devices"))


def _now(frames: Frames) -> DataFrame:
    w = Window.partitionBy("device_id").orderBy(F.desc("status_date"), F.desc("status"))
    now = frames["device_events"].withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return now.withColumn("lifecycle_status", decode("status", DEVICE_STATES, "unknown"))


def status_by_manufacturer(frames: Frames) -> DataFrame:
    """Newest states by manufacturer."""
    return _now(frames).join(frames["equipment"].select("device_id", "manufacturer"), "device_id", "left").groupBy("manufacturer", "lifecycle_status").agg(F.count("*").alias("devices"))


def rates_by_category(frames: Frames) -> DataFrame:
    """Devices by category, with the shares that are defective and returned."""
    state = lambda s: F.count_if(F.col("lifecycle_status") == s).alias(s)
    out = _now(frames).groupBy("category").agg(F.count("*").alias("total"), state("defective"), state("returned"))
    return out.withColumns({"defect_rate_pct": pct("defective", "total"), "return_rate_pct": pct("returned", "total")})


def gmv_by_category(frames: Frames) -> DataFrame:
    """Gross merchandise value per category and month, without cancelled orders."""
    o = frames["shop_orders"].filter("status <> 'canceled'")
    x = frames["shop_items"].join(o, "order_id").join(frames["products"], "product_id", "left")
    return x.groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category"), period("purchased_at", "month").alias("month")).agg(money("price").alias("gmv"), F.countDistinct("order_id").alias("orders"), F.count("*").alias("items"))


def repeat_rate(frames: Frames) -> DataFrame:
    """Share of orders, not cancelled, after their person's first order of any status; equal times are no repeat."""
    first = frames["shop_orders"].groupBy("person_id").agg(F.min("purchased_at").alias("first_at"))
    o = frames["shop_orders"].filter("status <> 'canceled'").join(first, "person_id")
    out = o.groupBy(period("purchased_at", "month").alias("month")).agg(F.countDistinct("order_id").alias("orders"), F.countDistinct(F.when(F.col("purchased_at") > F.col("first_at"), F.col("order_id"))).alias("repeat_orders"))
    return out.withColumn("repeat_rate_pct", pct("repeat_orders", "orders", 4))


def on_time_monthly(frames: Frames) -> DataFrame:
    """Delivered orders and those on time per month of purchase."""
    o = frames["shop_orders"].filter("delivered_at is not null and estimated_at is not null")
    out = o.groupBy(period("purchased_at", "month").alias("month")).agg(F.count("*").alias("delivered"), F.count_if(F.col("delivered_at") <= F.col("estimated_at")).alias("on_time"))
    return out.withColumn("on_time_pct", pct("on_time", "delivered", 4))


def cross_group_share(frames: Frames) -> DataFrame:
    """N50: share of orders with any item from a seller of another group (state) than the customer's."""
    x = frames["shop_items"].join(frames["sellers"].select("seller_id", F.col("group_id").alias("seller_group")).dropDuplicates(["seller_id"]), "seller_id").join(frames["shop_orders"].select("order_id", F.col("group_id").alias("customer_group"), "purchased_at"), "order_id")
    one = x.groupBy("order_id").agg(F.max(F.when(F.col("seller_group") != F.col("customer_group"), 1).otherwise(0)).alias("is_cross"), F.first("purchased_at").alias("purchased_at"))
    out = one.groupBy(period("purchased_at", "month").alias("month")).agg(F.count("*").alias("orders"), F.sum("is_cross").cast("long").alias("cross_orders"))
    return out.withColumn("cross_share_pct", pct("cross_orders", "orders", 4))


def freight_ratio(frames: Frames) -> DataFrame:
    """Freight over price per category, a ratio of sums."""
    x = frames["shop_items"].join(frames["products"], "product_id", "left")
    out = x.groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(money("freight").alias("freight"), money("price").alias("price"), F.count("*").alias("items"))
    return out.withColumn("freight_to_price_pct", pct("freight", "price", 4))


def ecommerce_wide(frames: Frames) -> DataFrame:
    """Monthly punctuality with the running rate."""
    m = running_sum(running_sum(on_time_monthly(frames), ["month"], "on_time", name="running_on_time"), ["month"], "delivered", name="running_delivered")
    return m.withColumn("running_pct", pct("running_on_time", "running_delivered", 4))


def _months(df: DataFrame) -> DataFrame:
    """Date attributes of a column month."""
    return df.withColumns({"year": F.year("month"), "month_number": F.month("month"), "month_name": F.date_format("month", "MMMM"), "year_month": F.date_format("month", "yyyy-MM"), "quarter": F.quarter("month"), "year_quarter": F.concat(F.year("month").cast("string"), F.lit("-Q"), F.quarter("month").cast("string"))})


def wide_gmv(frames: Frames) -> DataFrame:
    """GMV with date attributes and the means per order and item."""
    return _months(gmv_by_category(frames)).withColumn("avg_gmv_per_order", F.round(ratio("gmv", "orders"), 6)).withColumn("avg_item_price", F.round(ratio("gmv", "items"), 6))


def wide_repeat(frames: Frames) -> DataFrame:
    """Repeat orders with date attributes and the first-time orders."""
    return _months(repeat_rate(frames)).withColumn("first_time_orders", F.col("orders") - F.col("repeat_orders"))


def wide_cross_group(frames: Frames) -> DataFrame:
    """Orders across groups with date attributes and those within one."""
    return _months(cross_group_share(frames)).withColumn("same_orders", F.col("orders") - F.col("cross_orders"))


def wide_freight(frames: Frames) -> DataFrame:
    """Freight over price per category and month of purchase, with date attributes."""
    x = frames["shop_items"].join(frames["shop_orders"].select("order_id", "purchased_at"), "order_id").join(frames["products"], "product_id", "left")
    out = x.groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category"), period("purchased_at", "month").alias("month")).agg(money("freight").alias("freight"), money("price").alias("price"), F.countDistinct("order_id").alias("orders"), F.count("*").alias("items"))
    return _months(out).withColumn("freight_to_price_pct", pct("freight", "price", 4))


def days_to_deploy(frames: Frames) -> DataFrame:
    """Per month, deployments and the mean days from a device's first state to them."""
    e = _states(frames)
    e = e.withColumn("_first", F.min("status_date").over(Window.partitionBy("device_id"))).filter("lifecycle_status = 'deployed'")
    return e.groupBy(period("status_date", "month").alias("month")).agg(F.count("*").alias("deployments"), F.round(F.avg(days_between("_first", "status_date").cast("double")), 1).alias("avg_days_to_deploy"))


def defect_trend(frames: Frames) -> DataFrame:
    """Per month, states entered and the share of defects."""
    e = _states(frames).groupBy(period("status_date", "month").alias("month")).agg(F.count("*").alias("total_transitions"), F.count_if(F.col("lifecycle_status") == "defective").alias("defective_count"))
    return e.withColumn("defect_rate_pct", pct("defective_count", "total_transitions"))


def wide_procurement(frames: Frames) -> DataFrame:
    """Order items with vendor, material and calendar."""
    po = _po_measures(_po_facts(frames).join(frames["materials"], "material_id", "left").join(frames["vendors"], "vendor_id", "left"))  # what can be worked out doesn't travel
    return po.withColumn("net_value", F.col("net_value").cast("double")).withColumns({"po_year": F.year("po_date"), "po_quarter": F.quarter("po_date"), "po_month": F.month("po_date"), "po_year_month": F.date_format("po_date", "yyyy-MM")})


def wide_movements(frames: Frames) -> DataFrame:
    """Movements with material, plant, calendar and what their code means."""
    kinds = dim_movement_type(frames).select("movement_type", "process_step", "stock_impact_description")
    m = goods_movements(frames).join(frames["materials"], "material_id", "left").join(kinds, "movement_type", "left").join(frames["plants"].select(F.col("plant_code").cast("int").alias("plant"), "plant_name"), "plant", "left")
    return m.select("document_id", "posting_date", F.year("posting_date").alias("posting_year"), F.quarter("posting_date").alias("posting_quarter"), F.month("posting_date").alias("posting_month"), "movement_type", "process_step", "stock_impact_description", "direction", "quantity", "signed_quantity", "material_id", "material_group", "plant", "plant_name")


def wide_inventory(frames: Frames) -> DataFrame:
    """Stock with material, plant and storage location."""
    places = dim_storage_location(frames).select(F.col("plant_code").cast("int").alias("plant"), F.col("storage_location_code").alias("location"), "storage_location_name", "location_type")
    s = inventory(frames).join(frames["materials"], "material_id", "left").join(frames["plants"].select(F.col("plant_code").cast("int").alias("plant"), "plant_name"), "plant", "left").join(places, ["plant", "location"], "left")
    return s.withColumn("has_qi_stock", F.col("inspection") > 0)


def wide_lifecycle(frames: Frames, as_of: str) -> DataFrame:
    """Devices with their newest state, its age and their material."""
    out = dim_equipment(frames, as_of).join(frames["devices"], "device_id", "left").join(frames["materials"], "material_id", "left")
    return out.select("device_id", "lifecycle_status", "status_date", "days_in_status", "material_id", "material_group")


def po_details(frames: Frames, n: int = 100) -> DataFrame:
    """The newest order items."""
    po = purchase_orders(frames).join(frames["vendors"].select("vendor_id", "vendor_name"), "vendor_id", "left").withColumn("net_value", F.col("net_value").cast("double"))
    return po.select("po_number", "po_item", "po_date", "vendor_name", "material_id", "ordered_quantity", "received_quantity", "net_value", "delivery_status").orderBy(F.desc("po_date"), "po_number", "po_item").limit(n)


def spend_share(frames: Frames) -> DataFrame:
    """Vendors' spend and percentage of all."""
    return share_of_total(frames["po_items"].withColumn("net_value", F.col("net_value").cast("decimal(18,2)").cast("decimal(28,2)")), "vendor_id", "net_value")


def layer_rows(frames: Frames, c: str) -> DataFrame:
    """A column's sum beside every row."""
    return grand_total(frames["layers"], c)
