"""The driver's tables under business names: what the metrics of :mod:`stratum.plans.metrics` run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CODE = "CASE l_returnflag WHEN 'A' THEN '101' WHEN 'R' THEN '122' ELSE '201' END"
_CATEGORY = "CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'A' ELSE 'V' END"
_SIDE = "CASE l_returnflag WHEN 'A' THEN 'S' ELSE 'H' END"
_PLAN = "CASE l_partkey % 5 WHEN 0 THEN 'SVC-FIB' WHEN 1 THEN 'SVC-TV' WHEN 2 THEN 'SVC-CBL' WHEN 3 THEN 'SVC-BIZ' ELSE 'SVC-NEW' END"
_TERMS = "CASE s_suppkey % 3 WHEN 0 THEN 'NT30' WHEN 1 THEN 'NT60' END AS payment_terms"
_PLACE = "concat(CASE WHEN p_brand LIKE '%1' THEN 'Main ' WHEN p_brand LIKE '%2' THEN 'Defective ' WHEN p_brand LIKE '%3' THEN 'Ready ' WHEN p_brand LIKE '%4' THEN 'Regional ' ELSE 'Yard ' END, p_brand)"


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Suppliers as vendors, parts as materials, orders and lines as purchase orders, shop orders and movements, events as device states."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}
    line, orders, part = t["lineitem"], t["orders"], t["part"]
    heads = orders.selectExpr("o_orderkey AS po_number", "cast(o_orderdate AS date) AS po_date")
    # The first line of a number, as a minimum. Lines are dealt by order, so that what joins by order or by line finds them in place.
    first = line.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")).alias("m"))
    items = first.selectExpr("l_orderkey AS po_number", "l_linenumber AS po_item", "m.l_partkey AS material_id", "m.l_suppkey AS vendor_id", "m.l_quantity AS ordered_quantity", "m.l_extendedprice / m.l_quantity AS unit_price", "cast(m.l_extendedprice AS decimal(18,2)) AS net_value")
    moves = line.selectExpr("concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS document_id", "l_orderkey AS po_number", "l_linenumber AS po_item", "l_partkey AS material_id", "l_suppkey AS vendor_id", "cast(l_suppkey % 5 AS int) AS plant", "l_quantity AS quantity", "cast(l_shipdate AS date) AS posting_date", "l_returnflag", "l_linestatus")
    billed = line.filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("po_number")).agg(F.sum("l_quantity").alias("quantity"))
    return {
        "vendors": t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_suppkey AS vendor_id", "s_name AS vendor_name", "n_name AS country_code"),
        "vendor_terms": t["supplier"].selectExpr("s_suppkey AS vendor_id", _TERMS),
        "customers": t["customer"].selectExpr("c_custkey AS customer_id", "c_name AS customer_name", "c_mktsegment AS account_group"),
        "materials": part.selectExpr("p_partkey AS material_id", "p_type AS material_group"),
        "movement_types": line.selectExpr(f"{_CODE} AS movement_type", f"{_CATEGORY} AS movement_category", f"{_SIDE} AS debit_credit_indicator").distinct(),
        "plants": t["nation"].selectExpr("n_nationkey AS plant_code", "n_name AS plant_name", "n_regionkey AS company_code"),
        "companies": t["region"].selectExpr("r_regionkey AS company_code", "r_name AS company_name"),
        "service_plans": line.selectExpr("cast(l_partkey % 5 AS int) AS service_plan_id", f"{_PLAN} AS service_plan_group").distinct(),
        "storage_locations": part.selectExpr("cast(p_partkey % 5 AS int) AS plant_code", "p_brand AS storage_location_code", f"{_PLACE} AS storage_location_name").distinct(),
        "invoice_items": line.join(orders.filter("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey")).filter("l_linestatus = 'F'").selectExpr("l_orderkey AS po_number", "l_linenumber AS po_item", "CASE WHEN l_orderkey % 4 = 0 THEN l_quantity - 1 ELSE l_quantity END AS invoice_quantity"),
        "approvals": line.filter("l_linenumber % 3 = 0").selectExpr("l_orderkey AS po_number", "l_linenumber AS po_item", "CASE WHEN l_orderkey % 2 = 0 THEN '02' ELSE '01' END AS approval_status"),
        "po_headers": heads,
        "po_items": items,
        "po_schedules": heads.selectExpr("po_number", "date_add(po_date, 60) AS scheduled_date"),
        "requisitions": heads.selectExpr("po_number", "date_sub(po_date, cast(po_number % 30 AS int)) AS requisition_date"),
        "receipts": moves.filter("l_returnflag = 'R' OR l_linestatus = 'F'").selectExpr("document_id", "po_number", "po_item", "material_id", "vendor_id", "CASE WHEN l_returnflag = 'R' THEN '102' ELSE '101' END AS movement_type", "quantity", "posting_date"),
        "movements": moves.selectExpr("document_id", "material_id", "vendor_id", "plant", "CASE l_returnflag WHEN 'A' THEN '101' WHEN 'R' THEN '122' ELSE '201' END AS movement_type", "quantity", "posting_date"),
        "stock": part.selectExpr("p_partkey AS material_id", "cast(p_partkey % 5 AS int) AS plant", "p_brand AS location", "cast(greatest(p_size - 25, 0) AS double) AS unrestricted", "0.0D AS inspection", "CASE WHEN p_size % 7 = 0 THEN 1.0D ELSE 0.0D END AS blocked"),
        "invoices": orders.filter("o_orderstatus <> 'P'").selectExpr("o_orderkey AS invoice_id", "o_orderkey AS po_number", "o_totalprice AS amount", "cast(date_add(cast(o_orderdate AS date), 30) AS date) AS invoice_date").join(billed, "po_number", "left"),
        "device_events": t["events"].selectExpr("event_id", "user_id AS device_id", "CASE event_type WHEN 'signup' THEN 'AVLB' WHEN 'purchase' THEN 'INST' WHEN 'error' THEN 'RET' WHEN 'click' THEN 'DLFL' ELSE 'NONE' END AS status", "cast(ts AS date) AS status_date", "cast(user_id % 3 AS int) AS category"),
        "equipment": t["events"].groupBy(F.col("user_id").alias("device_id")).agg(F.min("ts").cast("date").alias("received_on"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).cast("date").alias("started_on"), F.concat(F.lit("M"), F.min(F.col("user_id") % 4).cast("string")).alias("manufacturer")),
        "devices": t["events"].selectExpr("user_id AS device_id", "user_id % 40 + 1 AS material_id").distinct(),
        "billing": line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(f"{_PLAN} AS service_plan_group", "l_orderkey AS billing_doc", "CASE WHEN o_orderkey % 7 > 0 THEN cast(o_orderdate AS date) END AS deployed_on", "cast(trunc(l_shipdate, 'MM') AS date) AS bill_month", "l_extendedprice AS revenue", "CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(5,2)) AS cost", "o_custkey AS customer_id"),
        "shop_orders": orders.join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).selectExpr("o_orderkey AS order_id", "o_custkey AS person_id", "CASE o_orderstatus WHEN 'P' THEN 'canceled' ELSE 'delivered' END AS status", "cast(o_orderdate AS date) AS purchased_at", "date_add(cast(o_orderdate AS date), cast(o_orderkey % 20 AS int)) AS delivered_at", "date_add(cast(o_orderdate AS date), 15) AS estimated_at", "c_nationkey AS group_id"),
        "shop_items": line.selectExpr("l_orderkey AS order_id", "l_linenumber AS item_id", "l_partkey AS product_id", "l_suppkey AS seller_id", "l_extendedprice AS price", "CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_tax AS DECIMAL(5,2)) AS freight"),
        "products": part.selectExpr("p_partkey AS product_id", "CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_type END AS category"),
        "sellers": t["supplier"].selectExpr("s_suppkey AS seller_id", "s_nationkey AS group_id"),
    }


#: The same frames in DuckDB SQL, for the oracle.
FRAMES_SQL = f"""WITH
vendors AS (SELECT s_suppkey AS vendor_id, s_name AS vendor_name, n_name AS country_code FROM supplier JOIN nation ON s_nationkey = n_nationkey),
vendor_terms AS (SELECT s_suppkey AS vendor_id, {_TERMS} FROM supplier),
equipment AS (SELECT user_id AS device_id, CAST(min(ts) AS DATE) AS received_on, CAST(min(ts) FILTER (event_type = 'purchase') AS DATE) AS started_on, concat('M', min(user_id % 4)) AS manufacturer FROM events GROUP BY 1),
customers AS (SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS account_group FROM customer),
materials AS (SELECT p_partkey AS material_id, p_type AS material_group FROM part),
movement_types AS (SELECT DISTINCT {_CODE} AS movement_type, {_CATEGORY} AS movement_category, {_SIDE} AS debit_credit_indicator FROM lineitem),
plants AS (SELECT n_nationkey AS plant_code, n_name AS plant_name, n_regionkey AS company_code FROM nation),
companies AS (SELECT r_regionkey AS company_code, r_name AS company_name FROM region),
service_plans AS (SELECT DISTINCT CAST(l_partkey % 5 AS INTEGER) AS service_plan_id, {_PLAN} AS service_plan_group FROM lineitem),
storage_locations AS (SELECT DISTINCT CAST(p_partkey % 5 AS INTEGER) AS plant_code, p_brand AS storage_location_code, {_PLACE} AS storage_location_name FROM part),
invoice_items AS (SELECT l_orderkey AS po_number, l_linenumber AS po_item, CASE WHEN l_orderkey % 4 = 0 THEN l_quantity - 1 ELSE l_quantity END AS invoice_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_linestatus = 'F'),
approvals AS (SELECT l_orderkey AS po_number, l_linenumber AS po_item, CASE WHEN l_orderkey % 2 = 0 THEN '02' ELSE '01' END AS approval_status FROM lineitem WHERE l_linenumber % 3 = 0),
po_headers AS (SELECT o_orderkey AS po_number, CAST(o_orderdate AS DATE) AS po_date FROM orders),
po_items AS (
  SELECT l_orderkey AS po_number, l_linenumber AS po_item, l_partkey AS material_id, l_suppkey AS vendor_id, l_quantity AS ordered_quantity,
         l_extendedprice / l_quantity AS unit_price, CAST(l_extendedprice AS DECIMAL(18,2)) AS net_value
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS r FROM lineitem) WHERE r = 1),
po_schedules AS (SELECT po_number, po_item, po_date + 60 AS scheduled_date FROM po_items JOIN po_headers USING (po_number)),
requisitions AS (SELECT po_number, po_date - CAST(po_number % 30 AS INTEGER) AS requisition_date FROM po_headers),
receipts AS (
  SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS document_id, l_orderkey AS po_number, l_linenumber AS po_item, l_partkey AS material_id, l_suppkey AS vendor_id,
         CASE WHEN l_returnflag = 'R' THEN '102' ELSE '101' END AS movement_type, l_quantity AS quantity, CAST(l_shipdate AS DATE) AS posting_date
  FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'F'),
movements AS (
  SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS document_id, l_partkey AS material_id, l_suppkey AS vendor_id, CAST(l_suppkey % 5 AS INTEGER) AS plant, CASE l_returnflag WHEN 'A' THEN '101' WHEN 'R' THEN '122' ELSE '201' END AS movement_type,
         l_quantity AS quantity, CAST(l_shipdate AS DATE) AS posting_date,
         CASE l_returnflag WHEN 'A' THEN 'inbound' ELSE 'outbound' END AS direction, CASE l_returnflag WHEN 'A' THEN l_quantity ELSE -l_quantity END AS signed_quantity
  FROM lineitem),
stock AS (
  SELECT p_partkey AS material_id, CAST(p_partkey % 5 AS INTEGER) AS plant, p_brand AS location, CAST(greatest(p_size - 25, 0) AS DOUBLE) AS unrestricted,
         CAST(0 AS DOUBLE) AS inspection, CASE WHEN p_size % 7 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS blocked FROM part),
inventory AS (SELECT *, unrestricted + inspection + blocked AS total_stock, unrestricted + inspection + blocked = 0 AS is_zero_stock, blocked > 0 AS has_blocked_stock FROM stock),
invoices AS (
  SELECT o_orderkey AS po_number, o_orderkey AS invoice_id, o_totalprice AS amount, CAST(o_orderdate AS DATE) + 30 AS invoice_date, b.quantity
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) b ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'),
device_events AS (
  SELECT event_id, user_id AS device_id, CASE event_type WHEN 'signup' THEN 'AVLB' WHEN 'purchase' THEN 'INST' WHEN 'error' THEN 'RET' WHEN 'click' THEN 'DLFL' ELSE 'NONE' END AS status,
         CAST(ts AS DATE) AS status_date, CAST(user_id % 3 AS INTEGER) AS category FROM events),
lifecycle AS (
  SELECT *, lead(status_date) OVER (PARTITION BY device_id ORDER BY status_date, status) AS next_date,
         CAST(row_number() OVER (PARTITION BY device_id ORDER BY status_date, status) AS INTEGER) AS sequence_no,
         row_number() OVER (PARTITION BY device_id ORDER BY status_date DESC, status DESC) = 1 AS is_current,
         CASE status WHEN 'INST' THEN 'deployed' WHEN 'AVLB' THEN 'in_stock' WHEN 'RET' THEN 'returned' WHEN 'DLFL' THEN 'defective' ELSE 'unknown' END AS lifecycle_status
  FROM device_events),
billing AS (
  SELECT {_PLAN} AS service_plan_group, l_orderkey AS billing_doc, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END AS deployed_on, CAST(date_trunc('month', l_shipdate) AS DATE) AS bill_month,
         l_extendedprice AS revenue, CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(5,2)) AS cost, o_custkey AS customer_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
shop_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS person_id, CASE o_orderstatus WHEN 'P' THEN 'canceled' ELSE 'delivered' END AS status, CAST(o_orderdate AS DATE) AS purchased_at,
         CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INTEGER) AS delivered_at, CAST(o_orderdate AS DATE) + 15 AS estimated_at, c_nationkey AS group_id
  FROM orders JOIN customer ON o_custkey = c_custkey),
shop_items AS (SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id, l_extendedprice AS price, CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_tax AS DECIMAL(5,2)) AS freight FROM lineitem),
products AS (SELECT p_partkey AS product_id, CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_type END AS category FROM part),
sellers AS (SELECT s_suppkey AS seller_id, s_nationkey AS group_id FROM supplier),
first_gr AS (SELECT po_number, min(posting_date) AS first_gr_date FROM receipts GROUP BY 1),
got AS (
  SELECT po_number, po_item, sum(CASE WHEN movement_type = '101' THEN quantity ELSE 0 END) AS received_quantity, sum(CASE WHEN movement_type = '102' THEN quantity ELSE 0 END) AS reversed_quantity
  FROM receipts GROUP BY 1, 2),
purchase_orders AS (
  SELECT i.*, h.po_date, s.scheduled_date, r.requisition_date, f.first_gr_date,
         CAST(f.first_gr_date - h.po_date AS INTEGER) AS lead_time_days, f.first_gr_date <= s.scheduled_date + 2 AS is_on_time, CAST(h.po_date - r.requisition_date AS INTEGER) AS po_cycle_days,
         CASE WHEN f.first_gr_date IS NULL THEN 'pending' WHEN g.received_quantity >= i.ordered_quantity THEN 'fully_received' WHEN g.received_quantity > 0 THEN 'partially_received' ELSE 'pending' END AS delivery_status,
         coalesce(g.received_quantity, 0) AS received_quantity, coalesce(g.reversed_quantity, 0) AS reversed_quantity, coalesce(g.received_quantity, 0) * i.unit_price AS received_value
  FROM po_items i LEFT JOIN po_headers h USING (po_number) LEFT JOIN po_schedules s USING (po_number, po_item) LEFT JOIN requisitions r USING (po_number)
       LEFT JOIN first_gr f USING (po_number) LEFT JOIN got g USING (po_number, po_item)),
scorecard0 AS (
  SELECT vendor_id, concat(year(po_date), '-Q', quarter(po_date)) AS year_quarter, count(*) AS total_po_items, CAST(sum(net_value) AS DOUBLE) AS total_spend,
         round(avg(lead_time_days), 6) AS avg_lead_time_days, round(avg(CASE WHEN is_on_time THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS on_time_rate, sum(ordered_quantity) AS ordered, sum(received_quantity) AS received
  FROM purchase_orders WHERE po_date IS NOT NULL GROUP BY 1, 2),
quarters AS (SELECT year_quarter, CAST(sum(CAST(total_spend AS DECIMAL(18,2))) AS DOUBLE) AS quarter_spend FROM scorecard0 GROUP BY 1),
scorecard AS (
  SELECT s.*, round(total_spend / nullif(quarter_spend, 0), 4) AS spend_share, total_spend / nullif(quarter_spend, 0) > 0.6 AS concentration_risk, round(coalesce(received / nullif(ordered, 0), 0), 4) AS fulfillment_rate
  FROM scorecard0 s JOIN quarters USING (year_quarter)),
shop_on_time AS (
  SELECT CAST(date_trunc('month', purchased_at) AS DATE) AS month, count(*) AS delivered, count(*) FILTER (delivered_at <= estimated_at) AS on_time FROM shop_orders GROUP BY 1)
"""
