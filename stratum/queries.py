"""Registered queries of the warehouse, profiling and quality operators on the driver's tables, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import lists, scalars
from stratum.operators import lineage, profile, quality, relational, vault
from stratum.plans import derive, metrics
from stratum.plans.bindings import FRAMES_SQL, frames
from stratum.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables(dict):
    """Driver tables by name, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables, with the SQL of its rows."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def metric(name: str, sql: str, **options) -> None:
    """Register a metric over the bound frames; the SQL goes on from the frames' common table expressions."""
    f = getattr(metrics, name)
    QUERIES[name] = lambda spark, sf_dir: f(frames(spark, sf_dir), **options)
    ORACLES[name] = f"{FRAMES_SQL}\n{sql}"


# --- N: metrics ---------------------------------------------------------------------------------
# The flagship: vendor scorecard.
metric("vendor_scorecard", "SELECT * FROM scorecard")
_PO = "po_number, po_item, material_id, vendor_id, ordered_quantity, unit_price, CAST(net_value AS DOUBLE) AS net_value, po_date, scheduled_date, requisition_date, first_gr_date, lead_time_days, is_on_time, po_cycle_days, delivery_status, received_quantity, reversed_quantity, received_value"
QUERIES["purchase_orders"] = lambda spark, sf_dir: metrics.purchase_orders(frames(spark, sf_dir)).withColumn("net_value", F.col("net_value").cast("double"))
ORACLES["purchase_orders"] = f"{FRAMES_SQL} SELECT {_PO} FROM purchase_orders"
metric("dim_customer", "SELECT *, CASE account_group WHEN 'HOUSEHOLD' THEN 'private' WHEN 'MACHINERY' THEN 'industry' ELSE 'other' END AS segment FROM customers", segments={"HOUSEHOLD": "private", "MACHINERY": "industry"})
metric("dim_vendor", "SELECT *, CASE WHEN country_code IN ('NATION_0', 'NATION_1') THEN 'near' WHEN country_code IN ('NATION_2', 'NATION_3') THEN 'far' ELSE 'other' END AS vendor_region FROM vendors", regions={"near": ["NATION_0", "NATION_1"], "far": ["NATION_2", "NATION_3"]})
metric("dim_material", "SELECT *, CASE material_group WHEN 'ECONOMY' THEN 'cheap' WHEN 'PROMO' THEN 'promoted' ELSE 'other' END AS material_group_name FROM materials", groups={"ECONOMY": "cheap", "PROMO": "promoted"})
metric("dim_equipment", "SELECT device_id, lifecycle_status, status_date, CAST(DATE '2025-01-01' - status_date AS INTEGER) AS days_in_status, CAST(DATE '2025-01-01' - received_on AS INTEGER) AS days_since_receipt, CAST(DATE '2025-01-01' - started_on AS INTEGER) AS days_since_deployment FROM lifecycle LEFT JOIN equipment USING (device_id) WHERE is_current", as_of="2025-01-01")
metric("dim_movement_type", """SELECT *, CASE WHEN movement_category = 'X' THEN 'transfer' WHEN debit_credit_indicator = 'S' THEN 'inbound' WHEN debit_credit_indicator = 'H' THEN 'outbound' ELSE 'unknown' END AS direction,
  CASE movement_type WHEN '101' THEN 'goods_receipt' WHEN '122' THEN 'vendor_return' WHEN '201' THEN 'installation' ELSE 'other' END AS process_step,
  CAST(CASE WHEN movement_category = 'X' THEN 0 WHEN debit_credit_indicator = 'S' THEN 1 WHEN debit_credit_indicator = 'H' THEN -1 ELSE 0 END AS INTEGER) AS stock_impact_sign,
  CASE WHEN movement_category = 'X' THEN 'neutral' WHEN debit_credit_indicator = 'S' THEN 'increase' WHEN debit_credit_indicator = 'H' THEN 'decrease' ELSE 'neutral' END AS stock_impact_description FROM movement_types""")
metric("dim_plant", "SELECT md5(CAST(plant_code AS VARCHAR)) AS hk_plant, plant_code, plant_name, company_code, company_name FROM plants LEFT JOIN companies USING (company_code)")
metric("dim_service_plan", "SELECT md5(CAST(service_plan_id AS VARCHAR)) AS hk_service_plan, service_plan_id, service_plan_group, CASE service_plan_group WHEN 'SVC-FIB' THEN 'Fiber Broadband' WHEN 'SVC-TV' THEN 'IPTV Bundle' WHEN 'SVC-CBL' THEN 'Cable Broadband' WHEN 'SVC-BIZ' THEN 'Business Connectivity' ELSE 'Other' END AS plan_category FROM service_plans")
_PLACES = "SELECT md5(concat(plant_code, '||', storage_location_code)) AS hk_storage_location, plant_code, storage_location_code, storage_location_name, plant_name, CASE WHEN storage_location_name LIKE '%Main%' OR storage_location_name LIKE '%Central%' THEN 'primary' WHEN storage_location_name LIKE '%Defective%' OR storage_location_name LIKE '%Return%' THEN 'returns' WHEN storage_location_name LIKE '%Ready%' OR storage_location_name LIKE '%Deploy%' THEN 'staging' WHEN storage_location_name LIKE '%Regional%' THEN 'regional' ELSE 'other' END AS location_type FROM storage_locations LEFT JOIN plants USING (plant_code)"
metric("dim_storage_location", _PLACES)
metric("goods_movements", "SELECT document_id, material_id, vendor_id, plant, movement_type, quantity, posting_date, direction, signed_quantity FROM movements")
metric("invoices", "SELECT i.po_number, invoice_id, amount, invoice_date, quantity, po_date, CAST(invoice_date - po_date AS INTEGER) AS days_po_to_invoice FROM invoices i LEFT JOIN po_headers USING (po_number)")


def _lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a day that a device enters twice count once, so that their order is defined."""
    bound = frames(spark, sf_dir)
    return metrics.equipment_lifecycle(bound | {"device_events": bound["device_events"].drop("event_id").distinct()}, "2025-01-01")


QUERIES["equipment_lifecycle"] = _lifecycle
ORACLES["equipment_lifecycle"] = f"""{FRAMES_SQL} SELECT l.*, CAST(coalesce(next_date, DATE '2025-01-01') - status_date AS INTEGER) AS days_in_status, CASE WHEN status = 'INST' THEN CAST(status_date - received_on AS INTEGER) END AS days_receipt_to_deployment FROM (
  SELECT device_id, status, status_date, category, lead(status_date) OVER (PARTITION BY device_id ORDER BY status_date, status) AS next_date, CAST(row_number() OVER (PARTITION BY device_id ORDER BY status_date, status) AS INTEGER) AS sequence_no,
         row_number() OVER (PARTITION BY device_id ORDER BY status_date DESC, status DESC) = 1 AS is_current, CASE status WHEN 'INST' THEN 'deployed' WHEN 'AVLB' THEN 'in_stock' WHEN 'RET' THEN 'returned' WHEN 'DLFL' THEN 'defective' ELSE 'unknown' END AS lifecycle_status
  FROM (SELECT DISTINCT device_id, status, status_date, category FROM device_events)) l LEFT JOIN equipment USING (device_id)"""
metric("receipt_accuracy", "SELECT *, round(100.0::DOUBLE * accurate_receipts / nullif(total_receipts, 0), 2) AS accuracy_percentage FROM (SELECT r.vendor_id, CAST(date_trunc('quarter', posting_date) AS DATE) AS quarter, count(*) AS total_receipts, count(*) FILTER (quantity = ordered_quantity) AS accurate_receipts, min(posting_date) AS first_receipt_date, max(posting_date) AS last_receipt_date FROM receipts r JOIN po_items USING (po_number, po_item, material_id) WHERE movement_type = '101' GROUP BY 1, 2)")
metric("receipts_monthly", "SELECT CAST(date_trunc('month', posting_date) AS DATE) AS month, count(DISTINCT document_id) AS documents, count(*) AS lines, sum(quantity) AS quantity FROM receipts WHERE movement_type = '101' GROUP BY 1")
metric("inventory", "SELECT * FROM inventory")
metric("three_way_match", """SELECT vendor_id, month, total_po_lines, round(100.0::DOUBLE * matched / total_po_lines, 2) AS matched_pct, exception_count, approved_exception_count, exception_count - approved_exception_count AS open_exception_count FROM (
  SELECT vendor_id, CAST(date_trunc('month', po_date) AS DATE) AS month, count(*) AS total_po_lines,
         sum(CASE WHEN received > 0 AND abs(ordered_quantity - received) / ordered_quantity < 0.05 AND abs(received - coalesce(invoiced, 0)) / received < 0.05 THEN 1 ELSE 0 END) AS matched,
         CAST(coalesce(sum(exceptions), 0) AS BIGINT) AS exception_count, CAST(coalesce(sum(approved), 0) AS BIGINT) AS approved_exception_count
  FROM po_items JOIN po_headers USING (po_number)
       LEFT JOIN (SELECT po_number, po_item, sum(quantity) AS received FROM receipts WHERE movement_type = '101' AND quantity > 0 GROUP BY 1, 2) USING (po_number, po_item)
       LEFT JOIN (SELECT po_number, po_item, sum(invoice_quantity) AS invoiced FROM invoice_items WHERE invoice_quantity > 0 GROUP BY 1, 2) USING (po_number, po_item)
       LEFT JOIN (SELECT po_number, po_item, count(*) AS exceptions, count(*) FILTER (approval_status = '02') AS approved FROM approvals GROUP BY 1, 2) USING (po_number, po_item)
  WHERE ordered_quantity > 0 GROUP BY 1, 2)""")
_MARGIN = """SELECT *, round(revenue - cost, 2) AS margin FROM (
  SELECT CASE service_plan_group WHEN 'SVC-FIB' THEN 'fiber' WHEN 'SVC-TV' THEN 'TV' WHEN 'SVC-CBL' THEN 'cable' WHEN 'SVC-BIZ' THEN 'business' ELSE 'unknown' END AS service_plan,
         CASE WHEN t IS NULL THEN 'unknown' WHEN t < 12 THEN '0-12' WHEN t < 24 THEN '12-24' WHEN t < 48 THEN '24-48' ELSE '48+' END AS tenure_band, bill_month AS billing_month,
         CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue, CAST(sum(CAST(CASE WHEN bill_month >= coalesce(deployed_on, first_month) AND bill_month < coalesce(deployed_on, first_month) + INTERVAL 24 MONTH THEN cost ELSE 0 END AS DECIMAL(18,2))) AS DOUBLE) AS cost,
         count(DISTINCT customer_id) AS customers, count(DISTINCT billing_doc) AS billing_docs
  FROM (SELECT *, date_diff('month', first_month, bill_month) AS t FROM billing JOIN (SELECT customer_id, min(bill_month) AS first_month FROM billing GROUP BY 1) USING (customer_id)) GROUP BY 1, 2, 3)"""
metric("contribution_margin", _MARGIN)
metric("wide_margin", f"SELECT *, CASE WHEN revenue > 0 THEN round(100.0::DOUBLE * margin / revenue, 2) END AS margin_pct, margin / nullif(customers, 0) AS margin_per_customer, margin >= 0 AS is_margin_positive, CAST(year(billing_month) AS INTEGER) AS billing_year, CAST(month(billing_month) AS INTEGER) AS billing_month_num FROM ({_MARGIN})")
metric("wide_scorecard", "SELECT s.*, vendor_name, CASE WHEN country_code IN ('NATION_0', 'NATION_1') THEN 'near' WHEN country_code IN ('NATION_2', 'NATION_3') THEN 'far' ELSE 'other' END AS vendor_region, payment_terms FROM scorecard s JOIN vendors USING (vendor_id) LEFT JOIN vendor_terms USING (vendor_id)", regions={"near": ["NATION_0", "NATION_1"], "far": ["NATION_2", "NATION_3"]})
metric("vendor_performance", """SELECT * EXCLUDE (rate), round(rate * 100, 1) AS otd_rate_pct, round(total_received_qty / nullif(total_ordered_qty, 0) * 100, 1) AS fulfillment_rate_pct,
  CASE WHEN rate >= 0.8 THEN 'A' WHEN rate >= 0.6 THEN 'B' WHEN rate >= 0.4 THEN 'C' ELSE 'D' END AS performance_grade, CASE WHEN rate >= 0.8 THEN 'GREEN' WHEN rate >= 0.6 THEN 'YELLOW' ELSE 'RED' END AS health_status
  FROM (SELECT vendor_id, vendor_name, country_code, count(DISTINCT po_number) AS total_pos, CAST(sum(net_value) AS DOUBLE) AS total_spend, round(avg(lead_time_days), 1) AS avg_lead_time_days, avg(CASE WHEN is_on_time THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate,
               sum(ordered_quantity) AS total_ordered_qty, sum(received_quantity) AS total_received_qty FROM vendors LEFT JOIN purchase_orders USING (vendor_id) GROUP BY 1, 2, 3)""")
metric("procurement_health", """SELECT *, CASE WHEN otd_rate_pct >= 80 THEN 'GREEN' WHEN otd_rate_pct >= 60 THEN 'YELLOW' ELSE 'RED' END AS otd_health, CASE WHEN avg_lead_time_days <= 35 THEN 'GREEN' WHEN avg_lead_time_days <= 50 THEN 'YELLOW' ELSE 'RED' END AS lead_time_health,
  CASE WHEN avg_po_cycle_days <= 5 THEN 'GREEN' WHEN avg_po_cycle_days <= 10 THEN 'YELLOW' ELSE 'RED' END AS cycle_time_health, CASE WHEN has_concentration_risk THEN 'RED' WHEN highest_concentration_pct > 50 THEN 'YELLOW' ELSE 'GREEN' END AS concentration_health,
  CASE WHEN zero_stock_locations > 5 THEN 'RED' WHEN zero_stock_locations > 0 THEN 'YELLOW' ELSE 'GREEN' END AS inventory_health
  FROM (SELECT count(DISTINCT po_number) AS total_pos, count(*) AS total_po_items, round(avg(lead_time_days), 1) AS avg_lead_time_days, round(avg(CASE WHEN is_on_time THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 1) AS otd_rate_pct, round(avg(po_cycle_days), 1) AS avg_po_cycle_days,
               CAST(sum(net_value) AS DOUBLE) AS total_spend, count(*) FILTER (delivery_status = 'pending') AS pending_deliveries, count(*) FILTER (delivery_status = 'partially_received') AS partial_deliveries FROM purchase_orders),
       (SELECT round(max(spend_share) * 100, 1) AS highest_concentration_pct, bool_or(concentration_risk) AS has_concentration_risk, vendor_name AS highest_concentration_vendor FROM scorecard JOIN vendors USING (vendor_id) GROUP BY vendor_id, vendor_name ORDER BY 1 DESC, 3 LIMIT 1),
       (SELECT count(*) FILTER (is_zero_stock) AS zero_stock_locations, count(*) FILTER (has_blocked_stock) AS blocked_stock_locations, round(sum(total_stock), 0) AS total_stock_units FROM inventory)""")
metric("lifecycle_metrics", "SELECT *, round(100.0::DOUBLE * deployed / devices, 2) AS deployment_rate, round(100.0::DOUBLE * returned / devices, 2) AS return_rate, CASE WHEN 100.0 * returned / devices <= 5 THEN 'GREEN' WHEN 100.0 * returned / devices <= 10 THEN 'YELLOW' ELSE 'RED' END AS return_state FROM (SELECT count(*) AS devices, count(*) FILTER (lifecycle_status = 'deployed') AS deployed, count(*) FILTER (lifecycle_status = 'returned') AS returned FROM lifecycle WHERE is_current)")
metric("inventory_alerts", """SELECT material_id, plant, location, unrestricted, blocked, total_stock, CASE WHEN unrestricted = 0 AND total_stock = 0 THEN 'ZERO_STOCK' WHEN blocked > 0 THEN 'BLOCKED_STOCK' WHEN unrestricted > 5000 THEN 'EXCESS_STOCK' ELSE 'OK' END AS alert_type,
  CASE WHEN unrestricted = 0 AND total_stock = 0 THEN 'RED' WHEN blocked > 0 OR unrestricted > 5000 THEN 'YELLOW' ELSE 'GREEN' END AS health_status FROM inventory WHERE unrestricted = 0 OR blocked > 0 OR unrestricted > 5000""")
_SHARE = "100.0::DOUBLE * {0} / total_devices"
metric(
    "lifecycle_by_group",
    f"""SELECT *, 'Other' AS equipment_category, round({_SHARE.format("deployed")}, 1) AS deployment_rate_pct, round({_SHARE.format("defective")}, 2) AS defect_rate_pct, round({_SHARE.format("returned")}, 2) AS return_rate_pct,
        CASE WHEN {_SHARE.format("defective")} > 5 THEN 'RED' WHEN {_SHARE.format("defective")} > 3 THEN 'YELLOW' ELSE 'GREEN' END AS defect_health,
        CASE WHEN {_SHARE.format("returned")} > 10 THEN 'RED' WHEN {_SHARE.format("returned")} > 5 THEN 'YELLOW' ELSE 'GREEN' END AS return_health
    FROM (
        SELECT material_group, count(*) AS total_devices, count(*) FILTER (status = 'INST') AS deployed, count(*) FILTER (status = 'AVLB') AS in_stock, count(*) FILTER (status = 'RET') AS returned, count(*) FILTER (status = 'DLFL') AS defective
        FROM (SELECT DISTINCT user_id AS device_id, user_id % 40 + 1 AS material_id FROM events) d LEFT JOIN (SELECT device_id, status FROM lifecycle WHERE is_current) USING (device_id) LEFT JOIN materials USING (material_id)
        GROUP BY 1)""",
)
metric("active_devices", "SELECT count(DISTINCT device_id) AS active_devices FROM lifecycle WHERE is_current AND lifecycle_status = 'deployed'")
metric("days_of_stock", "SELECT material_id, stock, issued, round(stock / nullif(issued / 30, 0), 2) AS days_of_stock FROM (SELECT material_id, sum(unrestricted) AS stock FROM stock GROUP BY 1) LEFT JOIN (SELECT material_id, sum(quantity) AS issued FROM movements WHERE direction = 'outbound' AND posting_date > DATE '1998-12-31' - 30 AND posting_date <= DATE '1998-12-31' GROUP BY 1) USING (material_id)", as_of="1998-12-31")
metric("inventory_turnover", """SELECT material_group, quarter, issued, round(avg_stock, 4) AS avg_stock, round(issued / nullif(avg_stock, 0), 4) AS turnover FROM (
  SELECT material_group, CAST(date_trunc('quarter', month) AS DATE) AS quarter, sum(issued) AS issued, avg(level) AS avg_stock FROM (
    SELECT *, sum(net) OVER (PARTITION BY material_group ORDER BY month ROWS UNBOUNDED PRECEDING) AS level FROM (
      SELECT material_group, CAST(date_trunc('month', posting_date) AS DATE) AS month, sum(signed_quantity) AS net, sum(CASE WHEN movement_type = '201' THEN quantity ELSE 0 END) AS issued
      FROM movements JOIN materials USING (material_id) GROUP BY 1, 2)) GROUP BY 1, 2)""")
metric("return_ratio", "SELECT *, round(100.0::DOUBLE * returned / nullif(deployed, 0), 2) AS return_ratio_pct FROM (SELECT category, count(*) FILTER (status = 'INST') AS deployed, count(*) FILTER (status = 'RET') AS returned FROM device_events GROUP BY 1)")
metric("returns_within_days", """SELECT *, round(100.0::DOUBLE * returned / nullif(receipts, 0), 2) AS return_rate_pct FROM (
  SELECT r.material_id, r.vendor_id, CAST(date_trunc('quarter', r.posting_date) AS DATE) AS quarter, count(DISTINCT r.document_id) AS receipts, count(DISTINCT CASE WHEN h.document_id IS NOT NULL THEN r.document_id END) AS returned
  FROM receipts r LEFT JOIN (SELECT DISTINCT a.document_id FROM receipts a JOIN movements b ON b.movement_type = '122' AND a.material_id = b.material_id AND a.vendor_id = b.vendor_id AND b.posting_date >= a.posting_date AND b.posting_date <= a.posting_date + 90 WHERE a.movement_type = '101') h USING (document_id)
  WHERE r.movement_type = '101' GROUP BY 1, 2, 3)""")
metric("po_volume", "SELECT CAST(date_trunc('month', po_date) AS DATE) AS month, count(DISTINCT po_number) AS orders, count(*) AS items, CAST(sum(net_value) AS DOUBLE) AS value FROM po_items JOIN po_headers USING (po_number) GROUP BY 1")
metric("vendor_lead_otd", "SELECT vendor_id, round(avg(lead_time_days), 6) AS avg_lead_time, round(100 * avg(CAST(is_on_time AS INTEGER)), 6) AS on_time_pct FROM purchase_orders GROUP BY 1")
metric("delivery_status_dist", "SELECT delivery_status, count(*) AS n FROM purchase_orders GROUP BY 1")
metric("vendor_summary", "SELECT vendor_id, CAST(sum(CAST(total_spend AS DECIMAL(18,2))) AS DOUBLE) AS spend, round(avg(avg_lead_time_days), 6) AS mean_lead_time, round(avg(on_time_rate), 4) AS mean_on_time, CAST(sum(total_po_items) AS BIGINT) AS po_items, round(avg(spend_share), 4) AS mean_share FROM scorecard GROUP BY 1")
metric("concentration_by_quarter", "SELECT year_quarter, count(*) FILTER (spend_share > 0.01) AS vendors, count(*) FILTER (concentration_risk) AS flagged, max(spend_share) AS top_share FROM scorecard GROUP BY 1")
metric("otd_matrix", "SELECT vendor_id, max(on_time_rate) FILTER (year_quarter = '1996-Q1') AS \"1996-Q1\", max(on_time_rate) FILTER (year_quarter = '1996-Q2') AS \"1996-Q2\" FROM scorecard GROUP BY 1", quarters=["1996-Q1", "1996-Q2"])
metric("inventory_kpis", "SELECT plant, sum(total_stock) AS total_stock, sum(blocked) AS blocked, count(*) FILTER (is_zero_stock) AS zero_locations FROM inventory GROUP BY 1")
metric("stock_flow", "SELECT month, net, sum(net) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS cumulative FROM (SELECT CAST(date_trunc('month', posting_date) AS DATE) AS month, sum(signed_quantity) AS net FROM movements GROUP BY 1)")
metric("movement_kpis", "SELECT CAST(date_trunc('month', posting_date) AS DATE) AS month, direction, count(*) AS lines, sum(quantity) AS quantity FROM movements GROUP BY 1, 2")
metric("movements_by_category", "SELECT material_group, direction, count(*) AS lines, sum(quantity) AS quantity FROM movements LEFT JOIN materials USING (material_id) GROUP BY 1, 2")
metric("recent_movements", "SELECT material_id, posting_date, document_id, movement_type, direction, quantity, plant, material_group FROM (SELECT * FROM movements ORDER BY posting_date DESC, document_id LIMIT 50) LEFT JOIN materials USING (material_id)")
metric("status_by_manufacturer", "SELECT manufacturer, lifecycle_status, count(*) AS devices FROM lifecycle LEFT JOIN equipment USING (device_id) WHERE is_current GROUP BY 1, 2")
metric("rates_by_category", "SELECT *, round(100.0::DOUBLE * defective / total, 2) AS defect_rate_pct, round(100.0::DOUBLE * returned / total, 2) AS return_rate_pct FROM (SELECT category, count(*) AS total, count(*) FILTER (lifecycle_status = 'defective') AS defective, count(*) FILTER (lifecycle_status = 'returned') AS returned FROM lifecycle WHERE is_current GROUP BY 1)")
metric("lifecycle_activity", "SELECT *, received - deployed - defective AS net_change FROM (SELECT count(*) FILTER (sequence_no = 1) AS received, count(*) FILTER (lifecycle_status = 'deployed') AS deployed, count(*) FILTER (lifecycle_status = 'returned') AS returned, count(*) FILTER (lifecycle_status = 'defective') AS defective FROM lifecycle WHERE status_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-09')", start="2024-01-02", end="2024-01-09")
metric("lifecycle_trends", "SELECT *, round(100.0::DOUBLE * returned / nullif(events, 0), 2) AS return_share_pct FROM (SELECT CAST(date_trunc('month', status_date) AS DATE) AS month, count(*) AS events, count(*) FILTER (lifecycle_status = 'deployed') AS deployed, count(*) FILTER (lifecycle_status = 'returned') AS returned FROM lifecycle GROUP BY 1)")
metric("status_by_category", "SELECT category, lifecycle_status, count(*) AS devices FROM lifecycle WHERE is_current GROUP BY 1, 2")
metric("gmv_by_category", "SELECT coalesce(category, 'uncategorized') AS category, CAST(date_trunc('month', purchased_at) AS DATE) AS month, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS gmv, count(DISTINCT order_id) AS orders, count(*) AS items FROM shop_items JOIN shop_orders USING (order_id) LEFT JOIN products USING (product_id) WHERE status <> 'canceled' GROUP BY 1, 2")
metric("repeat_rate", "SELECT *, round(100.0::DOUBLE * repeat_orders / nullif(orders, 0), 4) AS repeat_rate_pct FROM (SELECT CAST(date_trunc('month', purchased_at) AS DATE) AS month, count(DISTINCT order_id) AS orders, count(DISTINCT CASE WHEN purchased_at > first_at THEN order_id END) AS repeat_orders FROM shop_orders JOIN (SELECT person_id, min(purchased_at) AS first_at FROM shop_orders GROUP BY 1) USING (person_id) WHERE status <> 'canceled' GROUP BY 1)")
metric("on_time_monthly", "SELECT *, round(100.0::DOUBLE * on_time / nullif(delivered, 0), 4) AS on_time_pct FROM shop_on_time")
metric("cross_group_share", "SELECT *, round(100.0::DOUBLE * cross_orders / nullif(orders, 0), 4) AS cross_share_pct FROM (SELECT CAST(date_trunc('month', purchased_at) AS DATE) AS month, count(*) AS orders, CAST(sum(is_cross) AS BIGINT) AS cross_orders FROM (SELECT o.order_id, any_value(o.purchased_at) AS purchased_at, max(CASE WHEN s.group_id <> o.group_id THEN 1 ELSE 0 END) AS is_cross FROM shop_items i JOIN sellers s USING (seller_id) JOIN shop_orders o USING (order_id) GROUP BY 1) GROUP BY 1)")
metric("freight_ratio", "SELECT *, round(100.0::DOUBLE * freight / nullif(price, 0), 4) AS freight_to_price_pct FROM (SELECT coalesce(category, 'uncategorized') AS category, CAST(sum(CAST(freight AS DECIMAL(18,2))) AS DOUBLE) AS freight, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS price, count(*) AS items FROM shop_items LEFT JOIN products USING (product_id) GROUP BY 1)")
metric("ecommerce_wide", "SELECT *, round(100.0::DOUBLE * on_time / nullif(delivered, 0), 4) AS on_time_pct, round(100.0::DOUBLE * running_on_time / running_delivered, 4) AS running_pct FROM (SELECT *, CAST(sum(on_time) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_on_time, CAST(sum(delivered) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_delivered FROM shop_on_time)")
_MONTHS = "CAST(year(month) AS INTEGER) AS year, CAST(month(month) AS INTEGER) AS month_number, monthname(month) AS month_name, strftime(month, '%Y-%m') AS year_month, CAST(quarter(month) AS INTEGER) AS quarter, concat(year(month), '-Q', quarter(month)) AS year_quarter"
metric("wide_gmv", f"SELECT *, {_MONTHS}, round(gmv / nullif(orders, 0), 6) AS avg_gmv_per_order, round(gmv / nullif(items, 0), 6) AS avg_item_price FROM (" + ORACLES["gmv_by_category"].removeprefix(f"{FRAMES_SQL}\n") + ")")
metric("wide_repeat", f"SELECT *, {_MONTHS}, orders - repeat_orders AS first_time_orders FROM (" + ORACLES["repeat_rate"].removeprefix(f"{FRAMES_SQL}\n") + ")")
metric("wide_cross_group", f"SELECT *, {_MONTHS}, orders - cross_orders AS same_orders FROM (" + ORACLES["cross_group_share"].removeprefix(f"{FRAMES_SQL}\n") + ")")
metric("wide_freight", f"SELECT *, {_MONTHS}, round(100.0::DOUBLE * freight / nullif(price, 0), 4) AS freight_to_price_pct FROM (SELECT coalesce(category, 'uncategorized') AS category, CAST(date_trunc('month', purchased_at) AS DATE) AS month, CAST(sum(CAST(freight AS DECIMAL(18,2))) AS DOUBLE) AS freight, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS price, count(DISTINCT order_id) AS orders, count(*) AS items FROM shop_items JOIN shop_orders USING (order_id) LEFT JOIN products USING (product_id) GROUP BY 1, 2)")
metric("days_to_deploy", "SELECT CAST(date_trunc('month', status_date) AS DATE) AS month, count(*) AS deployments, round(avg(status_date - first_date), 1) AS avg_days_to_deploy FROM (SELECT *, min(status_date) OVER (PARTITION BY device_id) AS first_date FROM lifecycle) WHERE lifecycle_status = 'deployed' GROUP BY 1")
metric("defect_trend", "SELECT *, round(100.0::DOUBLE * defective_count / nullif(total_transitions, 0), 2) AS defect_rate_pct FROM (SELECT CAST(date_trunc('month', status_date) AS DATE) AS month, count(*) AS total_transitions, count(*) FILTER (lifecycle_status = 'defective') AS defective_count FROM lifecycle GROUP BY 1)")
metric("wide_procurement", f"SELECT {_PO}, vendor_name, country_code, material_group, CAST(year(po_date) AS INTEGER) AS po_year, CAST(quarter(po_date) AS INTEGER) AS po_quarter, CAST(month(po_date) AS INTEGER) AS po_month, strftime(po_date, '%Y-%m') AS po_year_month FROM purchase_orders LEFT JOIN vendors USING (vendor_id) LEFT JOIN materials USING (material_id)")
metric("wide_movements", "SELECT document_id, posting_date, CAST(year(posting_date) AS INTEGER) AS posting_year, CAST(quarter(posting_date) AS INTEGER) AS posting_quarter, CAST(month(posting_date) AS INTEGER) AS posting_month, movement_type, CASE movement_type WHEN '101' THEN 'goods_receipt' WHEN '122' THEN 'vendor_return' ELSE 'installation' END AS process_step, CASE movement_type WHEN '101' THEN 'increase' ELSE 'decrease' END AS stock_impact_description, direction, quantity, signed_quantity, material_id, material_group, plant, plant_name FROM movements LEFT JOIN materials USING (material_id) LEFT JOIN plants ON plant = plant_code")
metric("wide_inventory", f"SELECT i.*, material_group, p.plant_name, storage_location_name, location_type, inspection > 0 AS has_qi_stock FROM inventory i LEFT JOIN materials USING (material_id) LEFT JOIN plants p ON plant = p.plant_code LEFT JOIN ({_PLACES}) l ON l.plant_code = plant AND storage_location_code = location")
metric("wide_lifecycle", "SELECT l.device_id, lifecycle_status, status_date, CAST(DATE '2025-01-01' - status_date AS INTEGER) AS days_in_status, material_id, material_group FROM lifecycle l LEFT JOIN (SELECT DISTINCT user_id AS device_id, user_id % 40 + 1 AS material_id FROM events) USING (device_id) LEFT JOIN materials USING (material_id) WHERE is_current", as_of="2025-01-01")
metric("po_details", "SELECT po_number, po_item, po_date, vendor_name, material_id, ordered_quantity, received_quantity, CAST(net_value AS DOUBLE) AS net_value, delivery_status FROM purchase_orders LEFT JOIN vendors USING (vendor_id) ORDER BY po_date DESC, po_number, po_item LIMIT 100")


# --- B, C: staging and vault ---------------------------------------------------------------------
_LOADS = ("2024-01-01 00:00:00", "2024-02-01 00:00:00")
_CUSTOMERS = vault.StagingSpec("CUSTOMER", {"hk_customer": ["c_custkey"]}, change=["c_name", "c_nationkey", "c_mktsegment"])


def _customer_loads(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two loads of customers; in the second, those divisible by 7 have moved to another segment."""
    c = t["customer"].select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    moved = c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    return vault.stage(c, _CUSTOMERS, _LOADS[0]), vault.stage(moved, _CUSTOMERS, _LOADS[1])


def _customer_sat(t: Tables) -> DataFrame:
    spec = vault.SatSpec("hk_customer", {"c_name": "customer_name", "c_mktsegment": "segment"})
    one, two = _customer_loads(t)
    first = vault.load_sat(one, None, spec)
    return first.unionByName(vault.load_sat(two, first, spec))


_HASH = "md5(concat_ws('||', {}))"
_SAT_SQL = f"""WITH c AS (SELECT *, {_HASH.format("coalesce(CAST(c_custkey AS VARCHAR), '')")} AS hk_customer FROM customer),
l AS (SELECT hk_customer, c_custkey, c_name, c_nationkey, c_mktsegment AS seg, '2024-01-01 00:00:00' AS load_date FROM c
      UNION ALL SELECT hk_customer, c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END, '2024-02-01 00:00:00' FROM c),
h AS (SELECT *, {_HASH.format("c_name, CAST(c_nationkey AS VARCHAR), seg")} AS hashdiff FROM l),
sat AS (SELECT hk_customer, c_name AS customer_name, seg AS segment, hashdiff, min(load_date) AS load_date FROM h GROUP BY ALL)
"""


def _times_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("load_date", F.date_format("load_date", "yyyy-MM-dd HH:mm:ss"))


@query("b_stage_orders", """SELECT md5(CAST(o_orderkey AS VARCHAR)) AS hk_order, md5(CAST(o_custkey AS VARCHAR)) AS hk_customer, o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice,
  CAST(CASE WHEN length(d) = 8 THEN try_strptime(d, '%Y%m%d') END AS DATE) AS o_orderdate, md5(concat_ws('||', o_orderstatus, d)) AS hashdiff, 'ORDERS' AS record_source
FROM (SELECT *, CASE WHEN o_orderkey % 97 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y%m%d') END AS d FROM orders)""")
def _(t):
    raw = t["orders"].withColumn("o_orderdate", F.when(F.col("o_orderkey") % 97 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))).drop("o_orderpriority")
    spec = vault.StagingSpec("ORDERS", {"hk_order": ["o_orderkey"], "hk_customer": ["o_custkey"]}, ["o_orderdate"], {"o_totalprice": "decimal(15,2)"}, ["o_orderstatus", "o_orderdate"])
    return vault.stage(raw, spec, _LOADS[0]).drop("load_date").withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query("b_surrogate_key", "SELECT o_orderkey, md5(concat_ws('-', CAST(o_orderkey AS VARCHAR), coalesce(CAST(nullif(o_orderstatus, 'P') AS VARCHAR), '_dbt_utils_surrogate_key_null_'))) AS sk FROM orders")
def _(t):
    return t["orders"].select("o_orderkey", scalars.surrogate_key("o_orderkey", F.nullif("o_orderstatus", F.lit("P"))).alias("sk"))


@query("b_bands_health", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS balance_band,
  CASE WHEN c_acctbal >= 7000 THEN 'GREEN' WHEN c_acctbal >= 3000 THEN 'YELLOW' ELSE 'RED' END AS health,
  CASE WHEN c_name LIKE '%1' OR c_name LIKE '%2' THEN 'odd' WHEN c_name LIKE '%9' THEN 'nine' ELSE 'rest' END AS name_group, substring(c_name, 10) AS number FROM customer""")
def _(t):
    return t["customer"].select("c_custkey", scalars.band("c_acctbal", (0, 5000), ("debt", "low", "high"), "none").alias("balance_band"), scalars.health("c_acctbal", 7000, 3000).alias("health"), scalars.decode_like("c_name", [(["%1", "%2"], "odd"), (["%9"], "nine")], "rest").alias("name_group"), scalars.strip_prefix("c_name", "Customer#").alias("number"))


@query("b_dates", """SELECT l_orderkey, l_linenumber, CAST(date_diff('day', d, s) AS INTEGER) AS days, CAST(date_diff('month', d, s) AS INTEGER) AS months, s <= d + 30 AS within_30, s >= d AND s < d + INTERVAL 24 MONTH AS in_window,
  CAST(DATE '2002-01-01' - s AS INTEGER) AS age FROM (SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS d, CAST(l_shipdate AS DATE) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def _(t):
    x = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("l_orderkey", "l_linenumber", "cast(o_orderdate as date) d", "cast(l_shipdate as date) s")
    return x.select("l_orderkey", "l_linenumber", scalars.days_between("d", "s").alias("days"), scalars.month_diff("d", "s").alias("months"), scalars.within_days("s", "d", 30).alias("within_30"), scalars.in_month_window("s", "d", 24).alias("in_window"), scalars.age_days("s", "2002-01-01").alias("age"))


@query("c_hub_customer", f"""{_SAT_SQL} SELECT hk_customer, c_custkey AS customer_id, '2024-01-01 00:00:00' AS load_date, 'CUSTOMER' AS record_source FROM c""")
def _(t):
    spec = vault.HubSpec("hk_customer", {"c_custkey": "customer_id"})
    one, two = _customer_loads(t)
    hub = vault.load_hub(one, None, spec)
    return _times_as_text(hub.union(vault.load_hub(two, hub, spec)))


@query("c_link_order_customer", "SELECT md5(concat_ws('||', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR))) AS hk_order_customer, md5(CAST(o_orderkey AS VARCHAR)) AS hk_order, md5(CAST(o_custkey AS VARCHAR)) AS hk_customer FROM orders WHERE o_orderstatus <> 'P'")
def _(t):
    spec = vault.StagingSpec("ORDERS", {"hk_order": ["o_orderkey"], "hk_customer": ["o_custkey"]})
    link = vault.LinkSpec("hk_order_customer", ["o_orderkey", "o_custkey"], ["hk_order", "hk_customer"], "o_orderstatus <> 'P'")
    return vault.load_link(vault.stage(t["orders"], spec, _LOADS[0]), None, link).drop("load_date", "record_source")


@query("c_sat_customer_history", f"{_SAT_SQL} SELECT * FROM sat")
def _(t):
    return _times_as_text(_customer_sat(t).drop("record_source"))


@query("c_current_by_max", f"{_SAT_SQL} SELECT hk_customer, segment, load_date FROM sat QUALIFY rank() OVER (PARTITION BY hk_customer ORDER BY load_date DESC) = 1")
def _(t):
    return _times_as_text(vault.current_by_max(_customer_sat(t), "hk_customer").select("hk_customer", "segment", "load_date"))


@query("c_latest_snapshot", f"{_SAT_SQL} SELECT hk_customer, segment FROM sat WHERE load_date = (SELECT max(load_date) FROM sat)")
def _(t):
    return vault.latest_snapshot(_customer_sat(t)).select("hk_customer", "segment")


@query("c_high_water_mark", "SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderkey % 2 = 0 AND o_orderdate < TIMESTAMP '1998-01-01')")
def _(t):
    return vault.load_hwm(t["orders"], t["orders"].filter("o_orderkey % 2 = 0 AND o_orderdate < timestamp'1998-01-01'"), "o_orderdate").select("o_orderkey")


@query("c_merge", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS p_size FROM part")
def _(t):
    return vault.merge(t["part"].select("p_partkey", "p_size"), t["part"].filter("p_partkey % 3 = 0").selectExpr("p_partkey", "0 AS p_size"), "p_partkey")


@query("c_status_history", """SELECT event_id, user_id, CAST(row_number() OVER w AS INTEGER) AS sequence_no, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS reverse_no,
  date_diff('second', date_trunc('second', ts), date_trunc('second', lead(ts) OVER w)) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(t):
    h = vault.status_history(t["events"], "user_id", "ts", ["event_id"])
    return h.select("event_id", "user_id", "sequence_no", "reverse_no", (F.col("valid_to").cast("timestamp").cast("long") - F.col("ts").cast("timestamp").cast("long")).alias("seconds"))


# --- D to H: relational ----------------------------------------------------------------------------
@query("d_enrich", "SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    dims = {"customer": (t["customer"].withColumnRenamed("c_custkey", "o_custkey"), "o_custkey"), "nation": (t["nation"].withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")}
    return relational.enrich(t["orders"], dims).select("o_orderkey", "c_mktsegment", "n_name")


@query("d_expected_grid", "SELECT a AS c_nationkey, b AS c_mktsegment FROM (SELECT DISTINCT c_nationkey AS a FROM customer), (SELECT DISTINCT c_mktsegment AS b FROM customer) WHERE (a, b) NOT IN (SELECT (c_nationkey, c_mktsegment) FROM customer WHERE c_acctbal > 5000)")
def _(t):
    some = t["customer"].withColumn("c_mktsegment", F.col("c_mktsegment"))
    grid = relational.expected_grid(some.filter("false").unionByName(some), "c_nationkey", "c_mktsegment")
    there = some.filter("c_acctbal > 5000").select("c_nationkey", "c_mktsegment").distinct()
    return grid.union(some.select("c_nationkey", "c_mktsegment").distinct()).join(there, ["c_nationkey", "c_mktsegment"], "left_anti")


@query("d_anti_semi", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def _(t):
    c, o = t["customer"].select("c_custkey"), t["orders"].select(F.col("o_custkey").alias("c_custkey"))
    return relational.semi(c, o, "c_custkey").withColumn("has_orders", F.lit(True)).union(relational.anti(c, o, "c_custkey").withColumn("has_orders", F.lit(False)))


@query("d_orphans", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def _(t):
    return relational.orphans(t["lineitem"].withColumnRenamed("l_orderkey", "k"), t["orders"].filter("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "k"), "k").agg(F.count("*").alias("n"))


@query("d_path_join", "SELECT r_name, count(DISTINCT o_orderkey) AS orders FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    path = [t["region"], t["nation"].withColumnRenamed("n_regionkey", "r_regionkey"), t["customer"].withColumnRenamed("c_nationkey", "n_nationkey"), t["orders"].withColumnRenamed("o_custkey", "c_custkey")]
    return relational.path_join(path, ["r_regionkey", "n_nationkey", "c_custkey"]).groupBy("r_name").agg(F.countDistinct("o_orderkey").alias("orders"))


@query("d_agg_then_join", "SELECT k, n_lines, n_orders FROM (SELECT l_orderkey AS k, count(*) AS n_lines FROM lineitem GROUP BY 1) LEFT JOIN (SELECT o_orderkey AS k, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (k)")
def _(t):
    return relational.agg_then_join(t["lineitem"].withColumnRenamed("l_orderkey", "k"), t["orders"].filter("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "k"), ["k"], [F.count("*").alias("n_lines")], [F.count("*").alias("n_orders")])


@query("e_aggregates", """SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) FILTER (l_discount > 0.05) AS discounted, count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_orderkey END) AS f_orders,
  count(DISTINCT (l_linestatus, l_linenumber)) AS tuples, round(avg(CASE WHEN l_tax > 0.04 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS taxed, bool_or(l_quantity = 50) AS any_50, round(stddev_pop(l_quantity), 6) AS sd,
  round(quantile_cont(l_quantity, 0.25), 6) AS p25, round(sum(l_tax) / sum(l_discount), 6) AS ratio FROM lineitem GROUP BY 1""")
def _(t):
    aggs = [F.count("*").alias("n"), metrics.money("l_extendedprice").alias("total"), relational.count_where(F.col("l_discount") > 0.05).alias("discounted"), relational.distinct_where("l_orderkey", F.col("l_linestatus") == "F").alias("f_orders"), relational.tuple_distinct(["l_linestatus", "l_linenumber"]).alias("tuples"), F.round(relational.rate(F.col("l_tax") > 0.04), 6).alias("taxed"), relational.any_true(F.col("l_quantity") == 50).alias("any_50"), F.round(relational.stddev_pop("l_quantity"), 6).alias("sd"), F.round(relational.quantiles("l_quantity", [0.25])[0], 6).alias("p25"), F.round(relational.ratio_of_sums("l_tax", "l_discount"), 6).alias("ratio")]
    return relational.group(t["lineitem"], ["l_returnflag"], aggs)


@query("e_matrix", "SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS \"BUILDING\", count(*) FILTER (c_mktsegment = 'MACHINERY') AS \"MACHINERY\" FROM customer GROUP BY 1")
def _(t):
    return relational.matrix(t["customer"], "c_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY"], F.count(F.lit(1))).na.fill(0, ["BUILDING", "MACHINERY"])


@query("e_list_agg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS n_name FROM nation GROUP BY 1")
def _(t):
    return relational.list_agg(t["nation"], ["n_regionkey"], "n_name")


@query("f_windows", "SELECT user_id, event_id, CAST(row_number() OVER w AS INTEGER) AS seq, lead(event_type) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    e = relational.next_value(t["events"], "user_id", ["ts", "event_id"], "event_type", "next_type")
    return relational.sequence_numbers(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "seq", "next_type")


@query("f_share_of_total", "SELECT l_returnflag, l_quantity, round(100 * l_quantity / sum(l_quantity) OVER (), 2) AS pct_of_total FROM (SELECT l_returnflag, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1)")
def _(t):
    return relational.share_of_total(t["lineitem"], "l_returnflag", "l_quantity")


@query("f_latest_value", "SELECT o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1")
def _(t):
    return relational.latest_value(t["orders"].withColumn("k", F.struct("o_orderdate", "o_orderkey")), "o_custkey", "k", "o_orderstatus")


@query("g_top_groups", "SELECT o_custkey, q, round(100 * q / sum(q) OVER (), 2) AS pct_of_top_n FROM (SELECT o_custkey, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)")
def _(t):
    x = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).withColumnRenamed("l_quantity", "q")
    return relational.top_groups(x, "o_custkey", "q")


@query("g_top_values", """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INTEGER) AS rank FROM (
  SELECT 'p_brand' AS column_name, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2)) WHERE rank <= 10""")
def _(t):
    return relational.top_values(t["part"], ["p_brand", "p_type"])


@query("g_sample_keys", "SELECT c_custkey FROM (SELECT DISTINCT c_custkey FROM customer) ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 100")
def _(t):
    return relational.sample_keys(t["customer"], ["c_custkey"], 100)


@query("h_value_diff", "SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_left, b.k IS NOT NULL AS in_right FROM (SELECT DISTINCT s_nationkey AS k FROM supplier) a FULL JOIN (SELECT DISTINCT c_nationkey AS k FROM customer) b USING (k)")
def _(t):
    return relational.value_diff(t["supplier"].withColumnRenamed("s_nationkey", "k"), t["customer"].withColumnRenamed("c_nationkey", "k"), "k")


@query("h_calendar", """SELECT d AS date_day, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day, CAST(dayofweek(d) AS INTEGER) AS day_of_week, CAST(weekofyear(d) AS INTEGER) AS week,
  strftime(d, '%Y-%m') AS year_month, concat(year(d), '-Q', quarter(d)) AS year_quarter, lpad(CAST(month(d) AS VARCHAR), 2, '0') AS month_text, dayofweek(d) IN (0, 6) AS is_weekend
FROM (SELECT CAST(unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS DATE) AS d)""")
def _(t):
    ends = t["orders"].agg(F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("date_day")).select("date_day", *scalars.date_parts("date_day"))


@query("i_json", "SELECT event_id, props->>'$.k' AS k, CAST(json_extract_string('[' || props || ',' || props || ']', '$[1].k') AS INTEGER) AS second FROM events")
def _(t):
    twice = F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))
    return t["events"].select("event_id", lists.json_scalar("props", "$.k").alias("k"), lists.json_element(twice, "struct<k:int>", 1)["k"].alias("second"))


# --- A: accounting -----------------------------------------------------------------------------------
@query("a_row_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in ("region", "nation", "customer", "orders", "lineitem")))
def _(t):
    return tables.row_counts({n: t[n] for n in ("region", "nation", "customer", "orders", "lineitem")})


@query("a_dictionary", "SELECT 'supplier' AS table_name, c AS column_name, ty AS data_type, e AS example, CAST(NULL AS VARCHAR) AS description FROM (SELECT 's_suppkey' AS c, 'bigint' AS ty, min(CAST(s_suppkey AS VARCHAR)) AS e FROM supplier UNION ALL SELECT 's_name', 'string', min(s_name) FROM supplier UNION ALL SELECT 's_nationkey', 'int', min(CAST(s_nationkey AS VARCHAR)) FROM supplier)")
def _(t):
    return tables.build_dictionary(t["supplier"].select("s_suppkey", "s_name", "s_nationkey"), "supplier")


@query("a_parity", "SELECT 'orders' AS table_name, count(*) AS left_rows, count(*) FILTER (o_orderkey > 5) AS right_rows, CASE WHEN count(*) = count(*) FILTER (o_orderkey > 5) THEN 'PARITY' ELSE 'DIVERGENT' END AS verdict FROM orders UNION ALL SELECT 'part', count(*), NULL, 'ABSENT' FROM part")
def _(t):
    return tables.parity_audit({"orders": t["orders"], "part": t["part"]}, {"orders": t["orders"].filter("o_orderkey > 5")})


# --- J: profiling ------------------------------------------------------------------------------------
_NULLED = "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders"


def _nulled(t: Tables) -> DataFrame:
    return t["orders"].selectExpr("o_orderkey", "nullif(o_orderstatus, 'P') AS o_orderstatus", "CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS o_custkey")


@query("j_completeness", f"WITH o AS ({_NULLED}), p AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count FROM o" for c in ("o_orderkey", "o_orderstatus", "o_custkey")) + ") SELECT *, round(100.0::DOUBLE * null_count / row_count, 6) AS null_pct, CASE WHEN 100.0 * null_count / row_count < 5 THEN 'high' WHEN 100.0 * null_count / row_count < 25 THEN 'medium' ELSE 'low' END AS reliability FROM p")
def _(t):
    return profile.completeness(_nulled(t))


@query("j_dimensions", f"""WITH o AS (SELECT coalesce(o_orderstatus, '__NULL__') AS v FROM ({_NULLED})) SELECT 'o_orderstatus' AS column_name, v AS value, n, CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS rank, count(*) OVER () AS distinct_count, round(100.0::DOUBLE * n / sum(n) OVER (), 2) AS pct FROM (SELECT v, count(*) AS n FROM o GROUP BY 1)""")
def _(t):
    return profile.dimensions(_nulled(t), ["o_orderstatus"])


@query("j_baseline", "SELECT 'l_quantity' AS column_name, count(l_quantity) AS n, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS avg, round(stddev_pop(l_quantity), 6) AS stddev_pop, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.75) AS p75 FROM lineitem")
def _(t):
    return profile.baseline(t["lineitem"], ["l_quantity"]).withColumns({"avg": F.round("avg", 6), "stddev_pop": F.round("stddev_pop", 6)})


@query("j_segments", " UNION ALL ".join(f"SELECT '{c}' AS column_name, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS p50, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75 FROM part" for c in ("p_partkey", "p_size", "p_retailprice")))
def _(t):
    return profile.segment_thresholds(t["part"].withColumn("constant", F.lit(1)))


@query("j_temporal", "SELECT 'o_orderdate' AS column_name, CAST(min(o_orderdate) AS DATE) AS min_date, CAST(max(o_orderdate) AS DATE) AS max_date, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS INTEGER) AS span_days, CAST(0 AS DOUBLE) AS null_pct, count(DISTINCT date_trunc('month', o_orderdate)) AS months, CAST(greatest(0, date_diff('day', min(o_orderdate), max(o_orderdate)) // 30 + 1 - count(DISTINCT date_trunc('month', o_orderdate))) AS BIGINT) AS gap_months FROM orders")
def _(t):
    return profile.temporal_coverage(t["orders"])


@query("j_foreign_key", "SELECT *, round(1.0::DOUBLE * matched / distinct_keys, 6) AS integrity, CASE WHEN 1.0 * matched / distinct_keys >= 0.95 THEN 'high' WHEN 1.0 * matched / distinct_keys >= 0.8 THEN 'medium' ELSE 'none' END AS confidence FROM (SELECT count(DISTINCT l_partkey) AS distinct_keys, count(DISTINCT CASE WHEN p_partkey IS NOT NULL THEN l_partkey END) AS matched FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 3) ON l_partkey = p_partkey)")
def _(t):
    return profile.foreign_key(t["lineitem"], t["part"].filter("p_partkey % 10 <> 3"), "l_partkey", "p_partkey")


@query("j_relationship_shape", "SELECT *, CASE WHEN left_rows - left_keys >= 2 AND right_rows - right_keys >= 2 THEN 'many_to_many' WHEN left_rows - left_keys >= 2 THEN 'many_to_one' WHEN right_rows - right_keys >= 2 THEN 'one_to_many' ELSE 'one_to_one' END AS shape FROM (SELECT count(*) AS left_rows, count(DISTINCT l_orderkey) AS left_keys FROM lineitem), (SELECT count(*) AS right_rows, count(DISTINCT o_orderkey) AS right_keys FROM orders)")
def _(t):
    return profile.relationship_shape(t["lineitem"], t["orders"], "l_orderkey", "o_orderkey")


_FANOUT = """SELECT count(*) AS sampled, count(*) FILTER (n > 0) AS matched, round(coalesce(avg(CAST(n AS DOUBLE)), 0), 6) AS avg_fanout, max(n) AS max_fanout, round(coalesce(stddev_pop(CAST(n AS DOUBLE)), 0), 6) AS stddev_fanout, count(*) BETWEEN 1 AND 49 AS sample_saturated
FROM (SELECT k, coalesce(n, 0) AS n FROM (SELECT DISTINCT o_orderkey AS k FROM orders ORDER BY md5(CAST(k AS VARCHAR)), k LIMIT 500) LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) USING (k))"""


@query("j_fanout", _FANOUT)
def _(t):
    return profile.measure_fanout(t["orders"].withColumnRenamed("o_orderkey", "k"), t["lineitem"].withColumnRenamed("l_orderkey", "k"), ["k"])


@query("j_grain", "SELECT *, round(1.0::DOUBLE * agreeing / shared_keys, 6) AS match_rate, CASE WHEN 1.0 * agreeing / shared_keys >= 0.99 THEN 'high' WHEN 1.0 * agreeing / shared_keys >= 0.9 THEN 'medium' ELSE 'none' END AS confidence FROM (SELECT count(*) AS shared_keys, count(*) FILTER (abs(a - b) <= 0.01 * abs(a)) AS agreeing FROM (SELECT o_orderkey AS k, sum(o_totalprice) AS a FROM orders GROUP BY 1) JOIN (SELECT l_orderkey AS k, sum(l_extendedprice) AS b FROM lineitem GROUP BY 1) USING (k))")
def _(t):
    return profile.grain_relationship(t["orders"].withColumnRenamed("o_orderkey", "k"), t["lineitem"].withColumnRenamed("l_orderkey", "k"), "k", "o_totalprice", "l_extendedprice")


_REACH = """SELECT '{0}' AS column_name, CAST({0} AS VARCHAR) AS value, count(*) AS total_rows, CAST(coalesce(sum(n), 0) AS BIGINT) AS reachable_rows, coalesce(sum(n), 0) > 0 AS is_reachable, 'success' AS status, NULL AS reason FROM w WHERE {0} IS NOT NULL AND (SELECT count(DISTINCT {0}) FROM orders) <= 700 GROUP BY 2
UNION ALL SELECT '{0}', NULL, NULL, NULL, NULL, 'skipped', 'high_cardinality' WHERE (SELECT count(DISTINCT {0}) FROM orders) > 700"""
_REACHED = ("o_orderstatus", "o_custkey", "o_orderpriority", "o_orderkey")


@query("j_filter_reachability", "WITH w AS (SELECT o.*, n FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1) ON l_orderkey = o_orderkey) " + " UNION ALL ".join(_REACH.format(c) for c in _REACHED))
def _(t):
    return profile.filter_reachability(t["lineitem"].filter("l_orderkey % 3 = 0").withColumnRenamed("l_orderkey", "o_orderkey"), t["orders"], "o_orderkey", _REACHED, 700)


@query("j_profile", "SELECT 'p_size' AS column_name, count(*) AS rows, count(p_size) AS non_null, count(DISTINCT p_size) AS distinct_count, CAST(min(p_size) AS VARCHAR) AS min_value, CAST(max(p_size) AS VARCHAR) AS max_value, round(avg(p_size), 6) AS avg, quantile_cont(CAST(p_size AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(p_size AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(p_size AS DOUBLE), 0.75) AS p75, CAST(100 AS DOUBLE) AS completeness_pct FROM part")
def _(t):
    return profile.profile(t["part"], ["p_size"])


@query("j_value_overlap", "SELECT *, round(1.0::DOUBLE * matched / sampled, 6) AS overlap, 1.0 * matched / sampled >= 0.5 AS is_candidate FROM (SELECT count(*) AS sampled, count(*) FILTER (k IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders)) AS matched FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS k FROM customer ORDER BY md5(k), k LIMIT 200))")
def _(t):
    return profile.value_overlap(t["customer"], t["orders"], "c_custkey", "o_custkey")


@query("j_code_table", "SELECT CAST(c_nationkey AS VARCHAR) AS code, n_name AS description, CASE WHEN n_name IS NULL THEN 'none' ELSE 'nation' END AS description_source, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20 GROUP BY 1, 2, 3")
def _(t):
    return profile.code_table(t["customer"], "c_nationkey", t["nation"].filter("n_nationkey < 20").selectExpr("n_nationkey AS code", "n_name AS description"), "nation")


_MONTHLY = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1"
for _kind, _sql in {
    "overview": "SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, round(avg(o_totalprice), 6) AS avg, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders",
    "by_dimension": "SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1",
    "ranking": "SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "time_trend": _MONTHLY,
    "cumulative": f"SELECT month, total, round(sum(total) OVER (ORDER BY month), 2) AS running_total FROM ({_MONTHLY})",
    "variance": f"SELECT month, total, round(total - lag(total) OVER (ORDER BY month), 2) AS change FROM ({_MONTHLY})",
    "bucketing": "SELECT CAST(o_totalprice >= 100000 AS INTEGER) + CAST(o_totalprice >= 300000 AS INTEGER) AS bucket, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1",
    "part_to_whole": "SELECT o_orderpriority, CAST(s AS DOUBLE) AS o_totalprice, round(100 * CAST(s AS DOUBLE) / CAST(sum(s) OVER () AS DOUBLE), 2) AS pct_of_total FROM (SELECT o_orderpriority, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1)",
}.items():
    query(f"j_lens_{_kind}", _sql)(lambda t, kind=_kind: profile.lens(t["orders"], kind, "o_totalprice", "o_orderpriority", "o_orderdate", (100_000, 300_000)))


# --- K: quality --------------------------------------------------------------------------------------
@query("k_assertions", "SELECT *, CASE WHEN violations = 0 THEN 'pass' WHEN severity = 'warn' THEN 'warn' ELSE 'fail' END AS status FROM (SELECT 'order value' AS test, 'warn' AS severity, count(*) AS violations FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'status known', 'error', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'customer exists', 'error', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'line unique', 'warn', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))")
def _(t):
    return quality.run_assertions({
        "order value": (quality.expression_true(t["orders"], "o_totalprice <= 400000"), "warn"),
        "status known": (quality.accepted_values(t["orders"], "o_orderstatus", ["F", "O"]), "error"),
        "customer exists": (quality.relationships(t["orders"], "o_custkey", t["customer"], "c_custkey"), "error"),
        "line unique": (quality.grain_unique(t["lineitem"], ["l_orderkey", "l_linenumber"]), "warn"),
    })


@query("k_unique_where", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return quality.unique_where(t["customer"], ["c_nationkey", "c_mktsegment"], "c_acctbal > 9000")


@query("k_source_quality", f"WITH o AS ({_NULLED}) SELECT 'orders' AS table_name, round((100.0 + 100.0 * count(o_orderstatus) / count(*) + 100.0 * count(o_custkey) / count(*)) / 3, 6) AS avg_completeness, CASE WHEN (100.0 + 100.0 * count(o_orderstatus) / count(*) + 100.0 * count(o_custkey) / count(*)) / 3 >= 95 THEN 'healthy' WHEN (100.0 + 100.0 * count(o_orderstatus) / count(*) + 100.0 * count(o_custkey) / count(*)) / 3 >= 80 THEN 'review' ELSE 'low' END AS quality FROM o")
def _(t):
    return quality.source_quality({"orders": _nulled(t)}).select("table_name", "avg_completeness", "quality")


@query("k_drift", """WITH old AS (SELECT c_mktsegment AS g, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS a FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1), new AS (SELECT c_mktsegment AS g, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS b FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1)
SELECT *, CASE WHEN changed = 0 THEN 'no_drift' WHEN new_groups > 0 OR top_shift > 5 THEN 'material' ELSE 'noise' END AS drift FROM (SELECT count(*) FILTER (a IS NULL) AS new_groups, count(*) FILTER (a IS DISTINCT FROM b) AS changed, round(abs(max(a) - max(b)), 6) AS top_shift FROM old FULL JOIN new USING (g))""")
def _(t):
    share = lambda df: relational.share_of_total(df.withColumn("one", F.lit(1)), "c_mktsegment", "one").select("c_mktsegment", F.col("pct_of_total").alias("share"))
    return quality.classify_drift(share(t["customer"].filter("c_mktsegment <> 'MACHINERY'")), share(t["customer"].filter("c_custkey % 2 = 0")), "c_mktsegment", "share").withColumn("top_shift", F.round("top_shift", 6))


# --- M, O ----------------------------------------------------------------------------------------------
@query("m_pipeline_summary", "SELECT name, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT 'staging' AS name, count(*) AS n FROM orders UNION ALL SELECT 'marts', count(*) FROM lineitem)")
def _(t):
    return lineage.pipeline_summary({"staging": t["orders"], "marts": t["lineitem"]})


@query("o_billing_schedule", "SELECT k AS device_id, CAST(unnest(generate_series(date_trunc('month', a), e, INTERVAL 1 MONTH)) AS DATE) AS bill_month FROM (SELECT o_orderkey AS k, o_orderdate AS a, least(date_trunc('month', o_orderdate) + INTERVAL 5 MONTH, TIMESTAMP '1998-06-01', CASE WHEN o_orderstatus = 'F' THEN date_trunc('month', o_orderdate + INTERVAL 100 DAY) - INTERVAL 1 MONTH END) AS e FROM orders) WHERE date_trunc('month', a) <= e")
def _(t):
    devices = t["orders"].selectExpr("o_orderkey AS device_id", "cast(o_orderdate AS date) AS deployed_on", "CASE WHEN o_orderstatus = 'F' THEN date_add(cast(o_orderdate AS date), 100) END AS returned_on")
    return derive.billing_schedule(devices, 6, "1998-06-01").select("device_id", "bill_month")


@query("o_stock_from_movements", f"{FRAMES_SQL} SELECT material_id, plant, greatest(0, sum(signed_quantity)) AS stock FROM movements GROUP BY 1, 2")
def _(t):
    return derive.stock_from_movements(metrics.goods_movements(frames(t.spark, t.sf_dir)))


@query("o_journal_billing", "SELECT document_id, line_no, side, account, CAST(amount AS DOUBLE) AS amount FROM (SELECT o_orderkey AS document_id, CAST(o_totalprice AS DECIMAL(18,2)) AS a, CAST(CAST(o_totalprice AS DECIMAL(15,2)) * CAST(0.19 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS x FROM orders WHERE o_orderstatus <> 'P'), LATERAL (SELECT 1 AS line_no, 'S' AS side, 'receivable' AS account, a + x AS amount UNION ALL SELECT 2, 'H', 'revenue', a UNION ALL SELECT 3, 'H', 'tax', x)")
def _(t):
    heads = t["orders"].selectExpr("o_orderkey AS document_id", "cast(o_totalprice AS decimal(18,2)) AS net", "cast(cast(o_totalprice AS decimal(15,2)) * cast(0.19 AS decimal(3,2)) AS decimal(18,2)) AS tax", "o_orderstatus = 'P' AS cancelled")
    return derive.journal_from_billing(heads).withColumn("amount", F.col("amount").cast("double"))


@query("o_journal_balanced", "SELECT CAST(0 AS BIGINT) AS unbalanced, count(*) AS documents FROM orders WHERE o_orderstatus <> 'P'")
def _(t):
    heads = t["orders"].selectExpr("o_orderkey AS document_id", "o_totalprice AS net", "round(o_totalprice * 0.19D, 2) AS tax", "o_orderstatus = 'P' AS cancelled")
    lines = derive.journal_from_billing(heads)
    bad = derive.journal_balanced(lines).agg(F.count("*").alias("unbalanced"))
    return bad.crossJoin(lines.agg(F.countDistinct("document_id").alias("documents")))


@query("o_round_robin", "SELECT o.o_orderkey, s.s_suppkey FROM (SELECT o_orderkey, c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) - 1 AS i FROM orders JOIN customer ON o_custkey = c_custkey) o JOIN (SELECT s_suppkey, s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS j, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) s ON o.k = s.k AND o.i % s.n = s.j")
def _(t):
    a = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).selectExpr("o_orderkey", "c_nationkey AS k")
    return derive.round_robin_pair(a, t["supplier"].selectExpr("s_suppkey", "s_nationkey AS k"), "k", "o_orderkey", "s_suppkey").select("o_orderkey", "s_suppkey")


# --- more profiling and gates over the driver's tables ------------------------------------------------
@query("j_sum_match", "SELECT count(*) AS compared, count(*) FILTER (CAST(o_totalprice AS DECIMAL(18,2)) = s) AS matched FROM orders JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(t):
    money = lambda df, k, c: df.select(F.col(k).alias("k"), F.col(c).cast("decimal(18,2)").alias("m"))
    return profile.sum_match_exact(money(t["orders"], "o_orderkey", "o_totalprice"), money(t["lineitem"], "l_orderkey", "l_extendedprice"), "k", "m")


@query("j_bridge_fanout", """SELECT count(*) AS sampled, count(*) FILTER (n > 0) AS matched, round(coalesce(avg(CAST(n AS DOUBLE)), 0), 6) AS avg_fanout, CAST(max(n) AS BIGINT) AS max_fanout, round(coalesce(stddev_pop(CAST(n AS DOUBLE)), 0), 6) AS stddev_fanout, count(*) BETWEEN 1 AND 49 AS sample_saturated
FROM (SELECT k, coalesce(n, 0) AS n FROM (SELECT DISTINCT c_custkey AS k FROM customer ORDER BY md5(CAST(k AS VARCHAR)), k LIMIT 500) LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) USING (k))""")
def _(t):
    return profile.measure_bridge(t["customer"].withColumnRenamed("c_custkey", "k"), t["orders"].selectExpr("o_custkey AS k", "o_orderkey AS j"), t["lineitem"].withColumnRenamed("l_orderkey", "j"), "k", "j")


@query("j_month_gaps", "SELECT CAST(m AS DATE) AS month FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders WHERE month(o_orderdate) <> 2) WHERE m NOT IN (SELECT date_trunc('month', o_orderdate) FROM orders WHERE month(o_orderdate) <> 2)")
def _(t):
    return profile.month_gaps(t["orders"].filter("month(o_orderdate) <> 2"), "o_orderdate")


@query("k_contracts", f"WITH o AS ({_NULLED}) SELECT 'orders' AS source_table, 80.0::DOUBLE AS completeness_threshold_pct, round(100 - 100.0::DOUBLE * greatest(count(*) - count(o_orderstatus), count(*) - count(o_custkey)) / count(*), 6) AS min_completeness_pct, CASE WHEN 100 - 100.0 * greatest(count(*) - count(o_orderstatus), count(*) - count(o_custkey)) / count(*) >= 80 THEN 'PASS' ELSE 'BREACH' END AS verdict FROM o UNION ALL SELECT 'absent', 80, NULL, 'UNKNOWN'")
def _(t):
    contracts = t.spark.createDataFrame([("orders", 80.0), ("absent", 80.0)], "source_table string, completeness_threshold_pct double")
    return quality.check_contracts({"orders": _nulled(t)}, contracts).select("source_table", "completeness_threshold_pct", "min_completeness_pct", "verdict")


@query("k_stale_in_state", "SELECT event_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 24 HOUR")
def _(t):
    return quality.stale_in_state(t["events"], "event_type", "signup", "ts", 24, "2024-01-05 00:00:00").select("event_id")


@query("k_staging_parity", "SELECT count(*) AS raw_rows, count(*) FILTER (o_orderkey % 11 <> 0) AS staged_rows, CASE WHEN count(*) = count(*) FILTER (o_orderkey % 11 <> 0) THEN 'pass' ELSE 'fail' END AS status FROM orders")
def _(t):
    return quality.staging_parity(t["orders"], t["orders"].filter("o_orderkey % 11 <> 0"))


@query("o_stock_and_journal", f"{FRAMES_SQL} SELECT side, account, count(*) AS n, CAST(sum(CASE WHEN amount > 0 THEN CAST(amount AS DECIMAL(18,2)) ELSE 1 END) AS DOUBLE) AS total FROM (SELECT quantity AS amount FROM movements), (VALUES ('S', 'stock'), ('H', 'clearing')) v(side, account) GROUP BY 1, 2")
def _(t):
    lines = derive.journal_from_movements(frames(t.spark, t.sf_dir)["movements"].withColumnRenamed("quantity", "amount"))
    return lines.groupBy("side", "account").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query("c_conversation_versions", "SELECT conv_id, CAST(turn AS INTEGER) AS version, turn = max(turn) OVER (PARTITION BY conv_id) AS is_current FROM conversations")
def _(t):
    c = t["conversations"].select("conv_id", F.col("turn").cast("int").alias("version"), F.col("turn").alias("load_date"))
    newest = vault.current_by_max(c, "conv_id").select("conv_id", "version", F.lit(True).alias("is_current"))
    return c.join(newest, ["conv_id", "version"], "left").select("conv_id", "version", F.coalesce("is_current", F.lit(False)).alias("is_current"))
