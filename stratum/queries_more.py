"""Registered queries of stored tables, comparisons, sketches, scans and the smaller operators, on rows that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions import lists, scalars
from stratum.operators import compare, evidence, quality, quantile, relational, scan, sketches, stored, value_index, vault
from stratum.plans import derive, metrics
from stratum.queries import query
from stratum.queries_store import _KEYED, _ways, _stripped
from stratum.sources import tables
from stratum.sources.scratch import new_folder


# --- stored tables ---------------------------------------------------------------------------------


@query("c_stored_loads", """WITH one AS (SELECT DISTINCT o_custkey AS k, o_orderstatus AS s FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01'), two AS (SELECT DISTINCT o_custkey AS k, o_orderstatus AS s FROM orders)
SELECT 'hub' AS object, CASE WHEN k IN (SELECT k FROM one) THEN '2024-01' ELSE '2024-02' END AS loaded, count(*) AS n FROM (SELECT DISTINCT k FROM two) GROUP BY 2
UNION ALL SELECT 'sat', CASE WHEN (k, s) IN (SELECT (k, s) FROM one) THEN '2024-01' ELSE '2024-02' END, count(*) FROM two GROUP BY 2""")
def _(t):
    hub, sat = vault.HubSpec("hk_customer", {"o_custkey": "customer_number"}), vault.SatSpec("hk_customer", {"o_orderstatus": "status"}, distinct=True)
    out = []
    folder = new_folder(t.spark, "vault")
    name = "stored_" + folder.rsplit("-", 1)[-1]
    try:
        for where, day in (("o_orderdate < timestamp'1995-01-01'", "2024-01-01"), ("true", "2024-02-01")):
            stage = t["orders"].filter(where).select(scalars.hash_key("o_custkey").alias("hk_customer"), "o_custkey", "o_orderstatus", scalars.hashdiff("o_orderstatus").alias("hashdiff"), F.lit(day).cast("timestamp").alias("load_date"), F.lit("orders").alias("record_source"))
            stored.store_hub(stage, hub, f"{name}_hub", f"{folder}/hub", 16)
            stored.store_sat(stage, sat, f"{name}_sat", f"{folder}/sat", 16)
        for object_ in ("hub", "sat"):
            rows = t.spark.read.parquet(f"{folder}/{object_}")
            out.append(rows.groupBy(F.lit(object_).alias("object"), F.date_format("load_date", "yyyy-MM").alias("loaded")).agg(F.count("*").alias("n")))
    finally:
        for object_ in ("hub", "sat"):
            t.spark.sql(f"DROP TABLE IF EXISTS {name}_{object_}")  # the files, of an external table, stay
    return out[0].union(out[1])


@query("c_stored_merge", "SELECT k, CAST(CASE WHEN k % 40 = 3 THEN 2 ELSE 1 END AS INTEGER) AS load, CASE WHEN k % 40 = 3 THEN 'X' ELSE s END AS status FROM (SELECT o_orderkey AS k, max(o_orderstatus) AS s FROM orders GROUP BY 1)")
def _(t):
    path = new_folder(t.spark, "merged")
    rows = lambda load, status: t["orders"].select(F.col("o_orderkey").alias("k"), F.lit(load).alias("load"), status.alias("status"), F.make_timestamp(F.lit(2024), F.lit(load), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("load_date"))
    stored.merge_stored(rows(1, F.col("o_orderstatus")), ["k"], path)
    return stored.merge_stored(rows(2, F.lit("X")).filter("k % 40 = 3"), ["k"], path).select("k", "load", "status")


@query("k_table_diff", """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_custkey, o_orderstatus) = 1)
SELECT k, 'missing' AS change FROM o WHERE k % 500 = 7 UNION ALL SELECT k, 'changed' FROM o WHERE k % 500 = 8 UNION ALL SELECT -k, 'added' FROM o WHERE k % 500 = 9""")
def _(t):
    old = t["orders"].groupBy(F.col("o_orderkey").alias("k")).agg(F.min(F.struct("o_custkey", "o_orderstatus")).alias("x")).select("k", F.col("x.o_custkey").alias("c"), F.col("x.o_orderstatus").alias("s"))
    new = old.filter("k % 500 <> 7").withColumn("s", F.when(F.col("k") % 500 == 8, F.concat("s", F.lit("!"))).otherwise(F.col("s")))
    new = new.union(old.filter("k % 500 = 9").withColumn("k", -F.col("k")))
    paths = [new_folder(t.spark, "version") for _ in range(2)]
    for df, path in zip((old, new), paths, strict=True):
        compare.bucketed(df, ["k"], path)
    return compare.changed_keys(t.spark, *paths, ["k"])


# --- sketches, quantiles, scans ----------------------------------------------------------------------
@query("e_approx_distinct", "SELECT 'l_orderkey' AS column_name, count(DISTINCT l_orderkey) > 0 AS is_close, count(*) AS rows FROM lineitem UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) > 0, count(*) FROM lineitem UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) > 0, count(*) FROM lineitem")
def _(t):
    """Estimates of sketches of three parts, united, against exact counts; and E13's own estimate."""
    line, columns = t["lineitem"], ["l_orderkey", "l_partkey", "l_shipdate"]
    parts = {f"p{i}": f"pmod(coalesce(l_linenumber, 0), 3) = {i}" for i in range(3)}
    empty = sketches.sketched(line.limit(0), "none", columns)
    found = sketches.united(sketches.refreshed(empty, line, "lineitem", columns, parts).filter("table_name = 'lineitem'"))
    exact = relational.profile_stack(line, {c: {"exact": F.countDistinct(c)} for c in columns})
    rough = relational.approx_distinct(line, columns).select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("rough")) for c in columns))))
    exact = exact.join(rough, "column_name")
    near = lambda c: F.abs(F.col(c) - F.col("exact")) <= 0.1 * F.col("exact") + 1
    return found.join(exact, "column_name").select("column_name", (near("estimate") & near("rough") & (F.col("exact") > 0)).alias("is_close"), "rows")


@query("j_sketch_keys", "SELECT 'customer' AS table_name, 'c_custkey' AS key WHERE (SELECT count(*) = count(DISTINCT c_custkey) FROM customer) UNION ALL SELECT 'customer', 'c_name' WHERE (SELECT count(*) = count(DISTINCT c_name) FROM customer) UNION ALL SELECT 'part', 'p_partkey' WHERE (SELECT count(*) = count(DISTINCT p_partkey) FROM part) UNION ALL SELECT 'lineitem', 'l_orderkey,l_linenumber' WHERE (SELECT count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem)")
def _(t):
    asked = {"customer": ["c_custkey", "c_name", "c_nationkey"], "part": ["p_partkey", "p_brand"], "lineitem": ["l_orderkey", ["l_orderkey", "l_linenumber"]]}
    found = []
    for name, columns in asked.items():
        found += [(name, key) for key in sketches.confirmed_keys(t[name], sketches.able_keys(sketches.sketched(t[name], name, columns)))]
    return t.spark.createDataFrame(found, "table_name string, key string")


@query("e_quantiles_by_ranges", " UNION ALL ".join(f"SELECT '{c}' AS column_name, quantile_cont(CAST({c} AS DOUBLE), 0.01) AS p01, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS p50, quantile_cont(CAST({c} AS DOUBLE), 0.999) AS p999 FROM lineitem" for c in ("l_extendedprice", "l_quantity", "l_partkey")))
def _(t):
    """At most a twentieth of the rows is sorted together, as for a large table."""
    return quantile.quantile_rows(t["lineitem"], ["l_extendedprice", "l_quantity", "l_partkey"], {"p01": 0.01, "p50": 0.5, "p999": 0.999}, most=max(100, t["lineitem"].count() // 20))


@query("f_scan_sums", "SELECT o_orderkey, o_custkey, k, CAST(sum(k) OVER (ORDER BY o_orderkey, o_custkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, row_number() OVER (ORDER BY o_orderkey, o_custkey) AS n FROM (SELECT DISTINCT o_orderkey, o_custkey, o_custkey % 10 AS k FROM orders)")
def _(t):
    rows = t["orders"].selectExpr("o_orderkey", "o_custkey", "o_custkey % 10 AS k").distinct()
    return scan.numbered(relational.running_sum(rows, ["o_orderkey", "o_custkey"], "k"), ["o_orderkey", "o_custkey"], "n")


@query("k_joins_from_profile", f"SELECT left_table, right_table, key AS join_key, CASE WHEN fanout_class = 'catastrophic_fanout' AND safe_direction IS NULL THEN 'reject' ELSE 'accept' END AS verdict FROM (SELECT *, split_part(direction, '->', 1) AS left_table, split_part(direction, '->', 2) AS right_table FROM ({' UNION ALL '.join(f'({_ways(*x)})' for x in _KEYED)})) WHERE is_top")
def _(t):
    """K17 on what J27 measured, not on verdicts made up."""
    frames = _stripped(t)
    swept = value_index.sweep_pairs({n: frames[n] for n in ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")}).filter("is_top")
    side = F.split("direction", "->")
    found = swept.select(side[0].alias("left_table"), side[1].alias("right_table"), F.col("key").alias("join_key"), "fanout_class", F.coalesce("safe_direction", F.lit("none")).alias("safe_direction"), F.lit(None).cast("string").alias("bridge_table"), (F.col("matched") / F.col("sampled")).alias("matched_ratio"))
    return quality.check_joins(found.select("left_table", "right_table", "join_key"), found).select("left_table", "right_table", "join_key", "verdict")


# --- audit with planted violations --------------------------------------------------------------------
@query("k_vault_planted", """WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders), n AS (SELECT count(*) FILTER (k % 300 = 1) AS twice, count(*) FILTER (k % 300 = 2) AS bad, count(*) FILTER (k % 300 = 3) AS gone, count(*) FILTER (k % 300 = 4) AS same FROM o)
SELECT "check", object, CAST(violations AS BIGINT) AS violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
SELECT 'V1 key unique' AS "check", 'hub' AS object, twice AS violations FROM n UNION ALL SELECT 'V6 hash shape', 'hub', bad FROM n UNION ALL SELECT 'V1 key unique', 'link', 0 UNION ALL SELECT 'V6 hash shape', 'link', 0
UNION ALL SELECT 'V2 structure', 'hub', 0 UNION ALL SELECT 'V2 structure', 'link', 1 UNION ALL SELECT 'V2 structure', 'sat', 0 UNION ALL SELECT 'V4 hk in hub', 'link', gone + bad FROM n UNION ALL SELECT 'V5 hk in hub', 'sat', gone + bad FROM n UNION ALL SELECT 'V7 history unique', 'sat', same FROM n)""")
def _(t):
    """Keys that stand twice, hashes that are none, orphans, a missing column and a version stored twice: each is found."""
    keys = t["orders"].select(F.col("o_orderkey").alias("k")).distinct()
    meta = lambda df, *more: df.select(*more, F.lit("s").alias("record_source"), F.current_timestamp().alias("load_date"))
    hk = scalars.hash_key("k").alias("hk")
    hub = keys.filter("k % 300 <> 3").withColumn("hk", F.when(F.col("k") % 300 == 2, F.concat(F.lit("!"), F.col("k").cast("string"))).otherwise(scalars.hash_key("k")))
    hub = meta(hub.union(hub.filter("k % 300 = 1")), "hk", "k")
    link = keys.select(scalars.hash_key("k", F.lit("l")).alias("lk"), hk, F.current_timestamp().alias("load_date"))
    sat = meta(keys.union(keys.filter("k % 300 = 4")), hk, F.md5(F.lit("x")).alias("hashdiff"))
    return quality.vault_audit({"hub": hub, "link": link, "sat": sat}, {"hub": "hk"}, {"link": ("lk", {"hk": "hub"})}, {"sat": ("hk", "hub")})


# --- the smaller operators ---------------------------------------------------------------------------
@query("b_names", "SELECT o_orderkey AS order_number, concat(o_custkey, o_orderstatus) AS reference_key, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE o_orderstatus END AS status FROM orders")
def _(t):
    df = vault.stage_passthrough(scalars.rename(t["orders"], {"o_orderkey": "order_number"}))
    return df.select("order_number", scalars.concat_key("o_custkey", "o_orderstatus").alias("reference_key"), scalars.or_bucket(F.nullif(F.col("o_orderstatus"), F.lit("P")), "unknown").alias("status"))


@query("d_inner", "SELECT 'customer' AS partner, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'line', count(*) FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def _(t):
    one = relational.inner(t["orders"].withColumnRenamed("o_custkey", "k"), t["customer"].withColumnRenamed("c_custkey", "k"), "k")
    two = relational.inner(t["lineitem"], t["lineitem"].filter("l_quantity > 25").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])
    return relational.stack_counts({"customer": one, "line": two}).toDF("partner", "n")


@query("i_elements", """SELECT p_partkey, pos, b, payload FROM (SELECT p_partkey, CAST(0 AS INTEGER) AS pos, p_brand AS b, concat('{"p_brand":"', p_brand, '","p_size":', p_size, '}') AS payload FROM part WHERE p_size % 4 > 0 UNION ALL SELECT p_partkey, 1, p_type, concat('{"p_brand":"', p_brand, '","p_size":', p_size, '}') FROM part WHERE p_size % 4 > 0 UNION ALL SELECT p_partkey, NULL, NULL, concat('{"p_brand":"', p_brand, '","p_size":', p_size, '}') FROM part WHERE p_size % 4 = 0)""")
def _(t):
    text = F.when(F.col("p_size") % 4 == 0, "[]").otherwise(F.concat(F.lit('[{"b":"'), "p_brand", F.lit('"},{"b":"'), "p_type", F.lit('"}]')))
    rows = lists.json_rows(t["part"].withColumn("j", text).withColumn("payload", lists.to_payload("p_brand", "p_size")), "j", "struct<b:string>")
    return rows.select("p_partkey", "pos", F.col("element.b").alias("b"), "payload")


@query("i_list_rows", "SELECT p_partkey, unnest([p_brand, p_type]) AS item FROM part")
def _(t):
    return lists.list_rows(t["part"].withColumn("l", F.concat("p_brand", F.lit(" ,, "), "p_type", F.lit(","))), "l").select("p_partkey", "item")


@query("l_skipped", "SELECT 'magnitude-r1' AS id, 'magnitude' AS analysis_type, 'skipped' AS status, t AS source_tables, '{\"reason\":\"fewer than 10 rows\"}' AS result_json FROM (SELECT 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'part', count(*) FROM part) WHERE n < 10")
def _(t):
    few = [r.table_name for r in tables.row_counts({n: t[n] for n in ("nation", "region", "part")}).collect() if r.row_count < 10]
    rows = evidence.skipped_row(t.spark, "magnitude", few, "fewer than 10 rows", "r1", "2024-01-01")
    return rows.filter(F.lit(bool(few))).select("id", "analysis_type", "status", F.explode(F.split("source_tables", ",")).alias("source_tables"), "result_json")


@query("dim_date", """SELECT CAST(d AS DATE) AS date_day, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day, CAST(dayofweek(d) AS INTEGER) AS day_of_week, CAST(weekofyear(d) AS INTEGER) AS week, strftime(d, '%Y-%m') AS year_month, concat(year(d), '-Q', quarter(d)) AS year_quarter, strftime(d, '%m') AS month_text, dayofweek(d) IN (0, 6) AS is_weekend
FROM (SELECT unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), INTERVAL 1 DAY)) AS d FROM orders)""")
def _(t):
    first, last = t["orders"].agg(F.min("o_orderdate").cast("date").cast("string"), F.max("o_orderdate").cast("date").cast("string")).first()
    return metrics.dim_date(t.spark, first, last)


@query("o_deployed_devices", """WITH m AS (SELECT CAST(l_partkey AS VARCHAR) AS device_id, l_suppkey % 3 AS material_id, CAST(l_shipdate AS DATE) AS d, l_returnflag AS f FROM lineitem), o AS (SELECT device_id, material_id, min(d) AS deployed_on FROM m WHERE f = 'N' GROUP BY 1, 2)
SELECT o.device_id, o.material_id, deployed_on, (SELECT min(d) FROM m WHERE f = 'R' AND m.device_id = o.device_id AND d > deployed_on) AS returned_on FROM o""")
def _(t):
    items = t["lineitem"].selectExpr("concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', l_shipdate, '-', l_extendedprice, l_returnflag) AS document_id", "CASE l_returnflag WHEN 'N' THEN '201' WHEN 'R' THEN '202' END AS movement_type", "concat('SN:', l_partkey) AS item_text", "l_suppkey % 3 AS material_id", "cast(l_shipdate AS date) AS posting_date").distinct()
    return derive.deployed_devices(items.drop("posting_date"), items.select("document_id", "posting_date"))


@query("o_journal_invoices", """WITH i AS (SELECT l_orderkey AS d, l_linenumber AS n, CAST(l_extendedprice AS DECIMAL(18,2)) AS a FROM lineitem)
SELECT d AS document_id, side, account, CAST(a AS DOUBLE) AS amount, CAST(row_number() OVER (PARTITION BY d ORDER BY n, a) AS INTEGER) AS line_no FROM (SELECT d, 'S' AS side, 'goods' AS account, a, CAST(n AS BIGINT) AS n FROM i UNION ALL SELECT d, 'H', 'vendor', CAST(sum(a) AS DECIMAL(18,2)), 2147483647 FROM i WHERE d IN (SELECT o_orderkey FROM orders) GROUP BY 1)""")
def _(t):
    items = t["lineitem"].selectExpr("l_orderkey AS document_id", "l_linenumber AS item_no", "l_extendedprice AS amount")
    heads = t["orders"].select(F.col("o_orderkey").alias("document_id")).distinct()
    return derive.journal_from_invoices(heads, items).select("document_id", "side", "account", F.col("amount").cast("double").alias("amount"), "line_no")


@query("o_unpivot_status", "SELECT o_orderkey AS device_id, 'received' AS status, CAST(o_orderdate AS DATE) AS status_date FROM orders UNION ALL SELECT o_orderkey, 'deployed', CAST(o_orderdate AS DATE) + 10 FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'returned', CAST(o_orderdate AS DATE) + 90 FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    day = F.col("o_orderdate").cast("date")
    wide = t["orders"].select(F.col("o_orderkey").alias("device_id"), day.alias("received_on"), F.when(F.col("o_orderstatus") != "P", F.date_add(day, 10)).alias("deployed_on"), F.when(F.col("o_orderstatus") == "F", F.date_add(day, 90)).alias("returned_on"), F.lit(None).cast("date").alias("returned_to_vendor_on"))
    return derive.unpivot_status(wide)


@query("a_layers", "SELECT 'nation' AS table_name, count(*) AS row_count, sum(n_nationkey)::BIGINT AS keys, 'supplier' AS pruned FROM nation UNION ALL SELECT 'seed', count(*), sum(n_nationkey)::BIGINT, 'supplier' FROM nation")
def _(t):
    """A seed written as CSV and read by its schema, a layer exported, pruned, registered and counted."""
    root = new_folder(t.spark, "layers")
    t["nation"].write.option("header", True).csv(f"{root}/seed.csv")
    seed = tables.read_seed(t.spark, f"{root}/seed.csv", t["nation"].schema)
    quality.require_nonempty({"nation": t["nation"], "seed": seed})
    tables.assert_min_rows({"seed": seed}, {"seed": 5})
    tables.export_layer({"nation": t["nation"], "supplier": t["supplier"]}, f"{root}/layer")
    gone = tables.prune_stale(t.spark, f"{root}/layer", ["nation"])
    live = tables.register_layer(t.spark, f"{root}/layer", "checked", ["nation", "supplier"])
    one = lambda name, df: df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"), F.sum("n_nationkey").cast("long").alias("keys"))
    return one("nation", live["nation"]).union(one("seed", seed)).withColumn("pruned", F.lit(",".join(gone)))
