import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratum.operators import profile, quality
from stratum.plans import metrics, shop
from stratum.sources import tables


def test_seeds_layers_and_exports(spark, tmp_path):
    (tmp_path / "seed.csv").write_text('id,name,day\n1,"a ""b"", c",2024-01-02\n2,,2024-01-03\n')
    inferred = tables.read_seed(spark, f"{tmp_path}/seed.csv")
    assert dict(inferred.dtypes)["id"] == "int" and inferred.filter("name is null").count() == 1
    typed = tables.read_seed(spark, f"{tmp_path}/seed.csv", "id long, name string, day date")
    assert [tuple(r) for r in typed.orderBy("id").collect()] == [(1, 'a "b", c', dt.date(2024, 1, 2)), (2, None, dt.date(2024, 1, 3))]
    with pytest.raises(ValueError, match="too few rows"):
        tables.assert_min_rows({"seed": typed}, {"seed": 3})
    tables.assert_min_rows({"seed": typed}, {"seed": 2})

    root = f"{tmp_path}/layer"
    tables.export_layer({"one": typed, "two": inferred}, root)
    assert set(tables.register_layer(spark, root, "raw", ["one", "two", "gone"])) == {"one", "two"}
    assert spark.table("raw_one").count() == 2 and not spark.catalog.tableExists("raw_gone")
    assert tables.prune_stale(spark, root, ["one"]) == ["two"]
    assert set(tables.register_layer(spark, root, "raw", ["one", "two"])) == {"one"} and not spark.catalog.tableExists("raw_two")


def test_fingerprints_logs_and_guards(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "id int, v string")
    same, other = tables.content_hash(a.orderBy(F.desc("id"))).first(), tables.content_hash(a.filter("id < 2").union(a.filter("id = 2").limit(1))).first()
    assert tables.content_hash(a).first() == same != other
    hashes = {r.combined_hash for r in tables.export_manifest({"a": a, "b": a}).collect()}
    assert len(hashes) == 1
    log = spark.createDataFrame([], "run_id string, started_at_utc timestamp, finished_at_utc timestamp, row_count_total long, tables_touched string")
    row = tables.log_ingestion(log, "r", "2024-01-01 00:00:00", "2024-01-01 00:00:10", {"b": a, "a": a}).first()
    assert (row.row_count_total, row.tables_touched) == (6, "a,b")
    with pytest.raises(ValueError, match="floor"):
        tables.assert_safe_write(a, a.limit(0), floor=1)
    with pytest.raises(ValueError, match="would go"):
        tables.assert_safe_write(a, a.limit(1), most_deleted=1)
    tables.assert_safe_write(a, a, floor=3, most_deleted=0)
    with pytest.raises(ValueError, match="no rows"):
        quality.require_nonempty({"a": a, "none": a.limit(0)})


def test_fanout_counts_keys_without_partners(spark):
    small, large = spark.range(100).selectExpr("id AS k"), spark.range(32).selectExpr("id % 16 AS k")
    row = profile.measure_fanout(small, large, ["k"]).withColumn("c", profile.classify_fanout()).first()
    assert (row.sampled, row.matched, row.avg_fanout, row.max_fanout) == (100, 16, 0.32, 2) and row.c == "no_signal"


def test_freshness_gate(spark):
    facts = spark.createDataFrame([("active", True, 30, "A, b", "2024-01-10"), ("active", True, 30, "gone", "2023-01-01"), ("retired", True, 30, "b", "2022-01-01"), ("active", True, None, "b", "2022-01-01")], "status string, auto_inject boolean, stale_after_days int, scope_tables string, evidence_refreshed_at string").withColumn("evidence_refreshed_at", F.col("evidence_refreshed_at").cast("timestamp"))
    live = spark.createDataFrame([("a",), ("B",)], "table_name string")
    at = lambda day: spark.createDataFrame([(day,)], "d string").select(F.col("d").cast("timestamp").alias("finished_at_utc"))
    state = lambda f, log: tuple(quality.freshness_gate(f, log, live).select("state", "gap_days", "write_blocked").first())
    assert state(facts, at("2024-01-13")) == ("green", 3, False) and state(facts, at("2024-01-20")) == ("yellow", 10, False) and state(facts, at("2024-02-20")) == ("red", 41, True)
    assert state(facts, at("2023-12-01")) == ("green", 0, False) and state(facts.limit(0), at("2024-02-20")) == ("green", 0, False)
    assert state(facts, at("2024-02-20").limit(0)) == ("no_baseline", None, True)


def test_second_source_takes_newer_rows_only(spark):
    raw = lambda rows: {"orders": spark.createDataFrame(rows, "order_id string, customer_id string, order_status string, order_purchase_timestamp string, order_approved_at string, order_delivered_carrier_date string, order_delivered_customer_date string, order_estimated_delivery_date string")}
    row = lambda i, status, day: (i, "c", status, day, None, None, None, "not a date")
    one = shop.load_shop(raw([row("1", "new", "2024-01-01 00:00:00"), row("2", "new", "2024-01-05 00:00:00")]), "2024-02-01 00:00:00")
    two = shop.load_shop(raw([row("1", "late", "2024-01-02 00:00:00"), row("2", "paid", "2024-01-06 00:00:00"), row("3", "new", "2024-01-07 00:00:00")]), "2024-02-02 00:00:00", one)
    assert {r.order_status for r in two["sat_order_header"].collect()} == {"new", "paid"} and two["sat_order_header"].count() == two["hub_order"].count() == 3
    assert set(two) == {"hub_order", "sat_order_header"} and len(shop.VAULT) == 10 and len(shop.STAGING) == 6


def test_alerts_and_grades(spark):
    stock = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, 0.0), (2, 1, "a", 0.0, 0.0, 2.0), (3, 1, "a", 6000.0, 0.0, 0.0), (4, 1, "a", 10.0, 0.0, 0.0), (5, 1, "a", 0.0, 3.0, 0.0)], "material_id int, plant int, location string, unrestricted double, inspection double, blocked double")
    got = {r.material_id: (r.alert_type, r.health_status) for r in metrics.inventory_alerts({"stock": stock}).collect()}
    assert got == {1: ("ZERO_STOCK", "RED"), 2: ("BLOCKED_STOCK", "YELLOW"), 3: ("EXCESS_STOCK", "YELLOW"), 5: ("OK", "GREEN")}
