"""Stored tables: loads, merges, comparisons and sketches against versions that read everything."""

import pytest
from pyspark.sql import functions as F

from stratum.operators import compare, sketches, stored, vault


def stage(spark, n, day, factor=1):
    return spark.range(n).selectExpr("md5(cast(id AS string)) AS hk", "id AS code", f"md5(cast(id % 7 * {factor} AS string)) AS hashdiff", f"id % 7 * {factor} AS v", f"timestamp'2024-0{day}-01' AS load_date", "'s' AS record_source")


def test_two_increments_append_what_is_new_and_never_shuffle_what_is_stored(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        hub, sat = vault.HubSpec("hk", {"code": "code"}), vault.SatSpec("hk", {"v": "v"})
        one, two = stage(spark, 500, 1), stage(spark, 800, 2, 2)
        for load in (one, two, two):
            found = stored.store_hub(load, hub, "t_hub", f"{tmp_path}/hub", 8)
            history = stored.store_sat(load, sat, "t_sat", f"{tmp_path}/sat", 8)
        assert {(r.code, r.load_date.month) for r in found.collect()} == {(i, 1 if i < 500 else 2) for i in range(800)} and found.count() == 800
        want = vault.load_sat(one, None, sat).unionByName(vault.load_sat(two, one.select("hk", "hashdiff"), sat))
        assert sorted(map(tuple, history.select("hk", "v").collect())) == sorted(map(tuple, want.select("hk", "v").collect()))
        for load, name in ((vault.load_hub(two, spark.table("t_hub"), hub), "t_hub"), (vault.load_sat(two, spark.table("t_sat"), sat), "t_sat")):
            plan = load._jdf.queryExecution().executedPlan().toString()
            side = plan[plan.index(f"spark_catalog.default.{name}") - 2000 if plan.index(f"spark_catalog.default.{name}") > 2000 else 0 :]
            before = side[: side.index(f"spark_catalog.default.{name}")]
            # From the stored table up to the join there is no exchange.
            assert "Exchange" not in before[before.rindex("SortMergeJoin") :].split("Range (")[-1], plan
        assert stored.high_water(two, "t_hub", "load_date").count() == 0 and stored.high_water(two, "t_nothing", "load_date").count() == 800
        # A load that fails leaves the table as it was.
        broken = stage(spark, 900, 3).withColumn("code", F.when(F.col("code") > 850, F.raise_error(F.lit("broken"))).otherwise(F.col("code")).cast("long"))
        with pytest.raises(Exception, match="broken"):
            stored.store_hub(broken, hub, "t_hub", f"{tmp_path}/hub", 8)
        spark.catalog.refreshTable("t_hub")
        assert spark.table("t_hub").count() == 800
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS t_hub")
        spark.sql("DROP TABLE IF EXISTS t_sat")


def test_merge_replaces_only_the_buckets_it_touches(spark, tmp_path):
    path = f"{tmp_path}/merged"
    one = spark.range(300).selectExpr("id AS k", "'old' AS v", "timestamp'2024-01-01' AS load_date")
    stored.merge_stored(one, ["k"], path, 16)
    files = {r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}
    two = spark.createDataFrame([(3, "new", 1), (3, "newer", 2), (900, "new", 1), (None, "null", 1)], "k long, v string, day int").selectExpr("k", "v", "make_timestamp(2024, 2, day, 0, 0, 0) AS load_date", "1 AS extra")
    got = {r.k: (r.v, r.extra) for r in stored.merge_stored(two, ["k"], path, 16).collect()}
    assert got == {**{i: ("old", None) for i in range(300)}, 3: ("newer", 1), 900: ("new", 1), None: ("null", 1)}
    left = {r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files & left) >= 13


def test_comparison_reads_only_buckets_that_differ(spark, tmp_path):
    old = spark.range(4000).selectExpr("CASE WHEN id = 17 THEN NULL ELSE id END AS k", "id % 5 AS a", "CASE WHEN id % 3 = 0 THEN '' END AS b").repartition(4)
    new = old.filter("k <> 5 OR k IS NULL").withColumn("a", F.when(F.col("k").isin(8, 900), 77).otherwise(F.col("a"))).withColumn("b", F.when(F.col("k") == 9, F.lit(None)).otherwise(F.col("b"))).union(spark.sql("SELECT 9999L, 1L, 'x'")).repartition(3)
    for df, name in ((old, "old"), (new, "new"), (old.repartition(2), "same")):
        compare.bucketed(df, ["k"], f"{tmp_path}/{name}", 256)
    got = {(r.k, r.change) for r in compare.changed_keys(spark, f"{tmp_path}/old", f"{tmp_path}/new", ["k"]).collect()}
    assert got == {(5, "missing"), (8, "changed"), (900, "changed"), (9, "changed"), (9999, "added")}
    prints = lambda n: spark.read.parquet(f"{tmp_path}/{n}/fingerprints")
    assert 1 <= len(compare.differing_buckets(prints("old"), prints("new"))) <= 5
    assert compare.differing_buckets(prints("old"), prints("same")) == [] and compare.changed_keys(spark, f"{tmp_path}/old", f"{tmp_path}/same", ["k"]).count() == 0
    plan = compare.changed_keys(spark, f"{tmp_path}/old", f"{tmp_path}/new", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [_bucket" in plan


def test_sketches_unite_and_prune(spark):
    df = spark.range(20_000).selectExpr("id", "id % 4 AS part", "id % 3000 AS few", "id div 2 AS half", "id % 2 AS bit", "CASE WHEN id > 5 THEN id END AS holes", "1 AS one")
    columns = ["id", "few", "half", "holes", "one", ["half", "bit"], ["few", "bit"]]
    parts = {f"p{i}": f"part = {i}" for i in range(4)}
    first = sketches.refreshed(sketches.sketched(df.filter("part = 0"), "t", columns, "p0"), df, "t", columns, {"p1": parts["p1"]}).cache()
    kept = sketches.refreshed(first, df.filter("part > 1"), "t", columns, parts)  # what is stored needs no second reading
    whole = {r.column_name: (r.rows, r.present, r.estimate) for r in sketches.united(kept).collect()}
    exact = {"id": 20_000, "few": 3000, "half": 10_000, "holes": 19_994, "one": 1, "half,bit": 20_000, "few,bit": 3000}
    assert all(n == 20_000 and abs(e - exact[c]) <= 5 * sketches.ERROR * exact[c] for c, (n, _, e) in whole.items()) and whole.keys() == exact.keys()
    able = {r.column_name for r in sketches.able_keys(kept).collect()}
    assert {"id", "half,bit"} <= able <= {"id", "half,bit"} and sketches.confirmed_keys(df, sketches.able_keys(kept)) == ["id", "half,bit"]
    assert sketches.confirmed_keys(df.union(df.limit(1)), sketches.able_keys(kept)) == []
