"""Prefix scans against windows over one partition, with one key that holds half of all rows."""

import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratum.operators import evidence, relational, scan
from stratum.plans import derive, metrics


@pytest.fixture(scope="module")
def rows(spark):
    key = "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 31 = 0 THEN NULL ELSE concat('k', id % 40) END AS k"
    return spark.range(4000).selectExpr(key, "hash(id) % 500 AS o", "id", "CASE WHEN id % 3 > 0 THEN id % 17 END AS v").repartition(5)


def same(a, b):
    return sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("parts", [1, 3, 23])
def test_sums_numbers_and_carried_values(rows, parts):
    upto = Window.partitionBy("k").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert same(scan.running_sum(rows, ["o", "id"], "v", ["k"], "s", parts), rows.withColumn("s", F.sum("v").over(upto)))
    assert same(scan.running_sum(rows, ["o", "id"], "v", (), "s", parts), rows.withColumn("s", F.sum("v").over(every)))
    assert same(scan.carried_last(rows, ["o", "id"], "v", ["k"], "s", parts), rows.withColumn("s", F.last("v", True).over(upto)))
    assert same(scan.numbered(rows, [F.desc("o"), "id"], "n", parts), rows.withColumn("n", F.row_number().over(Window.orderBy(F.desc("o"), "id")).cast("long")))
    assert same(scan.numbered_by(rows, ["k"], ["o", "id"], "n", parts), rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o", "id")).cast("long")))


def test_equal_rows_are_dealt_out_and_empty_tables_work(spark, rows):
    equal = spark.range(3000).selectExpr("1 AS o", "2 AS v")
    assert sorted(r.n for r in scan.numbered(equal, ["o"], "n", 7).collect()) == list(range(1, 3001))
    assert sorted(r.s for r in scan.running_sum(equal, ["o"], "v", (), "s", 7).collect()) == list(range(2, 6001, 2))
    none = rows.limit(0)
    assert scan.numbered(none, ["o"]).count() == scan.running_sum(none, ["o"], "v").count() == scan.carried_last(none, ["o"], "v", ["k"], "s").count() == 0


def test_no_window_over_one_partition(spark):
    wide = spark.range(100_000).selectExpr("id", "id % 7 AS v", "'k' AS k")
    existing = spark.createDataFrame([("e7",)], "id string")
    for df in (relational.running_sum(wide, ["id"], "v"), evidence.with_ids(wide.drop("id"), existing, ["v"], "e"), derive.round_robin_pair(wide, wide.select("k", F.col("id").alias("j")).limit(100), "k", "id", "j")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window [" not in plan or "SinglePartition" not in plan
    assert relational.running_sum(wide, ["id"], "v").agg(F.max("running")).first()[0] == wide.agg(F.sum("v")).first()[0]
    ids = {r.id for r in evidence.with_ids(wide.drop("id"), existing, ["v"], "e").collect()}
    assert ids == {f"e{n}" for n in range(8, 100_008)}


def test_next_events_of_a_hot_pair(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    receipts = [(f"d{i}", 1 if i % 2 else i % 5, 1, "101", day(i * 7 % 400)) for i in range(300)] + [("d1", 3, 1, "101", day(3)), ("dn", None, 1, "101", day(3))]
    returns = [(1 if i % 2 else i % 5, 1, "122", day(i * 13 % 420)) for i in range(90)] + [(None, 1, "122", day(4))]
    frames = {"receipts": spark.createDataFrame(receipts, "document_id string, material_id int, vendor_id int, movement_type string, posting_date date"), "movements": spark.createDataFrame(returns, "material_id int, vendor_id int, movement_type string, posting_date date")}
    hits = {d for d, m, v, _, on in receipts if m is not None and any(m == x and v == y and on <= back <= on + datetime.timedelta(days=20) for x, y, _, back in returns)}
    want = {}
    for d, m, v, _, on in receipts:
        quarter = datetime.date(on.year, (on.month - 1) // 3 * 3 + 1, 1)
        want.setdefault((m, v, quarter), (set(), set()))[0].add(d)
        if d in hits:
            want[m, v, quarter][1].add(d)
    got = {(r.material_id, r.vendor_id, r.quarter): (r.receipts, r.returned) for r in metrics.returns_within_days(frames, 20).collect()}
    assert got == {k: (len(a), len(b)) for k, (a, b) in want.items()}
    items = spark.createDataFrame([(1, "201", "SN:a", 7), (2, "202", "SN:a", 7), (3, "202", "SN:a", 7), (4, "201", "SN:b", 8), (5, "202", "SN:c", 9), (6, "201", "SN:a", 8)], "document_id int, movement_type string, item_text string, material_id int")
    heads = spark.createDataFrame([(1, day(5)), (2, day(5)), (3, day(9)), (4, day(1)), (5, day(2)), (6, day(10))], "document_id int, posting_date date")
    assert {tuple(r) for r in derive.deployed_devices(items, heads).collect()} == {("a", 7, day(5), day(9)), ("b", 8, day(1), None), ("a", 8, day(10), None)}
