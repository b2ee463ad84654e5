import pytest

from stratum.operators import profile, quality, value_index


def keys(spark, name, n, copies=1, other="X"):
    return spark.range(n * copies).selectExpr(f"concat('K', id % {n}) AS {name}", f"concat('{other}', id) AS {other}")


@pytest.mark.parametrize(("small", "large", "kind"), [((60, 1), (60, 1), "per_record_key"), ((60, 1), (60, 5), "header_detail"), ((4, 250), (4, 250), "catastrophic_fanout")])
def test_fanout_classes(spark, small, large, kind):
    rows = profile.measure_fanout(keys(spark, "k", *small), keys(spark, "k", *large, other="Y"), ["k"]).withColumn("c", profile.classify_fanout())
    assert rows.first().c == kind


def test_no_signal_and_saturation(spark):
    a, b = keys(spark, "k", 10), spark.range(10).selectExpr("concat('Z', id) AS k")
    row = profile.measure_fanout(a, b, ["k"]).withColumn("c", profile.classify_fanout()).first()
    assert (row.c, row.matched, row.sample_saturated) == ("no_signal", 0, True)
    rows = profile.join_cardinality(keys(spark, "k", 60), keys(spark, "k", 60, 5, "Y"), ["k"]).collect()
    assert {r.direction: r.fanout_class for r in rows} == {"a->b": "header_detail", "b->a": "per_record_key"}
    assert [r.is_top for r in rows] == [True, False]


def test_primary_keys(spark):
    single = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "MATNR string, MEINS string")
    assert profile.find_primary_key(single) == ["MATNR"]
    pair = spark.createDataFrame([("1", "a", 1), ("1", "a", 2), ("1", "b", 1)], "MANDT string, MBLNR string, ZEILE int")
    assert profile.find_primary_key(pair, client="MANDT") == ["MBLNR", "ZEILE"]
    assert profile.find_primary_key(spark.createDataFrame([("a", "b")] * 3, "A string, B string")) == []


def test_foreign_keys_and_shape(spark):
    parent = spark.createDataFrame([(f"m{i}",) for i in range(8)], "MATNR string")
    child = spark.createDataFrame([(f"m{i}",) for i in range(10)] * 2, "MATNR string")
    assert profile.foreign_key(child, parent, "MATNR").first().confidence == "medium"
    assert profile.relationship_shape(child, parent, "MATNR").first().shape == "many_to_one"
    found = value_index.find_foreign_keys({"p": parent, "c": child}).collect()
    assert {(r.from_table, r.to_table, r.confidence) for r in found} == {("p", "c", "high"), ("c", "p", "medium")}


def test_filter_reachability(spark):
    seri = spark.createDataFrame([("1", "E1"), ("2", "E2")], "MBLNR string, EQUNR string")
    mseg = spark.createDataFrame([("1", "101"), ("2", "101"), ("3", "122"), ("4", "161")], "MBLNR string, BWART string")
    found = profile.filter_reachability(seri, mseg, "MBLNR", ["BWART"])
    assert {r.value: r.is_reachable for r in found.collect()} == {"101": True, "122": False, "161": False}
    # Joined rows are counted; a column of too many values says that it was skipped, exactly or by far.
    twice = seri.union(seri).union(seri.filter("EQUNR = 'E1'"))
    assert {r.value: (r.total_rows, r.reachable_rows) for r in profile.filter_reachability(twice, mseg, "MBLNR", ["BWART"]).collect()}["101"] == (2, 5)
    for most in (1, 2, 3):
        rows = {(r.column_name, r.status, r.reason) for r in profile.filter_reachability(seri, mseg, "MBLNR", ["BWART", "MBLNR"], most).collect()}
        assert rows == {("MBLNR", "skipped", "high_cardinality"), ("BWART", *(("success", None) if most == 3 else ("skipped", "high_cardinality")))}


def test_one_join_measures_all_columns(spark):
    a, b = spark.range(50).selectExpr("id % 7 AS k"), spark.range(90).selectExpr("id % 9 AS k", "id % 3 AS x", "id % 4 AS y", "cast(id % 5 AS string) AS z")
    plan = profile.filter_reachability(a, b, "k", ["x", "y", "z"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1


def test_value_index_equals_pairs(spark):
    frames = {
        "a": spark.range(60).selectExpr("id % 20 AS k", "concat('x', id) AS name", "cast(id AS double) AS amount"),
        "b": spark.range(45).selectExpr("CASE WHEN id % 9 = 0 THEN NULL ELSE cast(id % 25 AS int) END AS k", "concat('x', id * 2) AS name", "id AS amount"),
        "c": spark.range(5).selectExpr("cast(id AS string) AS k", "timestamp'2024-01-01' AS name"),
    }
    found = {(r.from_table, r.to_table, r.key): (r.integrity, r.confidence) for r in value_index.find_foreign_keys(frames).collect()}
    pairs = {}
    for x, y in (("a", "b"), ("b", "a")):
        for key in ("k", "name", "amount"):
            r = profile.foreign_key(frames[x], frames[y], key).first()
            if r.confidence != "none":
                pairs[x, y, key] = (r.integrity, r.confidence)
    assert found == pairs and pairs
    swept = {r.direction: r for r in value_index.sweep_pairs({n: df.withColumnRenamed("k", "orderkey") for n, df in frames.items() if n != "c"}, 15).collect()}
    one = {r.direction: r for r in profile.join_cardinality(frames["a"], frames["b"], ["k"], ("a", "b"), 15).collect()}
    assert swept.keys() == one.keys() and all({**swept[d].asDict(), "key": None} == {**one[d].asDict(), "key": None} for d in one)
    assert value_index.sweep_pairs({"a": frames["a"].select("name")}) is None


def test_candidates_and_keyish(spark):
    pay = spark.range(2000).selectExpr("concat('p', id) AS pay_key", "cast(id % 3 AS int) AS seq", "cast(id AS double) AS amount")
    assert profile.keyish_columns(pay) == ["pay_key"]
    custs, orders = spark.range(500).selectExpr("concat('c', id) AS cust_id"), spark.range(2000).selectExpr("concat('c', id % 500) AS customer_ref")
    assert profile.value_overlap(custs, orders, "cust_id", "customer_ref").first().is_candidate
    assert profile.join_candidates(pay, pay)[0] == ("pay_key", "pay_key", "shared_name")


def test_gates(spark):
    joins = spark.createDataFrame([("a", "b", "k"), ("a", "c", "k")], "left_table string, right_table string, join_key string")
    found = spark.createDataFrame([("a", "b", "k", "catastrophic_fanout", None, None, None), ("a", "b", "x", "per_record_key", None, "t", 0.9)], "left_table string, right_table string, join_key string, fanout_class string, safe_direction string, bridge_table string, matched_ratio double")
    rows = {r.right_table: (r.verdict, r.suggested_bridge) for r in quality.check_joins(joins, found).collect()}
    assert rows == {"b": ("reject", "t"), "c": ("unknown", None)}
    filters = spark.createDataFrame([("m", "c", "=", ["9"]), ("m", "c", "IN", ["1", "9"]), ("m", "c", "IN", ["8", "9"]), ("m", "c", "=", ["1"])], "table_name string, column_name string, operator string, filter_values array<string>")
    reach = spark.createDataFrame([("m", "c", ["1", "2"])], "table_name string, column_name string, reachable array<string>")
    assert sorted(r.verdict for r in quality.check_filters(filters, reach).collect()) == ["accept", "refuse", "refuse", "warn"]
