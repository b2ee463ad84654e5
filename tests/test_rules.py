"""Assertions that share a scan against the same assertions one by one."""

from stratum.operators import quality, rules
from stratum.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_rules_equal_single_assertions(spark):
    rows = [(i, i % 7 if i % 11 else None, f"s{i % 3}", float(i - 5)) for i in range(80)] + [(3, 3, "s0", None), (None, 3, "odd", 2.0)]
    df = spark.createDataFrame(rows, "id int, k int, s string, v double")
    to = spark.createDataFrame([(i,) for i in range(5)] + [(4,)], "key int")
    got = {r.test: (r.violations, r.status) for r in rules.run_rules({"t": (rules.with_partner(df, "k", to, "key", "there"), [
        rules.RowRule("positive", "v >= 0"), rules.RowRule("positive_or_null", "v >= 0", null_too=True), rules.RowRule("listed", "s in ('s0', 's1', 's2')", "warn"), rules.RowRule("partner", "k is null or there", null_too=True),
        rules.unique_rule("unique", ["id"]), rules.unique_rule("combined", ["k", "s"], where="v > 70"), rules.GridRule("grid", "k", "s"),
        rules.GroupRule("few_values", ["s"], "n_distinct <= 5", distinct="k"), rules.GroupRule("share", [], "2 * hits <= n", "warn", hit="v > 0"), rules.RowRule("fine", "true"),
    ]), "none": (df.limit(0), [rules.unique_rule("empty", ["id"]), rules.GridRule("empty_grid", "k", "s")])}).collect()}
    count = lambda x: x.count()
    want = {
        "positive": count(quality.expression_true(df, "v >= 0")), "positive_or_null": count(df.filter("v is null or v < 0")), "listed": count(quality.accepted_values(df, "s", ["s0", "s1", "s2"])), "partner": count(quality.relationships(df, "k", to, "key")),
        "unique": count(quality.unique(df, "id")), "combined": count(quality.unique_where(df.filter("k is not null"), ["k", "s"], "v > 70")), "grid": count(quality.grid_gaps(df.filter("k is not null"), "k", "s")) + 0,
        "few_values": 3, "share": 1, "fine": 0, "empty": 0, "empty_grid": 0,
    }
    assert {k: v[0] for k, v in got.items()} == want
    assert got["positive"][1] == "fail" and got["listed"][1] == "warn" and got["fine"][1] == "pass"


def test_each_table_is_scanned_once(spark):
    plan = QUERIES["k_named_assertions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    for table, column in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"), ("supplier", "s_suppkey"), ("part", "p_size"), ("events", "event_type"), ("conversations", "conv_id")):
        assert sum(line.strip(" :+-").startswith("Relation") and column in line for line in plan.split("\n")) == 1, table
