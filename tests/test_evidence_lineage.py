import json

from stratum.operators import evidence, lineage
from stratum.plans import derive


def rows(spark, data):
    out = spark.createDataFrame([], evidence.EVIDENCE)
    more = spark.createDataFrame(data, "id string, analysis_type string, source_tables string, status string, executed_at_utc string").selectExpr("id", "analysis_type", "source_tables", "status", "cast(executed_at_utc AS timestamp) AS executed_at_utc")
    return out.unionByName(more, allowMissingColumns=True)


def test_supersede_points_to_the_first_new_id(spark):
    old, new = rows(spark, [("1", "x", "a", "success", "2024-01-01"), ("2", "y", "a", "success", "2024-01-01")]), rows(spark, [("8", "x", "a", "success", "2024-01-02"), ("9", "x", "a", "success", "2024-01-02")])
    got = {r.id: (r.superseded_by, r.status) for r in evidence.supersede(old, new).collect()}
    assert got["1"] == ("8", "superseded") and got["2"] == (None, "success") and got["9"][0] is None
    assert {r.id for r in evidence.latest_evidence(evidence.supersede(old, new)).collect()} == {"2", "9"}


def test_coverage_matrix(spark):
    scope = spark.createDataFrame([("a",), ("b",)], "table_name string")
    done = rows(spark, [("1", "magnitude", "a", "success", "2024-01-01"), ("2", "grain_relationship", "b,a", "skipped", "2024-01-01")])
    got = {(r.analysis_type, r.source_tables): r.is_covered for r in evidence.coverage(scope, done).collect()}
    assert len(got) == 15 and got["baseline", "a"] and not got["baseline", "b"] and got["grain_relationship", "a,b"]


def test_blocker_state(spark):
    blockers = [{"short_title": t, "type": "x", "resolves_in": "y", "tables": "t"} for t in ("b1", "b2")]
    history = json.dumps({"iterations": [{"iter_num": 1, "analyst_action": "confirmed", "llm_response": {"blockers": blockers}}, {"iter_num": 2, "analyst_action": "rejected", "llm_response": {"blockers": []}}]})
    said = json.dumps({"blockers_resolution": [{"blocker_short_title": "b1", "status": "resolved", "evidence": "e"}]})
    terms = spark.createDataFrame([("T", "n", "active", history)], "id string, term_name string, status string, scope_derivation_history_json string")
    results = spark.createDataFrame([("1", "T", "sufficiency", said, "2024-01-01")], "id string, term_id string, row_type string, sufficiency_json string, executed_at_utc string")
    assert {r.short_title: r.state for r in evidence.blocker_state(terms, results).collect()} == {"b1": "RESOLVED", "b2": "PENDING"}


def test_lineage(spark):
    steps = spark.createDataFrame([("fact", "c", "sat", "c"), ("sat", "c", "stg", "C"), ("stg", "C", "raw", "C")], "model string, column string, from_model string, from_column string")
    got = {r.model: (r.origin_model, r.hops) for r in lineage.column_origin(steps).collect()}
    assert got["fact"] == ("raw", 3) and got["stg"] == ("raw", 1)
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "from_model string, to_model string")
    assert {(r.to_model, r.hops) for r in lineage.downstream_all(edges, "a").collect()} == {("b", 1), ("c", 2)}


def test_lineage_with_cycles_and_diamonds(spark):
    step = lambda *pairs: spark.createDataFrame([(a, "c", b, "c") for a, b in pairs], "model string, column string, from_model string, from_column string")
    found = lambda df, n: sorted((r.model, r.origin_model, r.hops) for r in lineage.column_origin(df, n).collect())
    # A diamond of ways of unlike length, and a cycle, which ends where the hops do.
    diamond = step(("d", "b"), ("d", "c"), ("c", "b"), ("b", "a"))
    assert found(diamond, 10) == [("b", "a", 1), ("c", "a", 2), ("d", "a", 2), ("d", "a", 3)]
    assert found(step(("x", "y"), ("y", "x")), 5) == [("x", "y", 5), ("y", "x", 5)]
    chain = step(*((f"m{i + 1:02}", f"m{i:02}") for i in range(14)))
    assert all(n == min(int(m[1:]), 10) and int(o[1:]) == int(m[1:]) - n for m, o, n in found(chain, 10))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d"), ("d", "d")], "from_model string, to_model string")
    assert {(r.to_model, r.hops) for r in lineage.downstream_all(edges, "a").collect()} == {("b", 1), ("c", 1), ("a", 2), ("d", 2)}
    assert lineage.downstream_all(edges, "nowhere").count() == 0 and {r.hops for r in lineage.downstream_all(edges, "a", 1).collect()} == {1}


def test_archived_terms_own_nothing(spark):
    owners = spark.createDataFrame([("t1", "m"), ("t2", "m"), ("t3", "n"), ("t1", "o"), ("t4", "o")], "term_id string, model string")
    edges = spark.createDataFrame([("m", "n")], "from_model string, to_model string")
    terms = spark.createDataFrame([("t1", "active"), ("t2", "archived"), ("t3", None)], "term_id string, status string")
    assert {tuple(r) for r in lineage.archive_impact(owners, edges, "t1", terms).collect()} == {("n", "downstream")}


def test_journals_balance(spark):
    heads = spark.createDataFrame([(1, 10.0, 1.9, False), (2, 5.0, 0.95, True)], "document_id int, net double, tax double, cancelled boolean")
    lines = derive.journal_from_billing(heads)
    assert lines.count() == 3 and derive.journal_balanced(lines).count() == 0
    items = spark.createDataFrame([(1, 1, 3.0), (1, 2, 4.5)], "document_id int, item_no int, amount double")
    assert derive.journal_balanced(derive.journal_from_invoices(items.select("document_id").distinct(), items)).count() == 0
