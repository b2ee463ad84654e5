from stratum.operators import vault

SPEC = vault.StagingSpec("T", {"hk": ["id"]}, change=["v"])
SAT = vault.SatSpec("hk", {"v": "value"})


def load(spark, rows, day):
    return vault.stage(spark.createDataFrame(rows, "id int, v string"), SPEC, f"2024-01-{day:02d} 00:00:00")


def history(spark, spec=SAT):
    """Key 1 unchanged, 2 changed and back, 3 new in the second load."""
    one, two, three = load(spark, [(1, "a"), (2, "a")], 1), load(spark, [(1, "a"), (2, "b"), (3, "c")], 2), load(spark, [(2, "a")], 3)
    sat = vault.load_sat(one, None, spec)
    for more in (two, three):
        sat = sat.union(vault.load_sat(more, sat, spec))
    return sat


def test_reload_is_idempotent_and_flip_back_needs_latest(spark):
    assert history(spark).count() == 4  # 2's return to "a" was stored before
    assert history(spark, vault.SatSpec("hk", {"v": "value"}, compare="latest")).count() == 5
    one = load(spark, [(1, "a"), (2, "a")], 1)
    sat = vault.load_sat(one, None, SAT)
    assert vault.load_sat(one, sat, SAT).count() == 0
    hub = vault.load_hub(one, None, vault.HubSpec("hk", {"id": "id"}))
    assert vault.load_hub(one, hub, vault.HubSpec("hk", {"id": "id"})).count() == 0


def test_global_snapshot_loses_unchanged_keys(spark):
    sat = history(spark)
    assert vault.latest_snapshot(sat).count() == 2
    assert vault.latest_snapshot(sat, snapshot="per_key", key="hk").count() == 3


def test_merge_keeps_one_row_per_key_and_aligns(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([(2, "z", 5)], "id int, v string, w int")
    assert sorted((r.id, r.v, r.w) for r in vault.merge(a, b, "id").collect()) == [(1, "x", None), (2, "z", 5)]


def test_ties(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "k int, v string, load_date int")
    assert vault.current_by_max(df, "k").count() == 2
    assert vault.current_row(df, "k", ["v"]).first().v == "a"
