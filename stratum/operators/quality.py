"""Data quality, audits and gates (inventory K1 to K21). A test's result is the rows that violate it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.scalars import ratio
from stratum.operators.profile import completeness
from stratum.operators.relational import expected_grid, jaccard


def not_null(df: DataFrame, c: str) -> DataFrame:
    """K1: rows without a value."""
    return df.filter(F.col(c).isNull())


def unique(df: DataFrame, c: str) -> DataFrame:
    """K1: values that occur more than once."""
    return unique_combo(df.filter(F.col(c).isNotNull()), [c])


def accepted_values(df: DataFrame, c: str, values: Sequence) -> DataFrame:
    """K2: rows whose value is outside the list."""
    return df.filter(~F.col(c).isin(*values))


def relationships(df: DataFrame, c: str, to: DataFrame, key: str) -> DataFrame:
    """K3: rows whose non-null value has no partner."""
    return df.filter(F.col(c).isNotNull()).join(to.select(F.col(key).alias(c)).distinct(), c, "left_anti")


def expression_true(df: DataFrame, expression: str | Column) -> DataFrame:
    """K4: rows for which the expression is false."""
    return df.filter(~(F.expr(expression) if isinstance(expression, str) else expression))


def unique_combo(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K5: combinations that occur more than once, with n."""
    return df.groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1")


def run_assertions(tests: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """K6: test, severity, violations and status (pass, warn or fail) of named violation frames."""
    rows = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("test"), F.lit(severity).alias("severity"), "violations") for name, (df, severity) in tests.items()]
    return reduce(DataFrame.union, rows).withColumn("status", F.when(F.col("violations") == 0, "pass").when(F.col("severity") == "warn", "warn").otherwise("fail"))


def unique_where(df: DataFrame, cols: Sequence[str], cond: str | Column) -> DataFrame:
    """K7: combinations that occur more than once among rows that meet the condition."""
    return unique_combo(df.filter(cond), cols)


def stale_in_state(df: DataFrame, state: str, value: str, since: str, hours: int, as_of: str | Column) -> DataFrame:
    """K8: rows in a state for more than so many hours before the as-of time."""
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    return df.filter((F.col(state) == value) & (F.col(since).cast("timestamp") < now - F.expr(f"interval {int(hours)} hours")))


def grid_gaps(df: DataFrame, a: str, b: str) -> DataFrame:
    """K9: combinations without a row."""
    return expected_grid(df, a, b)


def vault_audit(frames: Mapping[str, DataFrame], hubs: Mapping[str, str], links: Mapping[str, tuple[str, Mapping[str, str]]], sats: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Check, object, violations: key uniqueness, structure, orphans of links and satellites, hash shape, census.

    hubs: name to key; links: name to (key, {parent key: hub}); sats: name to (parent key, parent).
    """
    keys = dict(hubs) | {n: k for n, (k, _) in links.items()}

    def row(check: str, name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("violations")).select(F.lit(check).alias("check"), F.lit(name).alias("object"), "violations")

    out = []
    for name, key in keys.items():
        out.append(row("V1 key unique", name, unique_combo(frames[name], [key])))
        out.append(row("V6 hash shape", name, frames[name].filter(~F.col(key).rlike("^[0-9a-f]{32}$"))))
    for name in frames:
        lacking = {"load_date", "record_source"} - set(frames[name].columns)
        out.append(row("V2 structure", name, frames[name].limit(1) if lacking else frames[name].limit(0)))
    for name, (_, parents) in links.items():
        for key, hub in parents.items():
            out.append(row(f"V4 {key} in {hub}", name, relationships(frames[name], key, frames[hub], hubs[hub])))
    for name, (key, parent) in sats.items():
        out.append(row(f"V5 {key} in {parent}", name, relationships(frames[name], key, frames[parent], keys[parent])))
        out.append(row("V7 history unique", name, unique_combo(frames[name], [key, *(c for c in ("hashdiff",) if c in frames[name].columns)])))
    return reduce(DataFrame.union, out).withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("fail"))


def link_structure(frames: Mapping[str, DataFrame], links: Mapping[str, tuple[str, Mapping[str, str]]], single: Sequence[str] = ()) -> DataFrame:
    """A row per link: its own key, its parents' keys (two, or one for those in ``single``) and the load's columns must be there."""

    def lacking(name: str) -> int:
        key, parents = links[name]
        return len({key, *parents, "load_date", "record_source"} - set(frames[name].columns)) + int(len(parents) < (1 if name in single else 2))

    one = next(iter(frames.values())).sparkSession.range(1)
    rows = F.array(*(F.struct(F.lit("V3 link structure").alias("check"), F.lit(n).alias("object"), F.lit(lacking(n)).cast("long").alias("violations")) for n in links))
    return one.select(F.inline(rows)).withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("fail"))


def hash_consistency(staged: Mapping[str, DataFrame], pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Per (table, reference table, hash key), the distinct hashes of the table that the reference lacks."""
    rows = [staged[a].select(key).distinct().subtract(staged[b].select(key)).agg(F.count("*").alias("violations")).select(F.lit("V7 hash consistency").alias("check"), F.lit(f"{a}.{key} in {b}").alias("object"), "violations") for a, b, key in pairs]
    return reduce(DataFrame.union, rows).withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("fail"))


def trace(path: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row: rows that can be followed along the path of hubs and links; none is a failure."""
    out = path[0]
    for df, key in zip(path[1:], keys, strict=True):
        out = out.join(df, key)
    return out.agg(F.count("*").alias("traversable_rows")).withColumn("status", F.when(F.col("traversable_rows") > 0, "pass").otherwise("fail"))


def census(layers: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """Layer, table_name and row_count of every table."""
    rows = [df.agg(F.count("*").alias("row_count")).select(F.lit(layer).alias("layer"), F.lit(name).alias("table_name"), "row_count") for layer, frames in layers.items() for name, df in frames.items()]
    return reduce(DataFrame.union, rows)


def staging_parity(raw: DataFrame, staged: DataFrame) -> DataFrame:
    """Rows of the source and of its staging; they must agree."""
    out = raw.agg(F.count("*").alias("raw_rows")).crossJoin(staged.agg(F.count("*").alias("staged_rows")))
    return out.withColumn("status", F.when(F.col("raw_rows") == F.col("staged_rows"), "pass").otherwise("fail"))


def require_nonempty(frames: Mapping[str, DataFrame]) -> None:
    """Raise where an output has no rows."""
    empty = [name for name, df in frames.items() if df.isEmpty()]
    if empty:
        raise ValueError(f"no rows in {empty}")


def check_contracts(frames: Mapping[str, DataFrame], contracts: DataFrame) -> DataFrame:
    """Contract rows with the table's least field completeness and PASS, BREACH or UNKNOWN (no such table)."""
    rows = [completeness(df).agg(F.min(F.round(100 - F.col("null_pct"), 6)).alias("min_completeness_pct")).withColumn("source_table", F.lit(name)) for name, df in frames.items()]
    out = contracts.join(reduce(DataFrame.unionByName, rows), "source_table", "left")
    verdict = F.when(F.col("min_completeness_pct").isNull(), "UNKNOWN").when(F.col("min_completeness_pct") >= F.col("completeness_threshold_pct"), "PASS").otherwise("BREACH")
    return out.withColumn("verdict", verdict)


def source_quality(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Mean completeness of every table: healthy from 95 %, review from 80 %, else low."""
    rows = [completeness(df).agg(F.round(F.avg(100 - F.col("null_pct")), 6).alias("avg_completeness")).withColumn("table_name", F.lit(name)) for name, df in frames.items()]
    out = reduce(DataFrame.unionByName, rows)
    return out.withColumn("quality", F.when(F.col("avg_completeness") >= 95, "healthy").when(F.col("avg_completeness") >= 80, "review").otherwise("low"))


def freshness_state(facts: DataFrame, tables: Sequence[str], as_of: str, ts: str = "last_source_ingestion_at", table: str = "source_tables", green: int = 3, yellow: int = 14) -> DataFrame:
    """Age in days of the newest row of each table: green, yellow, red or no_baseline; writes are blocked on the last two."""
    wanted = facts.sparkSession.createDataFrame([(t,) for t in tables], "source_table string")
    known = facts.select(F.explode(F.transform(F.split(table, ","), lambda x: F.trim(x))).alias("source_table"), ts).groupBy("source_table").agg(F.max(ts).alias("newest"))
    out = wanted.join(known, "source_table", "left").withColumn("age_days", F.datediff(F.lit(as_of).cast("date"), F.col("newest").cast("date")))
    state = F.when(F.col("age_days").isNull(), "no_baseline").when(F.col("age_days") <= green, "green").when(F.col("age_days") <= yellow, "yellow").otherwise("red")
    return out.withColumn("state", state).withColumn("write_blocked", F.col("state").isin("red", "no_baseline"))


def freshness_gate(facts: DataFrame, log: DataFrame, live: DataFrame, green: int = 3, yellow: int = 14) -> DataFrame:
    """One row: the oldest qualifying fact against the newest ingestion, as a state, and whether writes are blocked.

    facts: status, auto_inject, stale_after_days, scope_tables (comma list), evidence_refreshed_at; a fact qualifies if it is
    active, injected by itself, can go stale and names a live table. log: finished_at_utc. live: table_name.
    Without an ingestion there is no_baseline; without qualifying facts, or with newer ones, all is green.
    """
    able = facts.filter("status = 'active' and auto_inject and stale_after_days is not null").select("evidence_refreshed_at", F.explode(F.transform(F.split(F.lower("scope_tables"), ","), lambda x: F.trim(x))).alias("table_name"), F.monotonically_increasing_id().alias("_fact"))
    able = able.join(live.select(F.lower("table_name").alias("table_name")).distinct(), "table_name", "left_semi").dropDuplicates(["_fact"])
    oldest = able.agg(F.min("evidence_refreshed_at").alias("min_evidence_refreshed"), F.count("*").alias("facts_count"))
    out = log.agg(F.max("finished_at_utc").alias("last_ingestion")).crossJoin(oldest)
    seconds = F.col("last_ingestion").cast("timestamp").cast("long") - F.col("min_evidence_refreshed").cast("timestamp").cast("long")
    gap = F.when(F.col("last_ingestion").isNotNull(), F.coalesce(F.greatest(F.lit(0), F.floor(seconds / 86400)), F.lit(0)))
    out = out.withColumn("gap_days", gap.cast("int"))
    state = F.when(F.col("last_ingestion").isNull(), "no_baseline").when(F.col("gap_days") <= green, "green").when(F.col("gap_days") <= yellow, "yellow").otherwise("red")
    return out.withColumn("state", state).withColumn("write_blocked", F.col("state").isin("red", "no_baseline"))


def payload_drift(pairs: DataFrame, old: str = "old_json", new: str = "new_json", most: float = 5.0) -> DataFrame:
    """``pairs`` with drift of the payloads' groups, JSON lists of {"group", "share"}: unparseable where either is not one,
    else as :func:`classify_drift`. An absent old payload, or an empty one, is an empty list."""
    kind = "array<struct<group:string,share:double>>"
    a, b = F.from_json(F.coalesce(F.nullif(F.col(old), F.lit("")), F.lit("[]")), kind), F.from_json(new, kind)
    groups = lambda x: F.transform(x, lambda y: y["group"])
    top = lambda x: F.array_max(F.transform(x, lambda y: y["share"]))
    same = F.sort_array(a) == F.sort_array(b)
    fresh = F.size(F.array_except(groups(b), groups(a))) > 0
    moved = F.coalesce(F.abs(top(a) - top(b)) > most, F.lit(False))
    return pairs.withColumn("drift", F.when(a.isNull() | b.isNull(), "unparseable").when(same, "no_drift").when(fresh | moved, "material").otherwise("noise"))


def classify_drift(old: DataFrame, new: DataFrame, group: str, share: str, most: float = 5.0) -> DataFrame:
    """One row: no_drift, material (a new group, or the top share moved by more than ``most`` points) or noise."""
    both = old.select(group, F.col(share).alias("a")).join(new.select(group, F.col(share).alias("b")), group, "full_outer")
    out = both.agg(F.count_if(F.col("a").isNull()).alias("new_groups"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), F.abs(F.max("a") - F.max("b")).alias("top_shift"))
    return out.withColumn("drift", F.when(F.col("changed") == 0, "no_drift").when((F.col("new_groups") > 0) | (F.col("top_shift") > most), "material").otherwise("noise"))


def evidence_stale(evidence: DataFrame, counts: DataFrame, most: float = 0.10) -> DataFrame:
    """Evidence (table_name, recorded_rows) with is_stale: the row count moved by more than the share."""
    out = evidence.join(counts, "table_name", "left")
    moved = ratio(F.abs(F.col("row_count") - F.col("recorded_rows")), "recorded_rows")
    return out.withColumn("is_stale", F.coalesce(moved > most, F.lit(True)))


def check_joins(joins: DataFrame, evidence: DataFrame) -> DataFrame:
    """Declared joins (left_table, right_table, join_key) against evidence (the same, fanout_class, safe_direction, and bridges with bridge_table, matched_ratio).

    A catastrophic pair without a safe direction is rejected; the best per-record bridge is suggested.
    """
    pair = ["left_table", "right_table"]
    direct = evidence.filter("bridge_table is null").select(*pair, "join_key", "fanout_class", "safe_direction")
    bridges = evidence.filter("bridge_table is not null and fanout_class = 'per_record_key'").groupBy(*pair).agg(F.max_by("bridge_table", "matched_ratio").alias("suggested_bridge"))
    out = joins.join(direct, [*pair, "join_key"], "left").join(bridges, pair, "left")
    bad = (F.col("fanout_class") == "catastrophic_fanout") & F.coalesce(F.col("safe_direction"), F.lit("none")).isin("none", "")
    verdict = F.when(F.col("fanout_class").isNull(), "unknown").when(bad, "reject").otherwise("accept")
    return out.withColumn("verdict", verdict).withColumn("suggested_bridge", F.when(verdict == "reject", F.col("suggested_bridge")))


def check_filters(filters: DataFrame, evidence: DataFrame) -> DataFrame:
    """Declared filters (table_name, column_name, operator, filter_values array) against reachable values (table_name, column_name, reachable array).

    ``=`` is refused if its value is unreachable; ``IN`` if all are, with a warning if some are.
    """
    out = filters.join(evidence, ["table_name", "column_name"], "left")
    missing = F.array_except("filter_values", "reachable")
    verdict = (
        F.when(F.col("reachable").isNull(), "unknown")
        .when(F.size(missing) == 0, "accept")
        .when((F.col("operator") == "=") | (F.size(missing) == F.size("filter_values")), "refuse")
        .otherwise("warn")
    )
    return out.withColumn("unreachable", missing).withColumn("verdict", verdict)


def classify_sources(names: DataFrame, catalog: DataFrame, live: DataFrame, least: float = 0.30) -> DataFrame:
    """Recommended tables (table_name, columns) by class. A: live and in the catalog with like columns; B: live only; C: catalog only; D: neither, or unlike columns."""
    out = names.join(catalog.select("table_name", F.col("columns").alias("catalog_columns")), "table_name", "left").join(live.select("table_name", F.col("columns").alias("live_columns")), "table_name", "left")
    like = jaccard("catalog_columns", "live_columns") >= least
    kind = F.when(F.col("live_columns").isNotNull() & F.col("catalog_columns").isNotNull() & like, "A").when(F.col("live_columns").isNotNull() & F.col("catalog_columns").isNull(), "B").when(F.col("catalog_columns").isNotNull() & F.col("live_columns").isNull(), "C").otherwise("D")
    return out.withColumn("source_class", kind)


def layer_violations(edges: DataFrame, forbidden: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Edges (from_layer to to_layer) by which a layer reads what it may not."""
    forbidden = forbidden or {"marts": ["staging", "seeds", "raw", "marts"], "obt": ["staging", "seeds", "raw", "vault"], "knowledge": ["staging", "seeds", "raw"]}
    bad = reduce(lambda a, b: a | b, ((F.col("to_layer") == layer) & F.col("from_layer").isin(*reads) for layer, reads in forbidden.items()))
    return edges.filter(bad)


def grain_unique(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Grain values with more than one row."""
    return unique_combo(df, grain)
