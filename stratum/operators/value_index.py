"""One inverted index of the values of many columns: foreign keys, overlaps and join fan-outs of all tables from one scan each.

The index holds how often each value of each column stands. What columns share is then a matter of
the sets of columns that hold a value: there are few such sets, so they are counted before pairs of
columns are made of them, and no pair of tables is ever joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions.scalars import ratio
from stratum.operators.profile import INTEGRAL, SAMPLE_FLOOR, classify_fanout, family, key_columns
from stratum.operators.relational import pairs
from stratum.sources.scratch import written


def _text(field: T.StructField) -> Column:
    """The value as text, alike for alike values of one family."""
    c = F.col(f"`{field.name}`")
    if family(field.dataType) == "temporal":
        return c.cast("timestamp").cast("string")
    if family(field.dataType) == "numeric" and not isinstance(field.dataType, INTEGRAL):
        whole = (c == F.floor(c)) & (F.abs(c) < 9e15)
        return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def value_index(frames: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """table_name, column_name, family, k (the value as text), n (rows that hold it; a null k counts the nulls).

    Columns of nested types are left out. Each table is read once, and its values are counted before they are shuffled.
    """
    parts = []
    for name, df in frames.items():
        fields = [f for f in df.schema.fields if family(f.dataType) != "other" and (columns is None or f.name in columns.get(name, ()))]
        if fields:
            cells = F.array(*(F.struct(F.lit(f.name).alias("column_name"), F.lit(family(f.dataType)).alias("family"), _text(f).alias("k")) for f in fields))
            parts.append(df.select(F.lit(name).alias("table_name"), F.inline(cells)).groupBy("table_name", "column_name", "family", "k").agg(F.count("*").alias("n")))
    return reduce(DataFrame.union, parts)


def inclusions(index: DataFrame) -> DataFrame:
    """from_table, from_column, to_table, to_column, distinct_keys, matched: for every two columns of a family that share a value, how many of the first's values the second holds."""
    holder = F.struct("table_name", "column_name")
    sets = index.filter("k is not null").groupBy("family", "k").agg(F.sort_array(F.collect_set(holder)).alias("holders"))
    patterns = sets.groupBy("holders").agg(F.count("*").alias("n"))
    both = patterns.select(F.explode("holders").alias("a"), "holders", "n").select("a", F.explode("holders").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("matched"))
    own = both.filter("a = b").select("a", F.col("matched").alias("distinct_keys"))
    out = both.filter("a <> b").join(own, "a")
    return out.select(F.col("a.table_name").alias("from_table"), F.col("a.column_name").alias("from_column"), F.col("b.table_name").alias("to_table"), F.col("b.column_name").alias("to_column"), "distinct_keys", "matched")


def find_foreign_keys(frames: Mapping[str, DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """Every pair of tables with an equally named column of the same family, both directions, medium confidence or better."""
    shared = {c for x, y in pairs(list(frames)) for c in set(frames[x].columns) & set(frames[y].columns) if columns is None or c in columns}
    if not shared:
        return next(iter(frames.values())).sparkSession.createDataFrame([], "from_table string, to_table string, key string, integrity double, confidence string")
    found = inclusions(value_index(frames, {name: [c for c in df.columns if c in shared] for name, df in frames.items()})).filter("from_column = to_column and from_table <> to_table")
    integrity = F.round(ratio("matched", "distinct_keys"), 6)
    confidence = F.when(integrity >= 0.95, "high").when(integrity >= 0.80, "medium").otherwise("none")
    return found.select("from_table", "to_table", F.col("from_column").alias("key"), integrity.alias("integrity"), confidence.alias("confidence")).filter("confidence <> 'none'")


def _sampled(index: DataFrame, n: int) -> DataFrame:
    """The first n values of each column in the order of a hash; each task keeps n of a column at most."""
    order = Window.partitionBy("table_name", "column_name").orderBy(F.md5(F.col("k")), "k")
    return index.filter("k is not null").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).select("table_name", "column_name", "family", "k")


def overlaps(index: DataFrame, n: int = 200, least: float = 0.5) -> DataFrame:
    """Of n sampled values of each column, the share that each column of another table of the family holds; pairs from ``least`` on."""
    index = written(index, "values")
    sample = _sampled(index, n).select(F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"), "family", "k")
    size = sample.groupBy("from_table", "from_column").agg(F.count("*").alias("sampled"))
    other = index.select(F.col("table_name").alias("to_table"), F.col("column_name").alias("to_column"), "family", "k")
    hits = sample.join(other, ["family", "k"]).filter("from_table <> to_table").groupBy("from_table", "from_column", "to_table", "to_column").agg(F.count("*").alias("matched"))
    return hits.join(size, ["from_table", "from_column"]).withColumn("overlap", F.round(ratio("matched", "sampled"), 6)).filter(F.col("overlap") >= least)


def sweep_pairs(frames: Mapping[str, DataFrame], n: int = 500) -> DataFrame | None:
    """Join cardinality (as J25) of all pairs of tables with a shared key-like column, by the rows of one index; None if there are none.

    direction, key, the figures of the fan-out, fanout_class, is_safe, is_top (from the smaller table; ties: the first) and the pair's safe_direction.
    """
    both = [(x, y, c) for x, y in pairs(list(frames)) for c in sorted(set(key_columns(frames[x])) & set(frames[y].columns))]
    if not both:
        return None
    spark = next(iter(frames.values())).sparkSession
    wanted = {name: sorted({c for x, y, c in both if name in (x, y)}) for name in frames}
    index = written(value_index(frames, wanted), "values")
    ways = [(x, y, c, f"{x}->{y}", 0, i) for i, (x, y, c) in enumerate(both)] + [(y, x, c, f"{y}->{x}", 1, i) for i, (x, y, c) in enumerate(both)]
    plan = F.broadcast(spark.createDataFrame(ways, "table_name string, partner string, column_name string, direction string, second int, pair int"))  # as many rows as pairs of tables
    rows = index.groupBy("table_name", "column_name").agg(F.sum("n").alias("table_rows"))
    probe = _sampled(index, n).join(plan, ["table_name", "column_name"])
    partners = index.filter("k is not null").select(F.col("table_name").alias("partner"), "column_name", "family", "k", "n")
    found = probe.join(partners, ["partner", "column_name", "family", "k"], "left")
    hits = F.coalesce("n", F.lit(0))
    whole = lambda e: F.round(F.coalesce(e, F.lit(0.0)), 6)
    way = ["pair", "second", "direction", "column_name", "table_name", "partner"]
    figures = found.groupBy(*way).agg(F.count("k").alias("sampled"), F.count_if(hits > 0).alias("matched"), whole(F.avg(hits.cast("double"))).alias("avg_fanout"), F.max(hits).cast("long").alias("max_fanout"), whole(F.stddev_pop(hits.cast("double"))).alias("stddev_fanout"))
    none = {c: F.coalesce(c, F.lit(0)) for c in ("sampled", "matched", "max_fanout")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("avg_fanout", "stddev_fanout")}
    figures = plan.join(figures.drop("direction", "table_name", "partner"), ["pair", "second", "column_name"], "left").withColumns(none)
    figures = figures.withColumn("sample_saturated", F.col("sampled").between(1, SAMPLE_FLOOR - 1)).withColumn("fanout_class", classify_fanout())
    figures = figures.withColumn("is_safe", F.col("fanout_class").isin("per_record_key", "header_detail"))
    figures = figures.join(F.broadcast(rows), ["table_name", "column_name"]).join(F.broadcast(rows.select(F.col("table_name").alias("partner"), "column_name", F.col("table_rows").alias("partner_rows"))), ["partner", "column_name"])
    top = F.when(F.col("second") == 0, F.col("table_rows") <= F.col("partner_rows")).otherwise(F.col("table_rows") < F.col("partner_rows"))
    rank = F.when(F.col("fanout_class") == "per_record_key", 0).otherwise(2) + F.col("second")
    safe = figures.filter("is_safe").groupBy("pair").agg(F.min_by("direction", rank).alias("safe_direction"))
    return figures.withColumn("is_top", top).join(safe, "pair", "left").select("direction", F.col("column_name").alias("key"), "sampled", "matched", "avg_fanout", "max_fanout", "stddev_fanout", "sample_saturated", "fanout_class", "is_safe", "is_top", "safe_direction")
