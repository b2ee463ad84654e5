"""Joins, aggregates, windows, ordering and sets (inventory D, E, F, G, H)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.operators import scan
from stratum.functions.scalars import col, ratio
from stratum.operators.vault import current_row


def inner(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Inner equi-join."""
    return a.join(b, key, "inner")


def enrich(fact: DataFrame, dims: Mapping[str, tuple[DataFrame, str | Sequence[str]]]) -> DataFrame:
    """Left joins of dimensions, name to (frame, key columns that both sides have); Spark broadcasts by size."""
    for dim, key in dims.values():
        fact = fact.join(dim, key, "left")
    return fact


def join_expr(a: DataFrame, b: DataFrame, left: Column, right: Column, how: str = "inner") -> DataFrame:
    """Equi-join of two expressions, computed once on each side."""
    return a.withColumn("_k", left).join(b.withColumn("_k", right), "_k", how).drop("_k")


def cross_one_row(*dfs: DataFrame) -> DataFrame:
    """One-row aggregates side by side."""
    return reduce(lambda x, y: x.crossJoin(F.broadcast(y)), dfs)


def expected_grid(df: DataFrame, a: str, b: str) -> DataFrame:
    """Combinations of the columns' values that have no row. The grid is asked for: two lists of distinct values, of which Spark broadcasts one if it is small."""
    grid = df.select(a).distinct().crossJoin(df.select(b).distinct())
    return grid.join(df.select(a, b).distinct(), [a, b], "left_anti")


def anti(a: DataFrame, b: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows of a without a partner."""
    return a.join(b, keys, "left_anti")


def semi(a: DataFrame, b: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows of a with a partner."""
    return a.join(b, keys, "left_semi")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose non-null key has no parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")


def path_join(frames: Sequence[DataFrame], keys: Sequence[str | Sequence[str]]) -> DataFrame:
    """Frames joined one after another."""
    out = frames[0]
    for df, key in zip(frames[1:], keys, strict=True):
        out = out.join(df, key)
    return out


def bridge_join(t1: DataFrame, t3: DataFrame, t2: DataFrame, key1: str, key2: str) -> DataFrame:
    """t1 to t2 by way of t3, rows of t1 without a partner staying."""
    return t1.join(t3, key1, "left").join(t2, key2, "left")


def decode_join(df: DataFrame, decoder: DataFrame, key: str) -> DataFrame:
    """Labels from a reference table."""
    return df.join(decoder, key, "left")


def with_calendar(df: DataFrame, calendar: DataFrame, date_col: str, key: str = "date_day") -> DataFrame:
    """The calendar's columns for the date."""
    return df.join(calendar, df[date_col] == calendar[key], "left").drop(calendar[key])


def agg_then_join(a: DataFrame, b: DataFrame, keys: Sequence[str], aggs_a: Sequence[Column], aggs_b: Sequence[Column], how: str = "left") -> DataFrame:
    """Both sides grouped first, so that the join can't fan out."""
    return a.groupBy(*keys).agg(*aggs_a).join(b.groupBy(*keys).agg(*aggs_b), list(keys), how)


def dedupe_then_join(a: DataFrame, b: DataFrame, key: str, ts: str, tiebreak: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """The newest row of b per key, then the join."""
    return a.join(current_row(b, key, tiebreak, ts), key, how)


def totals(df: DataFrame, aggs: Sequence[Column]) -> DataFrame:
    """One row."""
    return df.agg(*aggs)


def group(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """E2."""
    return df.groupBy(*keys).agg(*aggs)


def distinct_counts(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Several distinct counts per group."""
    return df.groupBy(*keys).agg(*(F.countDistinct(c).alias(f"distinct_{c}") for c in cols))


def cond_agg(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """Rows of each group that meet each condition."""
    return df.groupBy(*keys).agg(*(F.count(F.when(c, 1)).alias(n) for n, c in conditions.items()))


def count_where(cond: Column) -> Column:
    """E5."""
    return F.count_if(cond)


def distinct_where(c: str | Column, cond: Column) -> Column:
    """E6."""
    return F.countDistinct(F.when(cond, col(c)))


def tuple_distinct(cols: Sequence[str]) -> Column:
    """Distinct tuples, those with nulls included."""
    return F.countDistinct(F.struct(*cols))


def rate(cond: Column) -> Column:
    """Share of rows that meet the condition; null counts as not."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def any_true(c: str | Column) -> Column:
    """E9."""
    return F.bool_or(col(c))


def any_match(df: DataFrame, key: str, cond: Column, name: str = "any_match") -> DataFrame:
    """1 for keys with a row that meets the condition, else 0."""
    return df.groupBy(key).agg(F.max(F.when(cond, 1).otherwise(0)).alias(name))


def quantiles(c: str | Column, ps: Sequence[float]) -> Column:
    """Exact quantiles with linear interpolation, in a buffer of a group's distinct values; for whole columns see :mod:`stratum.operators.quantile`."""
    return F.percentile(col(c), F.array(*map(F.lit, ps)))


def stddev_pop(c: str | Column) -> Column:
    """E12."""
    return F.stddev_pop(col(c))


def approx_distinct(df: DataFrame, cols: Sequence[str], error: float = 0.02) -> DataFrame:
    """One row of approximate distinct counts of the given relative standard error (Spark's own default of 5 % is off by over a tenth once in 20 times)."""
    return df.agg(*(F.approx_count_distinct(c, error).alias(c) for c in cols))


def having(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], cond: str | Column) -> DataFrame:
    """E14."""
    return df.groupBy(*keys).agg(*aggs).filter(cond)


def distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """E15."""
    return df.select(*cols).distinct()


def ratio_of_sums(num: str | Column, den: str | Column) -> Column:
    """Not the mean of ratios."""
    return ratio(F.sum(col(num)), F.sum(col(den)))


def matrix(df: DataFrame, row: str, column: str, values: Sequence, agg: Column) -> DataFrame:
    """A column per value."""
    return df.groupBy(row).pivot(column, list(values)).agg(agg)


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """E18."""
    return df.groupBy(c).agg(F.count("*").alias("n"))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Overlap of two array columns as sets; 0 if both are empty."""
    return F.coalesce(ratio(F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b)))), F.lit(0.0))


def list_agg(df: DataFrame, keys: Sequence[str], c: str, sep: str = ",") -> DataFrame:
    """Each group's values, sorted, as one text."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(c)), sep).alias(c))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """the first row of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def next_value(df: DataFrame, key: str, order: Sequence[str], c: str, name: str = "next_value") -> DataFrame:
    """F3."""
    return df.withColumn(name, F.lead(c).over(Window.partitionBy(key).orderBy(*order)))


def sequence_numbers(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """numbers from both ends."""
    up, down = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("seq", F.row_number().over(up)).withColumn("reverse_seq", F.row_number().over(down))


def running_sum(df: DataFrame, order: Sequence[str], c: str, keys: Sequence[str] = (), name: str = "running") -> DataFrame:
    """sum up to the row; by key where there are keys (for one that may hold a large share of all rows, see :mod:`stratum.operators.scan`)."""
    if not keys:
        return scan.running_sum(df, order, c, name=name)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(c).over(w))


def grand_total(df: DataFrame, c: str, name: str = "total") -> DataFrame:
    """the total beside every row, as an aggregate that is broadcast, not a window in one partition."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(c).alias(name))))


def share_of_total(df: DataFrame, dim: str, measure: str, scale: int = 2) -> DataFrame:
    """each group's sum and its percentage of all."""
    sums = df.groupBy(dim).agg(F.sum(measure).alias(measure))
    return grand_total(sums, measure, "_total").withColumn("pct_of_total", F.round(100 * ratio(measure, "_total"), scale)).drop("_total")


def cumulative_flow(df: DataFrame, month: str, measure: str) -> DataFrame:
    """F8: monthly net and its running sum."""
    return running_sum(df.groupBy(month).agg(F.sum(measure).alias("net")), [month], "net", name="cumulative")


def latest_value(df: DataFrame, key: str, order: str, c: str) -> DataFrame:
    """the value at the latest period of each group."""
    return df.groupBy(key).agg(F.max_by(c, order).alias(c))


def top1(df: DataFrame, measure: str, tiebreak: str) -> DataFrame:
    """G2."""
    return df.orderBy(F.desc(measure), tiebreak).limit(1)


def top_groups(df: DataFrame, dim: str, measure: str, n: int = 10) -> DataFrame:
    """The n largest sums and each one's percentage of those shown."""
    best = df.groupBy(dim).agg(F.sum(measure).alias(measure)).orderBy(F.desc(measure), dim).limit(n)
    return grand_total(best, measure, "_shown").withColumn("pct_of_top_n", F.round(100 * ratio(measure, "_shown"), 2)).drop("_shown")


def top_values(df: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """The n most frequent values of each column, from one pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols))
    counts = df.select(F.inline(pairs)).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def order_by_rank(df: DataFrame, c: str, ranks: Sequence) -> DataFrame:
    """Order of presentation by a list; values outside it come last."""
    rank = reduce(lambda acc, x: acc.when(F.col(c) == x[1], x[0]), enumerate(ranks), F.when(F.lit(False), -1))
    return df.orderBy(rank.otherwise(len(ranks)), c)


def recent(df: DataFrame, ts: str, tiebreak: str, n: int = 50) -> DataFrame:
    """The newest rows."""
    return df.orderBy(F.desc(ts), tiebreak).limit(n)


def sample_keys(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """N distinct keys in the order of a hash, the same on every run and engine."""
    text = F.concat_ws("||", *(F.col(k).cast("string") for k in keys))
    return df.select(*keys).dropna().distinct().orderBy(F.md5(text), *keys).limit(n)


def stack_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """H1: name and n of every frame."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in frames.items()))


def profile_stack(df: DataFrame, exprs: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """H2: a row per column with the named aggregates, all from one pass."""
    one = df.agg(*(e.alias(f"{c}\0{n}") for c, by in exprs.items() for n, e in by.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"`{c}\0{n}`").alias(n) for n in by)) for c, by in exprs.items()))))


def missing_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """H3: rows of a that b lacks, as sets."""
    return a.subtract(b)


def value_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """H4: each value with in_left and in_right."""
    left, right = a.select(key).distinct().withColumn("in_left", F.lit(True)), b.select(key).distinct().withColumn("in_right", F.lit(True))
    return left.join(right, key, "full_outer").select(key, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """H5: date_day from start to end."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date_day"))


def month_schedule(df: DataFrame, start: str | Column, end: str | Column, name: str = "month") -> DataFrame:
    """H6: a row for every month from start's to end's."""
    first = F.trunc(col(start), "MM")
    return df.select("*", F.explode(F.when(first <= col(end), F.sequence(first, col(end).cast("date"), F.expr("interval 1 month")))).alias(name))


def pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    """H7: unordered pairs of table names (metadata only)."""
    return list(combinations(sorted(names), 2))
