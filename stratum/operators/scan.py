"""Numbering, running sums and carried values by prefix scan: no task gets all rows, nor all rows of one key.

Rows are dealt by ranges of their order and sorted there. Each range is summed up (a count, a sum, a
last value), what comes before each range follows from these few summaries, and is added to what the
range's own rows have. A key that spans several ranges is carried on from one to the next the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.sources.scratch import written

_PART, _PLACE = "_scan_part", "_scan_place"


def _placed(df: DataFrame, order: Sequence[str | Column], parts: int | None) -> DataFrame:
    """The rows with their range and their place in it, written, so that both stay as they are. Rows of equal order are dealt out too."""
    spark = df.sparkSession
    by = [*(F.col(c) if isinstance(c, str) else c for c in order), F.col("_scan_tie")]
    ranged = df.withColumn("_scan_tie", F.monotonically_increasing_id()).repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(ranged.withColumn(_PART, F.spark_partition_id()).withColumn(_PLACE, place).drop("_scan_tie"), "ranges")


def _carried(summaries: DataFrame, keys: Sequence[str], combine: str) -> DataFrame:
    """What comes before each range, from (range, keys, value); only for keys that span ranges, two a range at most."""
    if not keys:  # as many rows as ranges
        before, out = None, []
        for row in sorted(summaries.collect(), key=lambda r: r[_PART]):
            out.append((row[_PART], before))
            value = row["_value"]
            before = value if before is None or (combine == "last" and value is not None) else before if combine == "last" or value is None else before + value
        return summaries.sparkSession.createDataFrame(out, f"_part int, _before {summaries.schema['_value'].dataType.simpleString()}")
    spans = summaries.groupBy(*keys).agg(F.min(_PART).alias("_a"), F.max(_PART).alias("_b")).filter("_a < _b")
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    condition = same[0]
    for x in same[1:]:
        condition = condition & x
    few = summaries.alias("s").join(F.broadcast(spans).alias("t"), condition, "left_semi")
    upto = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    value = F.sum("_value").over(upto) if combine == "sum" else F.last("_value", ignorenulls=True).over(upto)
    return few.select(F.col(_PART).alias("_part"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), value.alias("_before"))


def _scan(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, name: str, combine: str, parts: int | None) -> DataFrame:
    placed = _placed(df, [*(F.col(k).asc_nulls_first() for k in keys), *order], parts)
    total = F.sum(value) if combine == "sum" else F.max_by(value, F.when(F.col(value).isNotNull(), F.col(_PLACE)))
    before = _carried(placed.groupBy(_PART, *keys).agg(total.alias("_value")), keys, combine)
    upto = Window.partitionBy(_PART, *keys).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(value).over(upto) if combine == "sum" else F.last(value, ignorenulls=True).over(upto)
    condition = F.col(_PART) == F.col("_part")
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = placed.withColumn("_own", own).join(F.broadcast(before), condition, "left")
    whole = F.coalesce(F.col("_own") + F.col("_before"), "_own", "_before") if combine == "sum" else F.coalesce("_own", "_before")
    return out.withColumn(name, whole).select(*df.columns, name)


def running_sum(df: DataFrame, order: Sequence[str | Column], c: str, keys: Sequence[str] = (), name: str = "running", parts: int | None = None) -> DataFrame:
    """The sum of a column up to each row, by key if there are keys. Nulls add nothing."""
    return _scan(df, list(keys), order, c, name, "sum", parts)


def carried_last(df: DataFrame, order: Sequence[str | Column], c: str, keys: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """The last value of a column that is not null, up to each row, by key."""
    return _scan(df, list(keys), order, c, name, "last", parts)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "n", parts: int | None = None) -> DataFrame:
    """Rows numbered from 1 in one sequence, without a gap."""
    placed = _placed(df, order, parts)
    before = _carried(placed.groupBy(_PART).agg(F.count("*").alias("_value")), (), "sum")
    out = placed.join(F.broadcast(before), F.col(_PART) == F.col("_part"))
    return out.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col(_PLACE) + 1).select(*df.columns, name)


def numbered_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "n", parts: int | None = None) -> DataFrame:
    """Rows numbered from 1 within each key: their number in all less that of the key's first."""
    all_ = numbered(df, [*(F.col(k).asc_nulls_first() for k in keys), *order], "_number", parts)
    first = all_.groupBy(*keys).agg(F.min("_number").alias("_first")).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return all_.join(first, condition).withColumn(name, F.col("_number") - F.col("_first") + 1).select(*df.columns, name)
