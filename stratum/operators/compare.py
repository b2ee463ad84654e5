"""Comparison of two versions of a table by a tree of fingerprints (A8, A10, K10): only buckets that differ are read.

A table is stored by buckets of its key's hash. A bucket's fingerprint is its number of rows and the
sum of their hashes, which no order changes; groups of buckets have the sums of theirs. Two versions
are compared from the top: where a group agrees, nothing below it is looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of a table, and children of a group; powers of the latter.
BUCKETS, FANOUT = 256, 16


def bucketed(df: DataFrame, keys: Sequence[str], path: str, buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` by buckets of its key (and the fingerprints beside it), and return it as stored, with ``_bucket``."""
    spark = df.sparkSession
    marked = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    marked.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/rows")
    stored = spark.read.schema(marked.schema).parquet(f"{path}/rows")
    fingerprints(stored, df.columns).write.mode("overwrite").parquet(f"{path}/fingerprints")
    return stored


def fingerprints(stored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """_bucket, n and the sums of two hashes of each bucket's rows. Columns in the order of their names; null and empty differ."""
    cells = [x for c in sorted(columns) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)"))
    return stored.groupBy("_bucket").agg(F.count("*").alias("n"), wide(1).alias("h1"), wide(2).alias("h2"))


def differing_buckets(old: DataFrame, new: DataFrame, buckets: int = BUCKETS, fanout: int = FANOUT) -> list[int]:
    """The buckets whose fingerprints differ, found level by level from two tables of fingerprints (of a row a bucket)."""
    levels = max(1, round(math.log(buckets, fanout)))
    able: list[int] | None = None
    for level in range(levels + 1):
        width = max(1, buckets // fanout**level)
        node = F.floor(F.col("_bucket") / width).cast("int").alias("node")
        below = lambda df: df if able is None else df.filter(F.floor(F.col("_bucket") / (width * fanout)).cast("int").isin(able))  # noqa: B023, E731
        sums = lambda df, p: below(df).groupBy(node).agg(*(F.sum(c).alias(f"{p}{c}") for c in ("n", "h1", "h2")))  # noqa: B023, E731
        both = sums(old, "a").join(sums(new, "b"), "node", "full")
        same = F.lit(True)
        for c in ("n", "h1", "h2"):
            same = same & F.col(f"a{c}").eqNullSafe(F.col(f"b{c}"))
        able = sorted(r["node"] for r in both.filter(~same).collect())  # as many as there are buckets at most
        if not able:
            return []
    return able


def changed_keys(spark, old_path: str, new_path: str, keys: Sequence[str], buckets: int = BUCKETS, fanout: int = FANOUT) -> DataFrame:
    """The keys and ``change`` (added, missing or changed) between two versions stored by :func:`bucketed`; reads only buckets that differ.

    Keys are unique in each version; of rows with equal keys the greatest hash stands for them. Null keys are keys.
    """
    read = lambda path, name: spark.read.parquet(f"{path}/{name}")
    differing = differing_buckets(read(old_path, "fingerprints"), read(new_path, "fingerprints"), buckets, fanout)
    sides = []
    for path, mark in ((old_path, "_old"), (new_path, "_new")):
        rows = read(path, "rows").filter(F.col("_bucket").isin(differing)) if differing else read(path, "rows").filter("false")
        columns = sorted(c for c in rows.columns if c != "_bucket")
        digest = F.struct(*(F.xxhash64(F.lit(seed), *(x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`")))).alias(f"h{seed}") for seed in (1, 2)))
        sides.append(rows.groupBy(*keys).agg(F.max(digest).alias(mark)))
    old, new = sides[0].alias("o"), sides[1].alias("n")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "missing").otherwise("changed")
    both = old.join(new, same, "full").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(*(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys), change.alias("change"))
