"""Joins and groups that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.flat import give_back
from stratum.llm.shared import cut

#: Ids that are broadcast at most (8 bytes each, about 40 MB as a hash table); more are shuffled.
BROADCAST_IDS = 500_000


def only(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (``left_anti``: is not). Broadcasts the ids if their count is within ``bound``, else shuffles both sides."""
    small = ids.limit(bound + 1).count() <= bound
    return df.join(F.broadcast(ids) if small else ids, key, how)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes for no column of ``df`` to have it (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The runs of equal keys of a sorted partition, whole even where batches cut them."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
        held = batch.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held
    held = None
    give_back()


#: Rows of a small intermediate table that one task takes at least.
FEW_ROWS = 100_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of which ``rows`` rows are expected, in no more partitions than they fill: small tables leave few files."""
    return df.coalesce(max(1, rows // FEW_ROWS))


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the undirected links (a, b).

    Alternates large-star and small-star steps until nothing changes; each step is a grouped minimum
    and a join on the node, written to the shared folder. Self-links are allowed, null ends ignored.
    """
    edges = cut(links.filter("a is not null and b is not null").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct())
    n, before = edges.count(), None
    edges = gathered(edges, n)
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = gathered(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), n)
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(edges.filter("a = b").select("a", "b"))
        large = gathered(large.distinct(), n)
        least = gathered(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
        edges = cut(gathered(small.distinct(), n))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    own = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b"))
    return gathered(own.groupBy("node").agg(F.min("component").alias("component")), n)
