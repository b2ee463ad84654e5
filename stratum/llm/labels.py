"""Labelled samples of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null ids count as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor


def _one_label(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and y of every document with a label of 0 or 1; 1 wins."""
    y = F.col(label).cast("int")
    return labels.filter(F.col("doc_id").isNotNull() & y.isin(0, 1)).groupBy("doc_id").agg(F.max(y).alias("y"))


def class_weights(labels: DataFrame, label: str, per_class: int) -> tuple[float, float]:
    """How many labelled documents of class 0 and of class 1 each one in :func:`sample_labelled` stands for; 1 where all are in it."""
    n = {r["y"]: r["n"] for r in _one_label(labels, label).groupBy("y").agg(F.count("*").alias("n")).collect()}
    return tuple(max(1.0, n.get(y, 0) / per_class) for y in (0, 1))


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, text: str = "text", seed: int = 0) -> DataFrame:
    """doc_id, text and y of at most ``per_class`` labelled documents of each class, evenly spread by a hash.

    ``labels`` holds only rows that may be learned from. The sampled ids, of bounded number, are
    broadcast; texts are not shuffled.
    """
    one = _one_label(labels, label)
    order = [F.xxhash64("doc_id", F.lit(seed)), "doc_id"]
    chosen = one.filter("y = 0").orderBy(*order).limit(per_class).union(one.filter("y = 1").orderBy(*order).limit(per_class))
    return docs.select(F.col("doc_id").cast("long"), text).join(F.broadcast(chosen.select(F.col("doc_id").cast("long"), "y")), "doc_id")
