"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.flat import flat, frugal, steps
from stratum.llm.labels import class_weights, sample_labelled
from stratum.llm.shared import bounded_batches

#: Lengths of the n-grams in bytes, and the bits of the hash that names them.
ORDERS, BITS = (3, 4, 5), 20
#: Labelled documents of each class that the model is fitted on at most, and n-grams that it keeps.
PER_CLASS, FEATURES = 10_000, 16_384

#: Bytes of text in one numpy step: each makes about 60 times as much of n-grams.
STEP_BYTES = 512 << 10

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


@dataclass
class LinearModel:
    """Weight of each hashed n-gram's presence (0 for most), and the intercept."""

    weights: np.ndarray
    intercept: float


def ngrams(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of every text, each once a text, as (text's row, id); only those that ``keep`` marks."""
    folded = _FOLD[data]
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    ends = offsets[1:]
    out = []
    for n in ORDERS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) ^ folded[j : len(data) - n + 1 + j]
        h = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
        at = np.flatnonzero(keep[h]) if keep is not None else np.arange(len(h))
        at = at[at + n <= ends[rows[at]]]
        out.append(rows[at] << BITS | h[at])
    both = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return both >> BITS, both & (1 << BITS) - 1


def _counts(sample: DataFrame, text: str) -> DataFrame:
    """id, p, q: documents of class 1 and of class 0 that hold the n-gram."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, 1 << BITS), np.int64)
        for part in steps(batches, text, STEP_BYTES):
            rows, ids = ngrams(*flat(part.column(text)))
            y = part.column("y").to_numpy()[rows]
            for k in (0, 1):
                both[k] += np.bincount(ids[y == k], minlength=1 << BITS)
        ids = np.flatnonzero(both.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(both[1, ids]), pa.array(both[0, ids])], ["id", "p", "q"])

    return sample.mapInArrow(run, "id long, p long, q long").groupBy("id").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def _chosen(counts: DataFrame, n1: int, n0: int, features: int, w1: float = 1.0, w0: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that tell the classes apart best (log-likelihood ratio), and their log-count ratios; a document of a class counts w1 or w0 times."""

    def part(seen: str, total: int, rate) -> F.Column:
        miss = F.lit(total) - F.col(seen)
        there = F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) / total / rate)).otherwise(0.0)
        return there + F.when(miss > 0, miss * F.log(miss / total / (1 - rate))).otherwise(0.0)

    rate = (F.col("p") * w1 + F.col("q") * w0) / (n1 * w1 + n0 * w0)
    gain = F.when(F.col("p") + F.col("q") < n1 + n0, part("p", n1, rate) * w1 + part("q", n0, rate) * w0).otherwise(0.0)
    ratio = F.log((F.col("p") + 1) / (n1 + 2)) - F.log((F.col("q") + 1) / (n0 + 2))
    best = counts.filter("p + q >= 3").select("id", gain.alias("gain"), ratio.alias("ratio")).orderBy(F.desc("gain"), "id").limit(features).toPandas()
    order = np.argsort(best["id"].to_numpy())
    return best["id"].to_numpy()[order], best["ratio"].to_numpy()[order]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", per_class: int = PER_CLASS, features: int = FEATURES) -> LinearModel:
    """Fit on a bounded sample of ``labels`` (rows that may be learned from).

    Where a class is over the bound, its documents weigh more, so that the classes keep the shares that they have in ``labels``.
    Where a class has no documents, the model gives everything the share of class 1 (0.5 without labels).
    """
    from pyspark.ml.classification import LogisticRegression  # here, so that workers that only score don't load it
    from pyspark.ml.linalg import Vectors, VectorUDT

    sample = sample_labelled(docs, labels, label, per_class, text)
    counts = _counts(sample, text).persist()
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    weights = np.zeros(1 << BITS, np.float32)
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not (n1 and n0):
        return LinearModel(weights, 0.0 if n1 == n0 else 12.0 if n1 else -12.0)
    w0, w1 = class_weights(labels, label, per_class)
    ids, ratios = _chosen(counts, n1, n0, features, w1, w0)
    counts.unpersist()
    if not len(ids):
        return LinearModel(weights, float(np.log(n1 * w1 / (n0 * w0))))
    keep = np.zeros(1 << BITS, bool)
    keep[ids] = True
    place = np.zeros(1 << BITS, np.int32)
    place[ids] = np.arange(len(ids))

    @frugal
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text, STEP_BYTES):
            rows, grams = ngrams(*flat(part.column(text)), keep)
            at = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.ListArray.from_arrays(at, place[grams])], ["y", "at"])

    vector = F.udf(lambda at: Vectors.sparse(len(ratios), at, ratios[at]) if at else Vectors.sparse(len(ratios), [], []), VectorUDT())
    train = sample.mapInArrow(found, "y int, at array<int>").select(F.col("y").cast("double").alias("label"), vector("at").alias("features"), F.when(F.col("y") == 1, w1).otherwise(w0).alias("weight")).persist()
    model = LogisticRegression(maxIter=60, regParam=0.002, elasticNetParam=0.0, standardization=False, weightCol="weight").fit(train)
    train.unpersist()
    weights[ids] = model.coefficients.toArray() * ratios
    return LinearModel(weights, float(model.intercept))


def score(docs: DataFrame, model: LinearModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (in place of one that has this name): the probability of class 1 by the whole text; a null text is empty."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() == name.lower()))
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = sent.value
        keep = weights != 0
        for part in steps(batches, text, STEP_BYTES):
            rows, grams = ngrams(*flat(part.column(text)), keep)
            sums = np.bincount(rows, weights[grams], part.num_rows) + intercept
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(sums, -500, 500))))], [*part.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{name}` double")
