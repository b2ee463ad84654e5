"""Quality: compression by two zstandard dictionaries, one built from good texts and one from bad.

A text is cut into short blocks, so that the dictionaries and not its own earlier parts explain it.
The normalised difference of the compressed sizes goes through a fitted logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.flat import steps, texts_as_bytes
from stratum.llm.labels import sample_labelled
from stratum.llm.tables import free_name

BLOCK_BYTES, DICTIONARY_BYTES, LEVEL = 1024, 112_640, 1
#: Labelled documents of each class for the dictionaries, blocks of each for them, and documents for the curve.
PER_CLASS, BLOCKS_EACH, CALIBRATION = 3_000, 4, 3_000


@dataclass
class CompressionModel:
    """Two dictionaries and the logistic curve over the normalised difference."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of few samples, their end as raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\0" + b"\n".join(samples)[-DICTIONARY_BYTES:]  # never taken for a trained one


def _sizes(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Normalised difference of compressed sizes, above 0 where the good dictionary does better; 0 for no text."""
    both = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (good, bad)]
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        blocks = _blocks(text)
        g, b = (sum(len(c.compress(x)) for x in blocks) for c in both)
        out[i] = (b - g) / max(1, b + g)
    return out


def differences(docs: DataFrame, good: bytes, bad: bytes, text: str = "text", name: str = "difference") -> DataFrame:
    """``docs`` with the normalised difference of each whole text; a null text is empty."""
    sent = docs.sparkSession.sparkContext.broadcast((good, bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_sizes(texts_as_bytes(part.column(text)), *sent.value))], [*part.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{name}` double")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a weak pull to 0; ``x`` is brought to unit spread first."""
    spread = x.std() or 1.0
    design, beta = np.stack([x / spread, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T * (p * (1 - p)) @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / spread), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", per_class: int = PER_CLASS, calibration: int = CALIBRATION) -> CompressionModel:
    """Build the dictionaries and the curve from bounded samples of ``labels`` (rows that may be learned from).

    The curve is fitted on documents that the dictionaries haven't seen where there are enough, at
    the classes' own shares. Where a class has no documents, every score is the share of class 1.
    """
    keyed = labels.withColumn("_half", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(3)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            ids, places, ys, blocks = [], [], [], []
            for doc, y, raw in zip(part.column("doc_id").to_pylist(), part.column("y").to_pylist(), texts_as_bytes(part.column(text)), strict=True):
                own = [x for x in _blocks(raw) if len(x) >= 8]
                for k in range(0, len(own), max(1, -(-len(own) // BLOCKS_EACH))):  # evenly spread over the text
                    ids.append(doc)
                    places.append(k)
                    ys.append(y)
                    blocks.append(own[k])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(ys, pa.int32()), pa.array(blocks, pa.binary())], ["doc", "k", "y", "block"])

    blocks = sample_labelled(docs, keyed.filter("_half < 2"), label, per_class, text, seed=1).mapInArrow(pick, "doc long, k int, y int, block binary").toPandas().sort_values(["y", "doc", "k", "block"])
    sets = {y: [bytes(x) for x in blocks.loc[blocks["y"] == y, "block"]] for y in (0, 1)}
    if not (sets[0] and sets[1]):
        return CompressionModel(b"", b"", 0.0, 12.0 if sets[1] else -12.0 if sets[0] else 0.0)
    good, bad = _dictionary(sets[1]), _dictionary(sets[0])
    fresh = keyed.filter("_half = 2")
    shares = {r["y"]: r["n"] for r in labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).collect()}
    seen = differences(sample_labelled(docs, fresh, label, calibration, text, seed=2), good, bad, text).select("y", "difference").toPandas()
    x, y = seen["difference"].to_numpy(), seen["y"].to_numpy()
    if len(set(y)) < 2:
        return CompressionModel(good, bad, 60.0, 1.0)
    slope, intercept = _logistic(x, y)
    # The sample holds the classes in other shares than the labels do.
    intercept += np.log(shares[1] / shares[0]) - np.log((y == 1).sum() / (y == 0).sum())
    return CompressionModel(good, bad, slope, float(intercept))


def score(docs: DataFrame, model: CompressionModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (in place of one that has this name): the probability of class 1 by the whole text; a null text is empty."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() == name.lower()))
    if not model.good:
        return docs.withColumn(name, F.lit(1 / (1 + np.exp(-model.intercept))))
    difference = free_name(docs, "difference")
    out = differences(docs, model.good, model.bad, text, difference)
    return out.withColumn(name, 1 / (1 + F.exp(-F.col(difference) * model.slope - model.intercept))).drop(difference)
