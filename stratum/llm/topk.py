"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Vectors are quantised to integers and dealt into blocks by a hash of their id. A block's index is one
posting list (vector, dimension, component), ordered by descending impact (absolute component, in
quantised levels) and cut between levels into segments. A block of queries takes the segments in that
order and adds each posting's product to its vector's score. What the segments still to come can change
a score by is bounded by the length of the vector's unseen components times the length of the query's
components in the same dimensions; the search stops only when that proves that few vectors can still
be among the k best, and rescores exactly all that can.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of an index block, queries of a query block and of one step, quantised impact levels.
INDEX_BLOCK, QUERY_BLOCK, QUERY_STEP, LEVELS = 8192, 1024, 128, 128
#: Shares of the postings after which a segment ends, at the end of a level.
SEGMENTS = (0.8, 0.92, 1.0)
#: A step stops when no query has more possible members than this many times k.
POSSIBLE = 8


def quantise(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as long; null where the vector is null or holds null, NaN or infinity."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _packed(rows: DataFrame, key: str, width: int) -> DataFrame:
    """One row per block: ids and the vectors as bytes, sorted by id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        matrix = np.zeros((len(pdf), width), "<i8")
        for i, v in enumerate(pdf["v"]):
            matrix[i, : len(v)] = v
        return pd.DataFrame({key: [pdf[key].iloc[0]], "ids": [pdf["id"].to_numpy("<i8").tobytes()], "matrix": [matrix.tobytes()]})

    return rows.groupBy(key).applyInPandas(run, f"{key} long, ids binary, matrix binary")


def impact_order(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The postings by descending quantised impact, and where each segment ends: at the end of the level that reaches its share."""
    size = np.abs(values)
    level = size * LEVELS // (size.max(initial=0) + 1)
    upto = np.cumsum(np.bincount(level, minlength=LEVELS)[::-1])
    ends = np.unique(upto[np.searchsorted(upto, np.array(SEGMENTS) * len(values))]) if len(values) else np.zeros(1, np.int64)
    return np.argsort(-level, kind="stable"), ends


def _indexed(blocks: DataFrame, width: int) -> DataFrame:
    """Each block with its postings by descending quantised impact and the segments' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = np.frombuffer(row["matrix"], "<i8")
                order, ends = impact_order(values)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([row["ids"]]), pa.array([row["matrix"]]), pa.array([order.astype("<i4").tobytes()]), pa.array([ends.astype("<i8").tobytes()])], ["block", "ids", "matrix", "postings", "ends"])

    return blocks.mapInArrow(run, "block long, ids binary, matrix binary, postings binary, ends binary")


def possible_members(matrix: np.ndarray, postings: np.ndarray, ends: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query, the rows of ``matrix`` that may be among its k best, ties included."""
    n = len(matrix)
    if n <= k:
        return [np.arange(n)] * len(queries)
    q = queries.astype(np.float64)
    scores = np.zeros((len(q), n))
    left, unseen = matrix.astype(np.float64).ravel(), np.ones(matrix.size, np.float64)
    start = 0
    for end in ends.tolist():
        segment = postings[start:end]
        added = np.zeros(matrix.size)
        added[segment] = left[segment]
        left[segment] = unseen[segment] = 0
        scores += q @ added.reshape(matrix.shape).T
        start = end
        if end == len(postings):
            slack = np.full(scores.shape, 0.5)
        else:
            rest = np.sqrt((left * left).reshape(matrix.shape).sum(1))
            slack = np.sqrt((q * q) @ unseen.reshape(matrix.shape).T) * rest + 0.5
        floor = np.partition(scores - slack, n - k, axis=1)[:, n - k]
        able = scores + slack >= floor[:, None]
        if able.sum(1).max() <= POSSIBLE * k:
            break
    return [np.flatnonzero(x) for x in able]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors with the highest integer inner product.

    Ties go to the smaller id. Rows of ``vectors`` with the query's id are the query's own and no
    candidates of it. Vectors that are null or hold null or non-finite components, and null ids, take
    no part; shorter vectors count as filled up with 0 (so an empty one scores 0). Fewer candidates
    than k give fewer rows; empty tables give none. Scores must fit 53 bits.
    """
    read = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), quantise(vector, scale).alias("v")).filter("id is not null and v is not null")
    base, asked = read(vectors), read(queries)
    n, width = base.agg(F.count("*"), F.max(F.size("v"))).first()
    n_queries, wide = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    width, n_index, n_asked = max(width or 0, wide or 0, 1), max(1, -(-n // INDEX_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    deal = lambda df, name, m: df.withColumn(name, F.pmod(F.xxhash64("id", *([] if name == "qblock" else [F.hash("v")])), F.lit(m)))
    index = _indexed(_packed(deal(base, "block", n_index), "block", width), width)
    blocks = _packed(deal(asked, "qblock", n_asked), "qblock", width).select("qblock", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_buffer() for name in ("ids", "matrix", "postings", "ends", "q_ids", "q_matrix")}
                ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                matrix, asked_for = np.frombuffer(row["matrix"], "<i8").reshape(-1, width), np.frombuffer(row["q_matrix"], "<i8").reshape(-1, width)
                postings, ends = np.frombuffer(row["postings"], "<i4"), np.frombuffer(row["ends"], "<i8")
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for a in range(0, len(q_ids), QUERY_STEP):
                    part = asked_for[a : a + QUERY_STEP]
                    # The query's own rows stand among the best; their number is what k must grow by.
                    own = int(np.unique(ids, return_counts=True)[1].max(initial=1))
                    for j, rows in enumerate(possible_members(matrix, postings, ends, part, k + own)):
                        rows = rows[ids[rows] != q_ids[a + j]]
                        score = matrix[rows] @ part[j]
                        best = np.lexsort((ids[rows], -score))[:k]
                        out.append((np.full(len(best), q_ids[a + j]), ids[rows][best], score[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    # Query blocks, much the smaller, go to the index blocks; an index block is copied only where there are fewer of them than tasks.
    copies = max(1, min(n_asked, -(-vectors.sparkSession.sparkContext.defaultParallelism // n_index)))
    numbers = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    parts = min(n_index * copies, 2000)
    sent = blocks.withColumn("block", numbers(n_index)).withColumn("copy", F.col("qblock") % copies).repartition(parts, "block", "copy")
    spread = sent.join(index.withColumn("copy", numbers(copies)).repartition(parts, "block", "copy").hint("merge"), ["block", "copy"])
    found = spread.select("ids", "matrix", "postings", "ends", "q_ids", "q_matrix").mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
