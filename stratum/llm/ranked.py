"""Exact ranked lexical search: inner products of impact vectors, pruned by their lengths.

A document's vector has an impact for each term that any item asks for, an item's vector the weights
of its terms; the score is their inner product, in integers. Vectors are ordered by their length and
cut into buckets. For an item whose k-th best score so far is known:

* Cauchy-Schwarz prunes buckets: item length x greatest length in the bucket is below that score;
* coordinate bounds filter inside: the products of the item's heaviest terms (the first half) are
  added up, and what the other terms can add is at most the length of what is left of the item times
  the length of what is left of the document;
* the documents that may still be among the k best are rescored exactly.

The first bucket of every range of lengths is searched first, everywhere; the k-th best scores of all
of these together are the thresholds that the other buckets begin with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.flat import flat, runs, steps, word_hashes
from stratum.llm.shared import bounded_batches, written

#: Bytes that stand in terms: digits, letters, and all of characters beyond ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Documents of a bucket; characters of items of a block (their terms are held by the driver and every task).
BUCKET, BLOCK_CHARS = 2048, 16_000_000
#: What bounds in doubles are raised by.
_SLACK = 1 + 1e-9
_LAST = np.iinfo(np.int64).max


@dataclass
class Items:
    """A block of items: the sorted hashes of their terms, and each item's terms as places among these."""

    hashes: np.ndarray
    terms: list[np.ndarray]

    @staticmethod
    def of(texts: pa.ChunkedArray) -> Items:
        data, offsets = flat(texts)
        starts, ends, rows = runs(TERM[data], offsets)
        hashes = word_hashes(data, starts, ends)
        known, places = np.unique(hashes, return_inverse=True)
        cuts = np.searchsorted(rows, np.arange(len(offsets)))
        return Items(known, [np.unique(places[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _vectors(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """doc, n (terms of the whole text), terms and their occurrences, of documents that have any term."""
    sent = docs.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for part in steps(batches, "text"):
            data, offsets = flat(part.column("text"))
            starts, ends, rows = runs(TERM[data], offsets)
            n = np.bincount(rows, minlength=part.num_rows)
            found = word_hashes(data, starts, ends)
            at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
            hit = known[at] == found if len(known) else np.zeros(len(found), bool)
            keys, counts = np.unique(rows[hit] * max(1, len(known)) + at[hit], return_counts=True)
            cuts = np.searchsorted(keys, np.arange(part.num_rows + 1) * max(1, len(known))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (keys % max(1, len(known)), counts)]
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(n.astype(np.int64)), *lists], ["doc", "n", "terms", "tf"]).filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc long, n long, terms array<int>, tf array<int>")


def _impacts(vectors: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """doc, terms, impacts and the vector's length, of documents with any term that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tf, size = batch.column("tf"), np.diff(batch.column("tf").offsets.to_numpy())
            tf = tf.flatten().to_numpy().astype(np.int64)
            m = 50 + 50 * batch.column("n").to_numpy() * n_docs // n_terms
            impact = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, size))
            cuts = np.concatenate([[0], np.cumsum(size)])
            length = np.sqrt(np.add.reduceat(impact.astype(np.float64) ** 2, cuts[:-1])) * _SLACK if len(impact) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("terms"), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(impact.astype(np.int32))), pa.array(length)], ["doc", "terms", "impacts", "length"])

    return vectors.filter(F.size("terms") > 0).mapInArrow(run, "doc long, terms array<int>, impacts array<int>, length double")


_BUCKETS = "number int, top double, docs array<long>, lengths array<double>, sizes array<int>, terms array<int>, impacts array<int>"


def _buckets(impacts: DataFrame, parts: int, bucket: int) -> DataFrame:
    """One row for a bucket of consecutive documents by descending length, numbered in each of ``parts`` ranges of lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, number = [], 0, 0

        def full(number: int, rows: pa.RecordBatch) -> pa.RecordBatch:
            sizes = np.diff(rows.column("terms").offsets.to_numpy()).astype(np.int32)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            lengths = rows.column("length")
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([lengths[0].as_py()]), one(rows.column("doc")), one(lengths), one(pa.array(sizes)), one(rows.column("terms").flatten()), one(rows.column("impacts").flatten())], ["number", "top", "docs", "lengths", "sizes", "terms", "impacts"])

        for batch in batches:
            waiting.append(batch.select(["doc", "terms", "impacts", "length"]))
            n += batch.num_rows
            if n >= bucket:
                rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                while rows.num_rows >= bucket:
                    yield full(number, rows.slice(0, bucket))
                    rows, number = rows.slice(bucket), number + 1
                waiting, n = [rows], rows.num_rows
        if n:
            yield full(number, pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])

    # Equal lengths (of copies) are dealt out too.
    salted = impacts.withColumn("salt", F.monotonically_increasing_id())
    order = [F.col("length").desc(), "salt"]
    return salted.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, _BUCKETS)


class _Best:
    """The k best of each item that a task has met: scores, documents (nulls last), and the scores that others have reached."""

    def __init__(self, k: int, floors: np.ndarray):
        self.k, self.floors = k, floors.copy()
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(floors)

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray, known: np.ndarray) -> None:
        fit = scores >= self.floors[item]
        scores, docs, known = (np.concatenate([a, b[fit]]) for a, b in zip(self.found[item], (scores, docs, known), strict=True))
        order = np.lexsort((docs, ~known, -scores))[: self.k]
        self.found[item] = scores[order], docs[order], known[order]
        if len(order) == self.k:
            self.floors[item] = max(self.floors[item], scores[order[-1]])


def _search(buckets: DataFrame, items: Items, weights: np.ndarray, floors: np.ndarray, k: int) -> DataFrame:
    """item (its place), doc, score: each task's k best of what it reads, all at or above the item's floor."""
    sent = buckets.sparkSession.sparkContext.broadcast((items.terms, weights, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, floors = sent.value
        best, task = _Best(k, floors), TaskContext.get().partitionId()
        heavy = [t[np.argsort(-weights[t], kind="stable")] for t in asked]
        lengths = np.array([np.sqrt((weights[t].astype(np.float64) ** 2).sum()) for t in asked])
        weight = np.zeros(len(weights), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                _in_bucket({name: batch.column(name)[i].values for name in ("docs", "lengths", "sizes", "terms", "impacts")}, batch.column("top")[i].as_py(), heavy, lengths, weights, weight, best)
        out = [(np.full(len(s), j, np.int32), d, v, s) for j, (s, d, v) in enumerate(best.found) if len(s)]
        if out:
            item, docs, known, scores = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), task, np.int32)), pa.array(item), pa.array(docs, mask=~known), pa.array(scores)], ["task", "item", "doc_id", "score"])

    return buckets.select("top", "docs", "lengths", "sizes", "terms", "impacts").mapInArrow(run, "task int, item int, doc_id long, score long")


def _in_bucket(row: dict[str, pa.Array], top: float, heavy: list[np.ndarray], lengths: np.ndarray, weights: np.ndarray, weight: np.ndarray, best: _Best) -> None:
    able = np.flatnonzero(lengths * top * _SLACK >= best.floors)
    if not len(able):
        return
    known = row["docs"].is_valid().to_numpy(zero_copy_only=False)
    docs = row["docs"].fill_null(_LAST).to_numpy(zero_copy_only=False)
    norms, sizes, terms, impacts = (row[x].to_numpy(zero_copy_only=False) for x in ("lengths", "sizes", "terms", "impacts"))
    sizes, impacts = sizes.astype(np.int64), impacts.astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(terms, kind="stable")
    posting_rows, posting_impacts = np.repeat(np.arange(len(docs)), sizes)[order], impacts[order].astype(np.float64)
    have, first = np.unique(terms[order], return_index=True)
    last = np.append(first[1:], len(order))
    for q in able.tolist():
        focus, rest = np.split(heavy[q], [(len(heavy[q]) + 1) // 2])
        at = np.searchsorted(have, focus)
        hit = at < len(have)
        hit[hit] = have[at[hit]] == focus[hit]
        a, n = first[at[hit]], last[at[hit]] - first[at[hit]]
        picked = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
        rows, impact = posting_rows[picked], posting_impacts[picked]
        partial = np.bincount(rows, impact * np.repeat(weights[focus[hit]].astype(np.float64), n), len(docs))
        seen = np.bincount(rows, impact * impact, len(docs))
        left = np.sqrt((weights[rest].astype(np.float64) ** 2).sum())
        bound = partial + left * np.sqrt(np.maximum(norms * norms - seen, 0))
        member = np.flatnonzero(bound * _SLACK + 1 >= best.floors[q])
        if len(member):
            n = sizes[member]
            picked = np.arange(n.sum()) + np.repeat(begin[member] - (np.cumsum(n) - n), n)
            weight[heavy[q]] = weights[heavy[q]]
            scores = np.add.reduceat(weight[terms[picked]] * impacts[picked], np.cumsum(n) - n)
            weight[heavy[q]] = 0
            best.add(q, scores, docs[member], known[member])


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item with their ranks; of what is found each task's share is already its best."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "task")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(docs: DataFrame, block: pa.Table, kind: str, k: int, parts: int, bucket: int) -> DataFrame:
    spark = docs.sparkSession
    items = Items.of(block.column("text"))
    vectors = written(_vectors(docs, items.hashes))
    n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(items.hashes), np.int64)
    for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():  # as many as the block has terms
        df[row["t"]] = row["df"]
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    buckets = written(_buckets(_impacts(vectors, n_docs, max(1, n_terms or 0)), parts, bucket))
    lowest = np.ones(len(items.terms), np.int64)
    first = written(_top(_search(buckets.filter("number = 0"), items, weights, lowest, k), k))
    for row in first.filter(F.col("rank") == k).select("item", "score").toLocalIterator():  # one an item
        lowest[row["item"]] = row["score"]
    found = _top(first.drop("rank").unionByName(_search(buckets.filter("number > 0"), items, weights, lowest, k)), k)
    names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(block.num_rows), pa.int32()), "item_id": block.column("item")})).select("item", F.col("item_id").cast(kind).alias("item_id"))
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS, parts: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest-scoring documents with a score above 0.

    Equal scores go by ascending doc_id, a null doc_id last. Every row of ``docs`` is a document of its
    own and every row of ``items`` an item of its own; null texts have no terms, so that items without
    terms, empty tables and items that no document shares a term with give no rows. Terms are told by
    64-bit hashes. Items are taken in blocks of about ``block_chars`` characters, each against all documents.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    kind = asked.schema["item"].dataType.simpleString()
    n_blocks = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    deal = F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))
    blocks = (asked.filter(deal == i).toArrow() for i in range(n_blocks))  # one at a time
    none = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, (_block(base, b, kind, k, parts, bucket) for b in blocks if b.num_rows), none)
