"""Best-fit packing of token sequences, as hierarchical residual packing.

Every input partition tokenizes its documents, cuts the longer ones into pieces and packs its pieces
best-fit, longest first. Bins that are nearly full are final. The others, a small share, go up a
tree as items of their own: groups of a bounded number of underfull bins are packed best-fit again,
round after round, until a single group is left or a round closes no more gaps.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.flat import flat, frugal, steps
from stratum.llm.shared import bounded_batches, cut
from stratum.llm.tokens import WORD_TOKENIZER, word_encoder

#: Bins with no more free tokens than this are emitted at once.
NEARLY_FULL = 8
#: Underfull bins that one task of a later round packs at most (about 100 bytes each).
GROUP_BINS = 50_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long"


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack items longest first, each into the fullest bin that still has room.

    Returns each item's bin (from 0) and place in it, and each bin's fill.
    """
    bins, places, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    free_sizes: list[int] = []  # distinct free sizes, ascending
    by_free: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        k = bisect_left(free_sizes, n)
        if k < len(free_sizes):
            free = free_sizes[k]
            b = by_free[free].pop()
            if not by_free[free]:
                del by_free[free], free_sizes[k]
        else:
            b, free = len(fills), room
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += n
        if left := free - n:
            if left not in by_free:
                by_free[left] = []
                insort(free_sizes, left)
            by_free[left].append(b)
    return bins, places, np.array(fills, np.int64)


def token_pieces(docs: DataFrame, text: str = "text", max_tokens: int = 2048, tokenizer: str = WORD_TOKENIZER, end_id: int = 0) -> DataFrame:
    """Tokenize, end each document with ``end_id``, cut it at ``max_tokens`` and best-fit within the partition.

    Columns: doc_id, piece, start, length, ids_crc32 and the partition's own bin and place there.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        doc_ids, pieces, begins, lengths, sums = [], [], [], [], []
        for part in steps(batches, text):
            ids, at = encoder.encode_flat(*flat(part.column(text)))
            for doc, a, b in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                whole = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(whole), max_tokens)):
                    cut_ids = whole[start : start + max_tokens]
                    doc_ids.append(doc)
                    pieces.append(piece)
                    begins.append(start)
                    lengths.append(len(cut_ids))
                    sums.append(zlib.crc32(cut_ids))
        if lengths:
            bins, places, _ = best_fit(np.array(lengths, np.int64), max_tokens)
            bins += TaskContext.get().partitionId() << 40
            columns = [pa.array(doc_ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(begins, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()), pa.array(bins), pa.array(places)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, _PIECES)


def _merge_round(bins: DataFrame, groups: int, room: int) -> DataFrame:
    """Pack bins as items within each of ``groups`` groups: (bin, fill) to (bin, into, shift)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", ignore_index=True)
        own, shift, fills = best_fit(pdf["fill"].to_numpy(), room)
        ids = pdf["bin"].to_numpy()
        name = np.zeros(len(fills), np.int64)
        head = shift == 0  # each bin is named after the first that it takes
        name[own[head]] = ids[head]
        return pd.DataFrame({"bin": ids, "into": name[own], "shift": shift, "total": fills[own]})

    return (
        bins.withColumn("g", F.pmod(F.shiftrightunsigned("bin", 40) + F.pmod(F.col("bin"), F.lit(1 << 40)), F.lit(groups)))
        .groupBy("g")
        .applyInPandas(run, "bin long, into long, shift long, total long")
    )


def pack(docs: DataFrame, text: str = "text", max_tokens: int = 2048, tokenizer: str = WORD_TOKENIZER, end_id: int = 0, nearly_full: int = NEARLY_FULL, group_bins: int = GROUP_BINS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``docs`` needs doc_id and the text column; others are ignored. A null or empty text is the single
    ``end_id``. Rows with equal doc_ids are packed as documents of their own; an empty table gives no
    rows. No sequence holds more than ``max_tokens``, and a sequence's pieces follow without gaps.
    """
    bounded_batches(docs.sparkSession)
    pieces = cut(token_pieces(docs, text, max_tokens, tokenizer, end_id))
    moved = None  # bin -> (sequence, shift), for bins that a later round has moved
    open_bins = pieces.groupBy("bin").agg(F.sum("length").alias("fill")).filter(F.col("fill") < max_tokens - nearly_full)
    open_bins = cut(open_bins)
    count = open_bins.count()
    groups = -(-count // group_bins)
    while count > 1:
        packed = cut(_merge_round(open_bins, groups, max_tokens))
        if moved is None:
            moved = packed.select("bin", F.col("into").alias("sequence"), "shift")
        else:
            step = packed.select(F.col("bin").alias("sequence"), "into", F.col("shift").alias("more"))
            moved = moved.join(step, "sequence", "left").select("bin", F.coalesce("into", "sequence").alias("sequence"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        moved = cut(moved)
        if groups == 1:
            break
        open_bins = packed.groupBy("into").agg(F.first("total").alias("fill")).filter(F.col("fill") < max_tokens - nearly_full).select(F.col("into").alias("bin"), "fill")
        open_bins = cut(open_bins)
        left = open_bins.count()
        if left > 0.98 * count:  # what is left is too long to meet
            break
        count, groups = left, -(-left // group_bins)
    if moved is None:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    return pieces.join(moved, "bin", "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))
