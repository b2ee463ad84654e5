"""Removal of long repeated byte strings by distributed prefix doubling.

A suffix array's prefix doubling names every position by the rank of the 2h bytes from it, from the
pair of ranks (h bytes from it, h bytes from h further on), and goes on with those whose rank is not
unique until a threshold. Here the first ranks are taken at sampled positions only: every string of
half the threshold's length contains a sampled position that its own bytes choose (the smallest hash
of ``ANCHOR`` bytes), so strings whose sampled rank is unique can't repeat and all their positions
drop out. The positions that are left get ranks of half and the whole of the threshold, each from a
pair of ranks; Spark deals the ranks out by their leading bits, every bucket sorts its ranks, and the
marks of those that are not unique go back. Equal strings have equal ranks wherever they stand, as a
rank is named by a hash of its pair. All ranks come from 64-bit hashes of ``ANCHOR`` bytes: strings
that differ within one such block alone are told apart by 64 bits, others by more, with the bucket's
bits 48 in the round before the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.cells import HASH_BITS, dealt, heads, pack, unpack
from stratum.llm.flat import SPACE, flat, frugal, mix, powers, prefix_hash, steps, substring_hash
from stratum.llm.shared import bounded_batches, cut
from stratum.llm.tables import free_name, grouped, only

#: Bytes of a sampled rank's string. Positions of which one bucket of ranks holds about as many.
ANCHOR, BUCKET_RANKS = 100, 1 << 20
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _sliding(values: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """best() of values[p : p + width] for every p where that fits."""
    n = len(values)
    full = np.full(-(-n // width) * width, fill, values.dtype)
    full[:n] = values
    rows = full.reshape(-1, width)
    ahead = best.accumulate(rows, axis=1).ravel()
    behind = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - width + 1], ahead[width - 1 : n])


def sampled(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions and the 64-bit names of the ``anchor`` bytes from each.

    In every string of ``length`` bytes of a text the position with the smallest hash is sampled (all, of equal ones).
    """
    width, n = length - anchor + 1, len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix_hash(data)
    at = np.arange(n - anchor + 1)
    short = ((sums[anchor:] - sums[:-anchor]) * powers(n + 1)[1][: n - anchor + 1] * _PAIR >> np.uint64(32)).astype(np.uint32)
    short |= np.uint32(1)  # 0 marks what is no string of one text
    least = _sliding(short, width, np.minimum, 0xFFFFFFFF)
    left = np.repeat(offsets[1:], np.diff(offsets))[: len(least)] - at[: len(least)]
    least[left < length] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)])
    most = _sliding(padded, width, np.maximum, 0)
    found = np.flatnonzero(most == short)
    return found, substring_hash(sums, found, found + anchor)


def _word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a word of a text begins."""
    word = ~SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    start[first] = word[first]
    return start


def _bases(docs: DataFrame, text: str, length: int) -> DataFrame:
    """doc_id, t1, t2 (the text's 128-bit key), n_bytes, n_words, sha256, and the sampled names: each once, and those that the text repeats."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            data, offsets = flat(part.column(text))
            at, names = sampled(data, offsets, length)
            n_words = np.bincount(np.searchsorted(offsets, np.flatnonzero(_word_starts(data, offsets)), side="right") - 1, minlength=part.num_rows)
            row = np.searchsorted(offsets, at, side="right") - 1
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            shas, single, twice = [], [], []
            for i in range(part.num_rows):
                shas.append(hashlib.sha256(data[offsets[i] : offsets[i + 1]]).hexdigest())
                own, count = np.unique(names[cuts[i] : cuts[i + 1]], return_counts=True)
                single.append(own.view(np.int64))
                twice.append(own[count > 1].view(np.int64))
            lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32), np.concatenate(xs)) for xs in (single, twice)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "t1", "t2")), pa.array(np.diff(offsets)), pa.array(n_words), pa.array(shas), *lists], ["doc_id", "t1", "t2", "n_bytes", "n_words", "sha256", "names", "twice"])

    return docs.mapInArrow(run, "doc_id long, t1 long, t2 long, n_bytes long, n_words long, sha256 string, names array<long>, twice array<long>")


def _chunks(docs: DataFrame, text: str, length: int) -> DataFrame:
    """One row per chunk of candidate texts: their bytes end to end (compressed), where each starts, and the positions whose strings may repeat."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for part in steps(batches, text):
            data, offsets = flat(part.column(text))
            names = part.column("names")
            sums = prefix_hash(data)
            starts, ends = [], []
            for i in range(part.num_rows):
                a, b = int(offsets[i]), int(offsets[i + 1])
                if b - a < length:
                    continue
                at = np.arange(a, b - ANCHOR + 1)
                flagged = np.isin(substring_hash(sums, at, at + ANCHOR), np.asarray(names[i].as_py(), np.int64).view(np.uint64))
                step = np.zeros(b - a + 1, np.int32)
                hits = np.flatnonzero(flagged)
                np.add.at(step, np.maximum(hits - (length - ANCHOR), 0), 1)
                np.add.at(step, hits + 1, -1)
                inside = np.concatenate([[False], np.cumsum(step[: b - a - length + 1]) > 0, [False]])
                edge = np.flatnonzero(inside[1:] != inside[:-1])
                starts.append(a + edge[::2])
                ends.append(a + edge[1::2])
            if not starts:
                continue
            spans = np.stack([np.concatenate(starts), np.concatenate(ends)], 1).astype("<i8")
            keys = np.stack([part.column("t1").to_numpy(), part.column("t2").to_numpy()], 1).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([task << 24 | number], pa.int64()), pa.array([keys.tobytes()]), pa.array([zstandard.compress(data.tobytes(), 1)]), pa.array([offsets.astype("<i8").tobytes()]), pa.array([spans.tobytes()]), pa.array([int((spans[:, 1] - spans[:, 0]).sum())], pa.int64())], ["chunk", "keys", "data", "offsets", "spans", "n"])
            number += 1

    return docs.mapInArrow(run, "chunk long, keys binary, data binary, offsets binary, spans binary, n long")


class _Chunk:
    """A chunk's candidate positions and their ranks, computed alike in every round."""

    def __init__(self, row: dict, length: int):
        self.length = length
        self.keys = np.frombuffer(row["keys"], "<i8").reshape(-1, 2)
        self.data = np.frombuffer(zstandard.decompress(row["data"]), np.uint8)
        self.offsets = np.frombuffer(row["offsets"], "<i8")
        spans = np.frombuffer(row["spans"], "<i8").reshape(-1, 2)
        sizes = spans[:, 1] - spans[:, 0]
        self.at = np.repeat(spans[:, 0] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        self.sums = prefix_hash(self.data)

    def rank(self, at: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
        """Ranks of the ``size`` bytes from each position, from pairs of ranks of half as many."""
        if size > self.length // 4:
            half = size // 2
            return mix(self.rank(at, half, salt) * _PAIR + self.rank(at + half, size - half, salt))
        return mix(substring_hash(self.sums, at, at + size) ^ np.uint64(salt))

    def _ranked(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct ranks with a second hash, each position's number among them, and which several positions have."""
        ranks, first, back, count = np.unique(self.rank(at, size), return_index=True, return_inverse=True, return_counts=True)
        return ranks, self.rank(at[first], size, 0x5DEECE66D), back, count > 1

    def half(self) -> tuple[np.ndarray, np.ndarray]:
        """Round 1: the ranks of half the threshold's length."""
        ranks, more, self.half_back, self.half_many = self._ranked(self.at, self.length // 2)
        return ranks, more

    def whole(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Round 2: the ranks of the threshold's length, of positions both of whose halves repeat."""
        self.repeated = np.zeros(len(self.data) + self.length, bool)
        self.repeated[self.at[(marks | self.half_many)[self.half_back]]] = True
        self.last = self.at[self.repeated[self.at] & self.repeated[self.at + self.length // 2]]
        ranks, more, self.last_back, self.last_many = self._ranked(self.last, self.length)
        return ranks, more

    def _covered(self, hits: np.ndarray, size: int) -> np.ndarray:
        step = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(step, hits, 1)
        np.add.at(step, hits + size, -1)
        return np.cumsum(step[:-1]) > 0

    def removed(self, marks: np.ndarray) -> np.ndarray:
        """Covered bytes: those of every string whose rank is not unique."""
        return self._covered(self.last[(marks | self.last_many)[self.last_back]], self.length)

    def halves(self) -> np.ndarray:
        """Bytes that repeated strings of half the threshold's length cover."""
        return self._covered(np.flatnonzero(self.repeated), self.length // 2)


def _marks(row: dict, name: str, n: int) -> np.ndarray:
    """The marks that came back for a chunk, bucket by bucket, in the order of its ranks."""
    parts = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in row[name] or ()]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(n, bool)


def _not_unique(chunks: DataFrame, length: int, last: bool, buckets: int, name: str) -> DataFrame:
    """One round: every chunk sends its distinct ranks by bucket; a bucket sorts them and sends back which came from several chunks."""
    second = "<u4" if last else "<u2"

    @frugal
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = _Chunk(row, length)
                ranks, more = chunk.half()
                if last:
                    ranks, more = chunk.whole(_marks(row, "round1", len(ranks)))
                if not len(ranks):
                    continue
                bucket, rest = dealt(ranks >> np.uint64(64 - HASH_BITS), buckets)
                more = more.astype(second)
                cuts = np.append(np.flatnonzero(heads(bucket)), len(bucket)).tolist()
                out = [(pack(rest[a:b]), more[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                columns = [pa.array(x, pa.binary()) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(np.full(len(out), row["chunk"])), *columns, pa.array(np.diff(cuts))], ["bucket", "chunk", "ranks", "more", "n"])

    @frugal
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "bucket"):
            cells = []
            for r, m, n in zip(*(group.column(c).to_pylist() for c in ("ranks", "more", "n")), strict=True):
                cells.append(unpack(r, n).astype(np.uint64) << np.uint64(32) | np.frombuffer(m, second).astype(np.uint64))
            every = np.concatenate(cells)
            every.sort()
            again = every[1:][every[1:] == every[:-1]]
            again = again[heads(again)]
            bits = []
            for x in cells:
                at = np.minimum(np.searchsorted(again, x), max(len(again) - 1, 0))
                bits.append(np.packbits(again[at] == x if len(again) else np.zeros(len(x), bool)).tobytes())
            yield pa.RecordBatch.from_arrays([group.column("chunk"), group.column("bucket"), group.column("n"), pa.array(bits, pa.binary())], ["chunk", "bucket", "n", "bits"])

    sent = chunks.mapInArrow(send, "bucket long, chunk long, ranks binary, more binary, n long")
    marks = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sort, "chunk long, bucket long, n long, bits binary")
    return marks.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "bits"))).alias(name))


_SPANS = "array<struct<start:long,end:long>>"


def _runs(marked: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _cleaned(chunks: DataFrame, length: int, words: int) -> DataFrame:
    """t1, t2, n_removed, n_spans, kept_sha256, spans (start and end of the bytes that go) and passages of every candidate text."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = _Chunk(row, length)
                ranks, _ = chunk.half()
                ranks, _ = chunk.whole(_marks(row, "round1", len(ranks)))
                gone, halves = chunk.removed(_marks(row, "round2", len(ranks))), chunk.halves()
                begun = np.concatenate([[0], np.cumsum(_word_starts(chunk.data, chunk.offsets))])
                out = []
                for (t1, t2), a, b in zip(chunk.keys.tolist(), chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True):
                    own = gone[a:b]
                    spans = [{"start": x, "end": y} for x, y in _runs(own)]
                    passages = [{"start": x, "end": y} for x, y in _runs(halves[a:b]) if begun[a + y] - begun[a + x] >= words]
                    out.append((t1, t2, int(own.sum()), len(spans), hashlib.sha256(chunk.data[a:b][~own]).hexdigest(), spans, passages))
                columns = list(zip(*out, strict=True))
                pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pairs, pairs]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["t1", "t2", "n_removed", "n_spans", "kept_sha256", "spans", "passages"])

    return chunks.mapInArrow(run, f"t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, spans {_SPANS}, passages {_SPANS}")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), whole).alias("t1"), F.xxhash64(F.lit(2), whole).alias("t2"), whole.alias(text))


def repeat_spans(docs: DataFrame, length: int = 400, text: str = "text", words: int = 50, repeated_rows: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, t1 and t2 (the text's key), n_bytes, n_removed, n_spans, kept_sha256, spans, passages.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in this
    text or another; overlaps count, and strings are judged on the input. A null text is empty. Texts
    shorter than ``length`` stay. Repeated rows are copies of each other, so their bytes go; without
    ``repeated_rows``, rows of equal doc_id and text are one text.
    passages are the runs in which ``words`` words or more begin and that strings of half that length
    cover that also start elsewhere; they are named only, whether or not their bytes go.
    """
    half = length // 2
    if half < 2 * ANCHOR:
        raise ValueError(f"length must be {4 * ANCHOR} at least")
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs, text)
    base = cut(_bases(keyed, text, half))
    # Which row stands for its text: any will do, and a row without an id has its key for one.
    row = F.coalesce("doc_id", "t1")
    classes = base.groupBy("t1", "t2").agg(F.min(row).alias("row"), (F.count("*") if repeated_rows else F.count_distinct(F.struct("doc_id"))).alias("copies"))
    # Exact copies need no ranks: every byte of theirs repeats. One of them stands for all in what follows.
    reps = base.withColumn("row", row).join(classes.select("t1", "t2", "row"), ["t1", "t2", "row"], "left_semi").dropDuplicates(["t1", "t2"]).select("row", "names", "twice")
    # Several texts may share a row's id: they get each other's names, which costs time only.
    names = reps.select("row", F.explode("names").alias("name"))
    shared = names.groupBy("name").agg(F.count("*").alias("texts")).filter("texts > 1").select("name")
    shared = cut(shared.union(reps.select(F.explode("twice").alias("name"))).distinct())
    candidates = cut(names.join(shared, "name", "left_semi").groupBy("row").agg(F.collect_set("name").alias("names")))
    texts = only(keyed.withColumn("row", row), candidates.select("row"), "row")
    if base.groupBy(row, "t1", "t2").count().filter("count > 1").take(1):  # rows that stand again
        texts = texts.dropDuplicates(["row", "t1", "t2"])
    chunks = cut(_chunks(texts.join(candidates, "row").select("t1", "t2", "names", text), text, half))
    ranks = chunks.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ranks // BUCKET_RANKS))
    # The marks are written, not the chunks with them: those are large.
    one = chunks.join(cut(_not_unique(chunks, length, False, buckets, "round1")), "chunk", "left")
    two = one.join(cut(_not_unique(one, length, True, buckets, "round2")), "chunk", "left")
    cleaned = cut(_cleaned(two, length, words))
    out = base.select("doc_id", "t1", "t2", "n_bytes", "n_words", "sha256").join(classes.select("t1", "t2", "copies"), ["t1", "t2"]).join(cleaned, ["t1", "t2"], "left")
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    passage = (F.col("copies") > 1) & (F.col("n_bytes") >= half) & (F.col("n_words") >= words)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select(
        "doc_id",
        "t1",
        "t2",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(copy, everything).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(passage, everything).otherwise(F.coalesce("passages", none)).alias("passages"),
    )


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text", words: int | None = None) -> DataFrame:
    """``docs`` with the bytes that :func:`repeat_spans` names cut out of ``text``; other columns stay.

    With ``words``, passages of so many words go as well, though none of their strings be of ``length`` bytes.
    Where a cut parts a character, its remaining bytes go too. Rows stay, even where nothing is left.
    Rows of equal doc_id and text are one text: it isn't lost for standing twice.
    """
    names = docs.columns
    gone = F.col("spans") if words is None else F.concat("spans", "passages")
    t1, t2, spans = (free_name(docs, x) for x in ("t1", "t2", "spans"))
    found = repeat_spans(docs, length, text, words or 50, repeated_rows=False).select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.array_sort(gone).alias(spans)).filter(F.size(spans) > 0).dropDuplicates([t1, t2])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            out = []
            for x, spans_ in zip(part.column(text).to_pylist(), part.column(spans).to_pylist(), strict=True):
                if spans_:
                    raw, at, kept = x.encode(), 0, []
                    for span in spans_:
                        kept.append(raw[at : max(at, span["start"])])
                        at = max(at, span["end"])
                    x = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
                out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else part.column(c) for c in names], names)

    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn(t1, F.xxhash64(F.lit(1), whole)).withColumn(t2, F.xxhash64(F.lit(2), whole))
    return keyed.join(found, [t1, t2], "left").drop(t1, t2).mapInArrow(run, docs.schema)
