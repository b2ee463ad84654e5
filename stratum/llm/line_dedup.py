"""Near-duplicate lines by an exact set-similarity join with prefix, positional and length filters.

A line's tokens are its distinct word shingles, and lines with equal sets are one class. Texts are
gathered in chunks. Every chunk tells which tokens it holds, packed and dealt out by the tokens'
leading bits; a bucket sorts them and sends back how many chunks hold each, which is the tokens'
rarity. Ordered by it, a line's prefix holds its rarest tokens, one of which any similar line must
share, and most lines end here: their prefixes hold nothing that occurs again. The classes that are
left meet in the tokens of their prefixes. Length and positional filters drop pairs that can't reach
the threshold, and the others are verified on their full sets. Where many classes meet, each first
meets the earliest; those that this does not remove then meet the others in blocks of bounded size,
which tell at most one similar line of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.cells import HASH_BITS, dealt, heads, pack, unpack
from stratum.llm.flat import flat, frugal, mix, steps, word_hashes, words
from stratum.llm.shared import bounded_batches, cut, written
from stratum.llm.tables import grouped, only

#: Bits of a line's number within its chunk where it is sorted together with a token's hash.
LINE_BITS = 64 - HASH_BITS
#: Bytes of text of a chunk, and tokens of which a bucket holds about as many.
CHUNK_BYTES, BUCKET_TOKENS = 2_000_000, 1 << 20
#: Chunks that one task compares with the rarities of their tokens (each some 0.5 MB as it travels).
TASK_CHUNKS = 4
#: Classes that meet in a token all at once; tokens and lines of one side of a block where more do.
SMALL_GROUP, BLOCK_TOKENS, BLOCK_LINES = 8, 1 << 16, 1 << 10
#: Line numbers that are broadcast at most (4 bytes each).
WANTED = 4_000_000
#: Lines of a block that must share a token for it to be counted by a matrix product.
COMMON = 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each line starts (n + 1 offsets) and each text's first line (texts + 1 numbers); lines end at a line feed."""
    feeds = np.flatnonzero(data == 10)
    rows = np.searchsorted(offsets, feeds, side="right") - 1
    starts = np.concatenate([offsets[:-1], feeds + 1])
    owner = np.concatenate([np.arange(len(offsets) - 1), rows])
    order = np.lexsort((starts, owner))
    first = np.searchsorted(owner[order], np.arange(len(offsets)))
    return np.append(starts[order], len(data)), first


def _tokens(data: np.ndarray, starts: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, line) of all lines, each once, sorted by token; lines without words have none."""
    begin, end, line = words(data, starts)
    hashes = word_hashes(data, begin, end)
    token = hashes.copy()
    for j in range(1, shingle):
        rest = max(len(hashes) - j, 0)
        same = line[j:] == line[:rest]
        token[:rest] = np.where(same, token[:rest] * _STEP + hashes[j:], token[:rest])
    # A line of fewer words is one token, that of its first word; of more, those that have all their words.
    n = np.bincount(line, minlength=len(starts) - 1)
    place = np.arange(len(line)) - (np.cumsum(n) - n)[line]
    keep = place <= np.maximum(n[line] - shingle, 0)
    line, token = line[keep], mix(token[keep]) >> np.uint64(64 - HASH_BITS)
    if len(starts) <= 1 << LINE_BITS:
        both = token << np.uint64(LINE_BITS) | line.astype(np.uint64)
        both.sort()
        both = both[heads(both)]
        return both >> np.uint64(LINE_BITS), (both & np.uint64((1 << LINE_BITS) - 1)).astype(np.int64)
    order = np.lexsort((line, token))
    token, line = token[order], line[order]
    once = heads(token) | heads(line)
    return token[once], line[once]


def _numbered(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_base``, the number of a row's first line among the lines of its doc_id: 0, but where a doc_id
    has several texts, these follow each other in the order of their hashes. Rows of equal doc_id and text share it."""
    doc, key = F.col("doc_id").cast("long"), F.xxhash64(text)
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select(doc.alias("_id"), key.alias("_key"), text)
    several = cut(rows.groupBy("_id").agg(F.min("_key").alias("a"), F.max("_key").alias("b")).filter("a <> b").select("_id"))
    if not several.take(1):
        return docs.withColumn("_base", F.lit(0))
    own = only(rows, several, "_id").groupBy("_id", "_key").agg(F.max(_n_lines(text)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("_id").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1))
    bases = own.select("_id", "_key", F.coalesce(before, F.lit(0)).cast("int").alias("_base"))
    out = docs.withColumn("_key", key).join(bases.withColumnRenamed("_key", "_key2"), (doc == F.col("_id")) & (F.col("_key") == F.col("_key2")), "left")
    return out.select(*docs.columns, F.coalesce("_base", F.lit(0)).alias("_base"))


def _n_lines(text: str) -> Column:
    return F.coalesce(F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")


class _Chunk:
    """The lines of a chunk of texts that are the first of their class, and their tokens, computed alike in every round.

    token and line (numbers among the lines with words) are sorted by token. distinct holds the tokens
    once, count the lines that hold each, and at the place of each pair's token in it.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, shingle: int, leads: np.ndarray | None = None):
        starts, self.first = _lines(data, offsets)
        self.token, self.line = _tokens(data, starts, shingle)
        n = np.bincount(self.line, minlength=len(starts) - 1)
        self.full = np.flatnonzero(n)
        self.n = n[self.full]
        place = np.zeros(len(n), np.int64)
        place[self.full] = np.arange(len(self.full))
        self.line = place[self.line]
        if leads is not None:
            keep = leads[self.line]
            self.token, self.line = self.token[keep], self.line[keep]
            head = heads(self.token)
            self.at = np.cumsum(head) - 1
            self.distinct, self.count = self.token[head], np.bincount(self.at, minlength=int(head.sum()))

    def lines(self, doc: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """cls, doc and number of every line with words, and whether it is the first of its class in this chunk."""
        mixed = mix(self.token + np.uint64(1))
        low, high = (np.bincount(self.line, x.astype(np.float64), len(self.n)).astype(np.uint64) for x in (mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32)))
        cls = mix(low * _STEP + mix(high)) + self.n.astype(np.uint64)
        doc, number = self.places(doc, base)
        order = np.lexsort((number, doc, cls))
        leads = np.zeros(len(cls), bool)
        leads[order[heads(cls[order])]] = True
        return cls, doc, number, leads

    def places(self, doc: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc and number of every line with words."""
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[self.full]
        return doc[owner], (self.full - self.first[owner] + base[owner]).astype(np.int32)

    @staticmethod
    def of(row: dict, shingle: int) -> _Chunk:
        leads = np.unpackbits(np.frombuffer(row["leads"], np.uint8), count=row["n_lines"]).astype(bool)
        leads[np.array(row["later"] or (), np.int64)] = False
        return _Chunk(np.frombuffer(zstandard.decompress(row["data"]), np.uint8), np.frombuffer(row["offsets"], "<i8"), shingle, leads)


def _chunks(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """One row per chunk: its texts (compressed), where each starts, their doc_ids and bases, which lines are the first of
    their class in it, and every line's class, doc and number."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for part in steps(batches, text, CHUNK_BYTES):
            data, offsets = flat(part.column(text))
            doc, base = part.column("doc_id").to_numpy(), part.column("_base").to_numpy().astype(np.int64)
            chunk = _Chunk(data, offsets, shingle)
            if not len(chunk.n):
                continue
            cls, line_doc, line, leads = chunk.lines(doc, base)
            packed = [zstandard.compress(data.tobytes(), 3), offsets.astype("<i8").tobytes(), doc.astype("<i8").tobytes(), base.astype("<i8").tobytes(), np.packbits(leads).tobytes(), cls.astype("<u8").tobytes(), line_doc.astype("<i8").tobytes(), line.astype("<i4").tobytes()]
            names = ["data", "offsets", "docs", "bases", "leads", "cls", "doc", "line"]
            counts = [len(cls), len(chunk.token)]
            yield pa.RecordBatch.from_arrays([pa.array([task << 24 | number], pa.int64()), *(pa.array([x], pa.binary()) for x in packed), *(pa.array([x], pa.int64()) for x in counts)], ["chunk", *names, "n_lines", "n_tokens"])
            number += 1

    return docs.select(F.col("doc_id").cast("long"), text, "_base").mapInArrow(run, "chunk long, data binary, offsets binary, docs binary, bases binary, leads binary, cls binary, doc binary, line binary, n_lines long, n_tokens long")


def _all_lines(chunks: DataFrame) -> DataFrame:
    """cls, doc, line of every line with words, and its chunk and number there."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_lines"]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.frombuffer(row[c], t)) for c, t in (("cls", "<i8"), ("doc", "<i8"), ("line", "<i4"))), pa.array(np.full(n, row["chunk"])), pa.array(np.arange(n, dtype=np.int32))], ["cls", "doc", "line", "chunk", "k"])

    return chunks.select("chunk", "n_lines", "cls", "doc", "line").mapInArrow(run, "cls long, doc long, line int, chunk long, k int")


def _rarity(holders: np.ndarray) -> np.ndarray:
    """Chunks that hold a token as a byte that grows with their number; 0 is one chunk alone."""
    return np.where(holders <= 64, holders - 1, np.minimum(255, 64 + 8 * np.log2(np.maximum(holders, 64) / 64))).astype(np.uint8)


def _rarities(chunks: DataFrame, shingle: int, buckets: int, parts: int) -> DataFrame:
    """chunk, marks: for every bucket the rarity of each of the chunk's tokens there, in order; dealt by chunk to ``parts`` partitions."""

    @frugal
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                bucket, rest = dealt(_Chunk.of(row, shingle).distinct, buckets)
                cuts = np.append(np.flatnonzero(heads(bucket)), len(bucket))
                cells = [pack(rest[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(np.full(len(cells), row["chunk"])), pa.array(np.diff(cuts)), pa.array(cells, pa.binary())], ["bucket", "chunk", "n", "tokens"])

    @frugal
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "bucket"):
            cells = [unpack(raw, n) for raw, n in zip(group.column("tokens").to_pylist(), group.column("n").to_pylist(), strict=True)]
            every = np.concatenate(cells)
            every.sort()
            first = np.flatnonzero(heads(every))
            known, mark = every[first], _rarity(np.diff(np.append(first, len(every))))
            marks = [zstandard.compress(mark[np.searchsorted(known, x)].tobytes(), 1) for x in cells]
            yield pa.RecordBatch.from_arrays([group.column("chunk"), group.column("bucket"), pa.array(marks, pa.binary())], ["chunk", "bucket", "marks"])

    sent = chunks.mapInArrow(send, "bucket long, chunk long, n long, tokens binary")
    back = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(sort, "chunk long, bucket long, marks binary")
    return back.repartition(parts, "chunk").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "marks"))).alias("marks"))


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of which a line with n must share one with any line that reaches the threshold."""
    return n - -(-n * percent // 100) + 1


def _likely(chunks: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc, line, n, alone, members of the classes whose prefixes hold tokens that occur again.

    members are all n tokens, the rarest first; the first ``alone`` of them occur nowhere else.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                x = _Chunk.of(row, shingle)
                mark = np.frombuffer(b"".join([zstandard.decompress(m["marks"]) for m in row["marks"]]), np.uint8)
                mark = np.where((mark == 0) & (x.count > 1), 1, mark)[x.at]
                alone = np.bincount(x.line[mark == 0], minlength=len(x.n))
                leads = np.zeros(len(x.n), bool)
                leads[x.line] = True
                chosen = leads & (alone < _prefix(x.n, percent)) & (alone < x.n)
                doc, number = x.places(*(np.frombuffer(row[c], "<i8") for c in ("docs", "bases")))
                keep = chosen[x.line]
                token, line, mark = x.token[keep], x.line[keep], mark[keep]
                order = np.lexsort((token, mark, line))
                raw, which = token[order].astype("<u8").tobytes(), np.flatnonzero(chosen)
                ends = np.concatenate([[0], np.cumsum(x.n[which])]) * 8
                members = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(doc[which]), pa.array(number[which]), pa.array(x.n[which].astype(np.int32)), pa.array(alone[which].astype(np.int32)), members], ["doc", "line", "n", "alone", "members"])

    return chunks.mapInArrow(run, "doc long, line int, n int, alone int, members binary")


def _prefix_tokens(own: DataFrame, percent: int) -> DataFrame:
    """token, doc, line, n, at: the prefix tokens that occur again, and how many such tokens stand before each."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw, offsets = flat(batch.column("members"))
                n, alone = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "alone"))
                size = _prefix(n, percent) - alone
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                token = np.frombuffer(raw.tobytes(), np.int64)[at + np.repeat(offsets[:-1] // 8 + alone, size)]
                columns = [pa.array(token), *(pa.array(np.repeat(batch.column(c).to_numpy(), size)) for c in ("doc", "line")), pa.array(np.repeat(n - alone, size).astype(np.int32)), pa.array(np.repeat(n, size).astype(np.int32)), pa.array(at.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["token", "doc", "line", "again", "n", "at"])

    return own.select("doc", "line", "n", "alone", "members").mapInArrow(run, "token long, doc long, line int, again int, n int, at int")


def _able(percent: int, again1, again2, n1, n2, a1, a2, least, greatest, ceil):
    """Length and positional filters: the tokens from a shared one on, and those before it that occur again, must be able to make up the overlap."""
    need = ceil((n1 + n2) * percent / (100 + percent))
    return (least(n1, n2) * 100 >= greatest(n1, n2) * percent) & (1 + least(a1, a2) + least(again1 - a1 - 1, again2 - a2 - 1) >= need)


def _small_groups(index: DataFrame, percent: int) -> DataFrame:
    """doc, line, other_doc, other_line: able pairs of tokens that few lines hold, the later line first."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "doc", "line", "again", "n", "at")
        held = {c: np.zeros(0, np.int64) for c in names}
        for batch in [*batches, None]:
            if batch is not None:
                held = {c: np.concatenate([held[c], batch.column(c).to_numpy().astype(np.int64)]) for c in names}
            end = len(held["token"]) if batch is None else int(np.searchsorted(held["token"], held["token"][-1])) if len(held["token"]) else 0
            x, held = {c: v[:end] for c, v in held.items()}, {c: v[end:] for c, v in held.items()}
            for lag in range(1, SMALL_GROUP):
                i = np.flatnonzero(x["token"][lag:] == x["token"][:-lag]) + lag
                j = i - lag
                good = _able(percent, *(x[c][k] for c in ("again", "n", "at") for k in (i, j)), np.minimum, np.maximum, np.ceil)
                i, j = i[good], j[good]
                yield pa.RecordBatch.from_arrays([pa.array(x["doc"][i]), pa.array(x["line"][i].astype(np.int32)), pa.array(x["doc"][j]), pa.array(x["line"][j].astype(np.int32))], ["doc", "line", "other_doc", "other_line"])

    return index.repartition("token").sortWithinPartitions("token", "doc", "line").mapInArrow(run, "doc long, line int, other_doc long, other_line int")


def _verified(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """doc, line of the pairs' first ends whose Jaccard similarity with the other end reaches the threshold."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                both = np.concatenate([np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("mx", "my")])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    keep.append(i)
            yield batch.select(["doc", "line"]).take(pa.array(keep, pa.int64()))

    left = own.select("doc", "line", F.col("members").alias("mx"))
    right = own.select(F.col("doc").alias("other_doc"), F.col("line").alias("other_line"), F.col("members").alias("my"))
    return cut(pairs.join(left, ["doc", "line"]).join(right, ["other_doc", "other_line"]).select("doc", "line", "mx", "my").mapInArrow(run, "doc long, line int").distinct())


class _Block:
    """Lines of one side of a block, ready to count what others share with them."""

    def __init__(self, doc: np.ndarray, line: np.ndarray, members: list[np.ndarray]):
        self.doc, self.line, self.n = doc, line, np.array([len(x) for x in members], np.int64)
        token, row = np.concatenate(members), np.repeat(np.arange(len(members)), self.n)
        order = np.argsort(token)
        self.rows = row[order]
        self.start = np.flatnonzero(heads(token[order]))
        self.known, self.size = token[order][self.start], np.diff(np.append(self.start, len(token)))
        common = np.flatnonzero(self.size > COMMON)
        self.column = np.full(len(self.known), -1)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(members), len(common)), np.float32)
        where = np.repeat(self.column, self.size)
        self.dense[self.rows[where >= 0], where[where >= 0]] = 1

    def shared(self, members: list[np.ndarray]) -> np.ndarray:
        """How many tokens each of ``members`` shares with each line."""
        token, row = np.concatenate(members), np.repeat(np.arange(len(members)), [len(x) for x in members])
        at = np.minimum(np.searchsorted(self.known, token), len(self.known) - 1)
        hit = self.known[at] == token
        at, row = at[hit], row[hit]
        dense = np.zeros((len(members), self.dense.shape[1]), np.float32)
        column = self.column[at]
        dense[row[column >= 0], column[column >= 0]] = 1
        at, row = at[column < 0], row[column < 0]
        size = self.size[at]
        rows = self.rows[np.arange(size.sum()) + np.repeat(self.start[at] - (np.cumsum(size) - size), size)]
        rare = np.bincount(np.repeat(row, size) * len(self.n) + rows, minlength=len(members) * len(self.n))
        return rare.reshape(len(members), -1) + np.rint(dense @ self.dense.T).astype(np.int64)


def _large_groups(index: DataFrame, large: DataFrame, gone: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """doc, line of the lines that are left in tokens that many lines hold and that are similar to an earlier one there.

    A token's lines are dealt into blocks of lines of like lengths; a line that is left goes to each block of its token
    whose lines may be as long as the threshold asks for and stands for itself there, so that a block tells as many
    lines at most as came to it.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, early, block = None, [], None
        for batch in batches:
            cells, sides = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            members = [np.frombuffer(x, np.uint64) for x in batch.column("members").to_pylist()]
            doc, line = batch.column("doc").to_numpy(), batch.column("line").to_numpy()
            cuts = np.append(np.flatnonzero(heads(cells) | heads(sides)), len(cells)).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if cells[a] != cell:
                    cell, early, block = cells[a], [], None
                if sides[a] == 0:
                    early.append((doc[a:b], line[a:b], members[a:b]))
                    continue
                if block is None and early:
                    block = _Block(np.concatenate([x[0] for x in early]), np.concatenate([x[1] for x in early]), [m for x in early for m in x[2]])
                while block is not None and a < b:
                    size = np.cumsum([len(m) for m in members[a:b]])
                    c = a + max(1, min(int(np.searchsorted(size, BLOCK_TOKENS)), BLOCK_LINES))
                    common = block.shared(members[a:c])
                    n = np.array([len(m) for m in members[a:c]])[:, None]
                    before = (block.doc[None] < doc[a:c, None]) | ((block.doc[None] == doc[a:c, None]) & (block.line[None] < line[a:c, None]))
                    found = np.flatnonzero((before & (100 * common >= percent * (n + block.n[None] - common))).any(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(doc[a:c][found]), pa.array(line[a:c][found])], ["doc", "line"])
                    a = c

    # Bands grow by the threshold's ratio: lines of bands that aren't neighbours differ too much in length.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).alias("band")
    left = cut(index.join(large.select("token"), "token", "left_semi").select("token", "doc", "line", "n").join(gone, ["doc", "line"], "left_anti"))
    # Bands of a token that no line which is left can meet need no blocks.
    wanted = left.select("token", F.explode(F.array(*(band + i for i in (-1, 0, 1)))).alias("band")).distinct()
    all_ = index.join(large.select("token"), "token", "left_semi").select("token", "doc", "line", "n", band)
    blocks = all_.groupBy("token", "band").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_TOKENS, F.count("*") / BLOCK_LINES)).alias("blocks"))
    blocks = cut(blocks.join(wanted, ["token", "band"], "left_semi"))
    cell = lambda block: F.xxhash64("token", "band", block).alias("cell")
    early = all_.join(blocks, ["token", "band"]).select(cell(F.pmod(F.xxhash64("doc", "line"), F.col("blocks"))), F.lit(0).alias("side"), "doc", "line")
    near = left.select("token", "doc", "line", F.explode(F.array(*(band + i for i in (-1, 0, 1)))).alias("band"))
    late = near.join(blocks, ["token", "band"]).select("token", "band", "doc", "line", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).select(cell(F.col("block")), F.lit(1).alias("side"), "doc", "line")
    rows = early.union(late).join(own.select("doc", "line", "members"), ["doc", "line"])
    return rows.repartition("cell").sortWithinPartitions("cell", "side").select("cell", "side", "doc", "line", "members").mapInArrow(run, "doc long, line int").distinct()


def later_lines(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id and removed (sorted line numbers, from 0) of every document that has lines to remove.

    A line goes if an earlier one, by doc_id and line number, has a Jaccard similarity of percent / 100
    or more; lines are judged on the input. Lines without words stay and match nothing. Rows with a
    null doc_id or text have no lines. Rows of equal doc_id and text are one document: a line of theirs goes from
    all of them or from none. Different texts of one doc_id count as parts of it in the order of their hashes, and
    the line numbers run on from one to the next.
    """
    return _later(_numbered(docs, text), shingle, percent, text)


def _later(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """:func:`later_lines` of documents that :func:`_numbered` has numbered."""
    bounded_batches(docs.sparkSession)
    docs = docs.filter(F.col("doc_id").isNotNull() & F.col(text).isNotNull())
    chunks = written(_chunks(docs, text, shingle))
    n_chunks, n_tokens = chunks.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, parts = max(least, -(-n_tokens // BUCKET_TOKENS)), max(least, -(-n_chunks // TASK_CHUNKS))
    # Copies: all lines of a class but its first. Only classes of several lines are joined, and a large one can be split.
    lines = _all_lines(chunks)
    firsts = lines.groupBy("cls").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("size")).filter("size > 1")
    copies = written(lines.join(firsts.select("cls", "first"), "cls").filter(F.struct("doc", "line") != F.col("first")).select("doc", "line", "chunk", "k"))
    # From here on the first line of a class stands for it.
    later = copies.groupBy("chunk").agg(F.collect_list("k").alias("later"))
    few = copies.limit(WANTED + 1).count() <= WANTED  # a checked size: broadcast, else both sides are shuffled
    texts = chunks.select("chunk", "data", "offsets", "docs", "bases", "leads", "n_lines").join(F.broadcast(later) if few else later, "chunk", "left")
    own = _likely(texts.repartition(parts, "chunk").join(_rarities(texts.drop("docs", "bases"), shingle, buckets, parts), "chunk"), shingle, percent)
    own = written(own.dropDuplicates(["doc", "line"]))  # rows may stand again
    index = written(_prefix_tokens(own, percent))
    groups = cut(index.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("doc", "line", "again", "n", "at")).alias("first")).filter("size > 1"))
    small, large = groups.filter(F.col("size") <= SMALL_GROUP), groups.filter(F.col("size") > SMALL_GROUP)
    ends = ["doc", "line", "other_doc", "other_line"]
    star = index.join(large, "token").filter(F.struct("doc", "line") != F.struct("first.doc", "first.line"))
    star = star.filter(_able(percent, F.col("again"), F.col("first.again"), F.col("n"), F.col("first.n"), F.col("at"), F.col("first.at"), F.least, F.greatest, F.ceil))
    star = star.select("doc", "line", F.col("first.doc").alias("other_doc"), F.col("first.line").alias("other_line"))
    pairs = _small_groups(index.join(small.select("token"), "token", "left_semi"), percent).union(star)
    pairs = cut(pairs.groupBy(*ends).agg(F.count("*").alias("shared")))
    # Each line with the one that it shares most prefix tokens with: one similar earlier line is enough. Then those left, with all others.
    best = cut(pairs.groupBy("doc", "line").agg(F.max(F.struct("shared", "other_doc", "other_line")).alias("best")).select("doc", "line", "best.other_doc", "best.other_line"))
    gone = _verified(best, own, percent)
    more = cut(pairs.select(*ends).join(gone, ["doc", "line"], "left_anti").join(best, ends, "left_anti"))
    if more.take(1):
        gone = cut(gone.union(_verified(more, own, percent)).distinct())
    if large.take(1):
        gone = gone.union(_large_groups(index, large, gone, own, percent))
    return copies.select("doc", "line").union(gone).groupBy(F.col("doc").alias("doc_id")).agg(F.sort_array(F.collect_set("line")).alias("removed"))


def line_report(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, removed (line numbers in the row's text). A null text has no lines."""
    docs = _numbered(docs.select("doc_id", text), text)
    removed = _later(docs, text=text, **options)
    out = docs.select(F.col("doc_id").cast("long"), _n_lines(text).alias("n_lines"), "_base").join(removed, "doc_id", "left")
    own = F.transform(F.filter("removed", lambda x: (x >= F.col("_base")) & (x < F.col("_base") + F.col("n_lines"))), lambda x: x - F.col("_base"))
    own = F.coalesce(own, F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(own).cast("long").alias("n_removed"), own.alias("removed"))


def remove_later_lines(docs: DataFrame, text: str = "text", whole: float = 0.0, **options) -> DataFrame:
    """``docs`` without the lines that :func:`later_lines` names; rows and other columns stay, whatever their names.

    A text of whose characters less than the share ``whole`` would be left stays whole: nearly all of it stands elsewhere,
    so that it is a copy, for whoever removes copies of documents to judge.
    """
    rows = _numbered(docs.select("doc_id", text, F.struct(*docs.columns).alias("_row")), text)
    removed = _later(rows.select("doc_id", text, "_base"), text=text, **options).select(F.col("doc_id").alias("_doc"), F.col("removed").alias("_removed"))
    joined = rows.join(removed, F.col("doc_id").cast("long") == F.col("_doc"), "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("_removed"), i + F.col("_base"))), "\n")
    new = F.when(F.col("_removed").isNull() | (F.length(kept) < whole * F.length(text)), F.col(text)).otherwise(kept)
    return joined.select(*(new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns))
