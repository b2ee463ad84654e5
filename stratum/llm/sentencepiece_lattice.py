"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into words: a run of spaces (the model's word-start marks) and what follows; no piece
goes on beyond one. A chunk of texts keeps its words as numbers among its distinct ones and deals these
out to buckets by a hash; a bucket numbers the words of all chunks, so that every distinct word is
encoded once: its substrings of bounded length are exploded and equi-joined to the piece table, which
gives the lattice's edges, and the edges are grouped by word and folded with Spark's higher-order
aggregate. The ids go back to the buckets, and from there, packed, to the chunks.

The fold is Viterbi's: of all paths through the lattice the one with the greatest sum of scores, the
longer last piece among equals, at every place. For a model of merge type that path need not be what
the model's library gives; with ``fold="merge"`` the fold applies that rule to the lattice instead: of
all neighbours whose union is an edge, join the best-scored (the leftmost of equals), until none is
left. Characters without a piece become byte pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.cells import HASH_BITS, dealt, heads
from stratum.llm.flat import flat, steps, texts_as_bytes, word_hashes
from stratum.llm.shared import bounded_batches, written
from stratum.llm.tables import free_name, grouped

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text of a chunk, and for which there is one bucket of words.
CHUNK_BYTES, BUCKET_BYTES = 4_000_000, 4_000_000
#: Places of a word that are looked at together.
PLACES = 1024
#: Words whose lattices one task makes and folds.
TASK_WORDS = 20_000
#: Bytes from which on a word is cut where no piece can go across.
LONG_WORD = 64
#: What the score of a character without a piece is below the lowest score of a piece.
UNKNOWN = 10.0


def _processor(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))


def vocabulary(model: str = MODEL) -> list[tuple[str, int, float]]:
    """piece (with spaces for marks), id and score of the ordinary pieces."""
    p = _processor(model)
    return [(p.id_to_piece(i).replace(MARK, " "), i, float(p.get_score(i))) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


def pieces(spark: SparkSession, model: str = MODEL) -> DataFrame:
    """piece, id, score: a table of the model's own, fixed size."""
    return spark.createDataFrame(vocabulary(model), "piece string, id int, score double")


def _cut_places(word: str, joined: set[str]) -> list[int]:
    """Bytes of the word before each place where it can be cut: no piece holds the characters on both sides of it."""
    out, at = [], 0
    for a, b in zip(word[:-1], word[1:], strict=True):
        at += len(a.encode())
        if a + b not in joined:
            out.append(at)
    return out


def _chunks(docs: DataFrame, text: str, model: str, buckets: int) -> DataFrame:
    """Of every chunk one row (bucket -1) with its documents and their words' numbers, and one per bucket with its distinct words there."""
    names = ["chunk", "bucket", "n", "a", "b", "c", "d"]

    def rows(chunk: int, bucket, n, *columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk)), pa.array(bucket, pa.int64()), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in columns)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        joined = {x[i : i + 2] for x, _, _ in vocabulary(model) for i in range(len(x) - 1)}
        for part in steps(batches, text, CHUNK_BYTES):
            raw = [b" " + x if x else b"" for x in texts_as_bytes(pc.replace_substring(part.column(text), MARK, " "))]
            data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
            del raw
            space = data == 32
            begin = space.copy()
            begin[1:] &= ~space[:-1]
            begin[offsets[:-1][np.diff(offsets) > 0]] = True
            starts = np.flatnonzero(begin)
            ends = np.append(starts[1:], len(data))[: len(starts)]
            long = np.flatnonzero(ends - starts > LONG_WORD).tolist()
            if long:
                more = [starts[i] + np.array(_cut_places(bytes(data[starts[i] : ends[i]]).decode(), joined), np.int64) for i in long]
                starts = np.sort(np.concatenate([starts, *more]))
                ends = np.append(starts[1:], len(data))
            counts = np.diff(np.searchsorted(starts, offsets))
            keys, first, codes = np.unique(word_hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
            chunk, number = task << 24 | number, number + 1
            known = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            ids = part.column("doc_id").fill_null(0).to_numpy()
            yield rows(chunk, [-1], [part.num_rows], [ids.astype("<i8").tobytes()], [known.tobytes()], [counts.astype("<i4").tobytes()], [zstandard.compress(codes.astype("<u4").tobytes(), 1)])
            if not len(keys):
                continue
            bucket, _ = dealt(keys >> np.uint64(64 - HASH_BITS), buckets)
            at, size = starts[first], (ends - starts)[first]
            upto = np.cumsum(size)
            flat_words = data[np.arange(upto[-1]) + np.repeat(at - (upto - size), size)]
            upto = np.append(0, upto)
            cuts = np.append(np.flatnonzero(heads(bucket)), len(bucket)).tolist()
            cells = [(zstandard.compress(flat_words[upto[a] : upto[b]].tobytes(), 1), zstandard.compress(size[a:b].astype("<u4").tobytes(), 1), None, None) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield rows(chunk, bucket[cuts[:-1]], np.diff(cuts), *zip(*cells, strict=True))

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "chunk long, bucket long, n long, a binary, b binary, c binary, d binary")


def _dictionary(cells: DataFrame) -> DataFrame:
    """bucket, idx, word of every distinct word, and for every cell bucket, chunk and its words' numbers, in the cell's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "bucket"):
            raw, lengths = ([zstandard.decompress(x) for x in group.column(c).to_pylist()] for c in ("a", "b"))
            data, size = np.frombuffer(b"".join(raw), np.uint8), np.frombuffer(b"".join(lengths), "<u4").astype(np.int64)
            ends = np.cumsum(size)
            starts = ends - size
            _, first, places = np.unique(word_hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
            upto = np.append(0, np.cumsum(size[first]))
            words = data[np.arange(upto[-1]) + np.repeat(starts[first] - upto[:-1], size[first])]
            strings = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(words.tobytes())])
            bucket, n = group.column("bucket")[0].as_py(), len(first)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket)), pa.array(np.arange(n, dtype=np.int32)), strings, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], ["bucket", "idx", "word", "chunk", "places"])
            cuts = np.append(0, np.cumsum(group.column("n").to_numpy())).tolist()
            own = [zstandard.compress(places[a:b].astype("<u4").tobytes(), 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            n = len(own)
            yield pa.RecordBatch.from_arrays([group.column("bucket"), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), group.column("chunk"), pa.array(own, pa.binary())], ["bucket", "idx", "word", "chunk", "places"])

    sent = cells.select("bucket", "chunk", "n", "a", "b")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket long, idx int, word string, chunk long, places binary")


def _edges(words: DataFrame, table: DataFrame) -> DataFrame:
    """wid, edges: the lattice of every word, as edges (end, score, size, id) in the order of their ends.

    A character without a piece is an edge as well, whose id is its code point below 0.
    """
    longest, lowest = table.agg(F.max(F.length("piece")), F.min("score")).first()
    # By way of blocks: a place far into a long word is found by counting from its beginning.
    blocks = words.select("wid", "word", F.length("word").alias("n"), F.explode(F.sequence(F.lit(0), F.length("word") - 1, F.lit(PLACES))).alias("base"))
    blocks = blocks.select("wid", "base", F.least(F.col("n") - F.col("base"), F.lit(PLACES)).alias("n"), F.substring("word", F.col("base") + 1, F.lit(PLACES + longest)).alias("word"))
    places = blocks.select("wid", "base", "word", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("at"))
    places = places.select("wid", (F.col("base") + F.col("at")).alias("at"), F.substring("word", F.col("at"), F.lit(longest)).alias("ahead"))
    spans = places.select("wid", "at", "ahead", F.explode(F.sequence(F.lit(1), F.length("ahead"))).alias("size"))
    spans = spans.select("wid", (F.col("at") + F.col("size") - 1).alias("end"), "size", F.substring("ahead", F.lit(1), F.col("size")).alias("piece"))
    # The vocabulary is of fixed size, so it is broadcast.
    found = spans.join(F.broadcast(table), "piece", "left").filter("id is not null or size = 1")
    edge = F.struct("end", F.coalesce("score", F.lit(lowest - UNKNOWN)).alias("score"), "size", F.coalesce("id", -F.ascii("piece")).alias("id"))
    return found.groupBy("wid").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _byte(size: Column) -> Column:
    return F.unhex(F.hex(size))


#: Bytes that a fold appends one by one before it sets them aside as a whole: each append copies what is open.
_OPEN = 512


def _viterbi(edges: Column, longest: int) -> Column:
    """The ids of the best path: a fold over the edges, end by end.

    State: the end that is open, the best edge into it so far (score of the path and size), the scores of the last
    ``longest`` ends before it (no edge reaches back further), and, a byte each, the sizes of the best edges into all
    of them. Spark copies a fold's arrays at every step but not its bytes, so that the work grows with the edges.
    """
    nothing = F.lit(b"")
    best_type = "struct<score:double,size:int>"
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(best_type).alias("best"), F.array().cast("array<double>").alias("scores"), nothing.alias("open"), nothing.alias("full"))

    def step(s: Column, x: Column) -> Column:
        begin = x["end"] - x["size"]
        before = F.when(begin == 0, 0.0).when(begin == s["at"], s["best"]["score"]).otherwise(F.try_element_at(s["scores"], begin - s["at"]))
        path = F.struct((before + x["score"]).alias("score"), x["size"].alias("size"))
        new = x["end"] > s["at"]
        closed = new & (s["at"] > 0)
        last = F.slice(s["scores"], F.greatest(F.lit(1), F.size(s["scores"]) - longest + 2), F.lit(longest))
        turn = closed & (F.octet_length(s["open"]) >= _OPEN)
        own = _byte(s["best"]["size"])
        return F.struct(
            x["end"].alias("at"),
            F.when(new, path).otherwise(F.greatest(s["best"], path)).alias("best"),
            F.when(closed, F.concat(last, F.array(s["best"]["score"]))).otherwise(s["scores"]).alias("scores"),
            F.when(turn, own).when(closed, F.concat(s["open"], own)).otherwise(s["open"]).alias("open"),
            F.when(turn, F.concat(s["full"], s["open"])).otherwise(s["full"]).alias("full"),
        )

    sizes = F.aggregate(edges, start, step, lambda s: F.concat(s["full"], s["open"], _byte(s["best"]["size"])))

    # Back from the last end: an edge is on the path where no later one goes across; its end keeps its size.
    def back(s: Column, at: Column) -> Column:
        on, own = s["across"] == 0, F.substring(s["sizes"], at, F.lit(1))
        mark = F.when(on, own).otherwise(F.lit(b"\0"))
        turn = F.octet_length(s["open"]) >= _OPEN
        return F.struct(
            F.when(on, F.conv(F.hex(own), 16, 10).cast("int") - 1).otherwise(s["across"] - 1).alias("across"),
            F.when(turn, mark).otherwise(F.concat(mark, s["open"])).alias("open"),
            F.when(turn, F.concat(s["open"], s["full"])).otherwise(s["full"]).alias("full"),
            s["sizes"].alias("sizes"),
        )

    first = lambda sizes: F.struct(F.lit(0).alias("across"), nothing.alias("open"), nothing.alias("full"), sizes.alias("sizes"))
    marks = _let(sizes, lambda v: F.aggregate(F.sequence(F.octet_length(v), F.lit(1), F.lit(-1)), first(v), back, lambda s: F.concat(s["open"], s["full"])))
    chosen = lambda m: F.transform(F.filter(edges, lambda x: F.substring(m, x["end"], F.lit(1)) == _byte(x["size"])), lambda x: x["id"])
    return _let(marks, chosen)


def _merged(lattice: DataFrame) -> DataFrame:
    """wid, ids: what is left when the best-scored neighbours have been joined as long as their union is an edge."""
    key = lambda end, size: end.cast("long") * (1 << 20) + size
    none = F.lit(float("-inf"))

    def step(s: Column, _: Column) -> Column:
        """Join the best neighbours: s is an array of (end, size)."""

        def score(i: Column) -> Column:
            size = F.element_at(s, i)["size"] + F.try_element_at(s, i + 1)["size"]
            return F.coalesce(F.try_element_at("edge", key(F.try_element_at(s, i + 1)["end"], size))["score"], none)

        scores = F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), score)
        best = F.array_max(scores)
        i = F.array_position(scores, best).cast("int")
        joined = F.struct(F.try_element_at(s, i + 1)["end"].alias("end"), (F.element_at(s, i)["size"] + F.try_element_at(s, i + 1)["size"]).alias("size"))
        return F.when((F.size(s) < 2) | (best == none), s).otherwise(F.concat(F.slice(s, F.lit(1), i - 1), F.array(joined), F.slice(s, i + 2, F.size(s))))

    edge = F.map_from_entries(F.transform("edges", lambda x: F.struct(key(x["end"], x["size"]), F.struct(x["score"].alias("score"), x["id"].alias("id")))))
    chars = F.transform(F.filter("edges", lambda x: x["size"] == 1), lambda x: F.struct(x["end"].alias("end"), F.lit(1).alias("size")))
    folded = lattice.select("wid", edge.alias("edge"), chars.alias("chars")).withColumn("path", F.aggregate("chars", F.col("chars"), step))
    return folded.select("wid", F.transform("path", lambda x: F.element_at("edge", key(x["end"], x["size"]))["id"]).alias("ids"))


def encode_words(words: DataFrame, table: DataFrame, fold: str = "viterbi") -> DataFrame:
    """wid, ids of every word (wid, word): its lattice, folded. A character without a piece is its code point below 0."""
    longest = table.agg(F.max(F.length("piece"))).first()[0]
    lattice = _edges(words, table)
    return lattice.select("wid", _viterbi(F.col("edges"), longest).alias("ids")) if fold == "viterbi" else _merged(lattice)


def _returned(known: DataFrame, cells: DataFrame, model: str) -> DataFrame:
    """chunk, bucket, counts, ids: of every cell's words, in its order, how many ids each has, and all of them end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, bucket = _processor(model), None
        for batch in batches:
            buckets, sides = batch.column("bucket").to_numpy(), batch.column("side").to_numpy()
            cuts = np.append(np.flatnonzero(heads(buckets) | heads(sides)), len(buckets)).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if buckets[a] != bucket:
                    bucket, held, ready = buckets[a], [], None
                part = batch.slice(a, b - a)
                if sides[a] == 0:
                    lists = part.column("ids")
                    offsets = lists.offsets.to_numpy()
                    held.append((np.diff(offsets), lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]))
                    continue
                if ready is None:
                    counts, ids = (np.concatenate(x).astype(np.int64) for x in zip(*held, strict=True))
                    if (ids < 0).any():  # characters without a piece
                        as_bytes = [[i] if i >= 0 else [p.piece_to_id(f"<0x{x:02X}>") for x in chr(-i).encode()] for i in ids.tolist()]
                        width = np.array([len(x) for x in as_bytes])
                        ids = np.array([i for x in as_bytes for i in x], np.int64)
                        upto = np.append(0, np.cumsum(width))
                        ends = np.cumsum(counts)
                        counts = upto[ends] - upto[ends - counts]
                    ready = counts, np.cumsum(counts) - counts, ids
                counts, first, ids = ready
                out = []
                for x in part.column("places").to_pylist():
                    at = np.frombuffer(zstandard.decompress(x), "<u4")
                    n = counts[at]
                    own = ids[np.arange(n.sum()) + np.repeat(first[at] - (np.cumsum(n) - n), n)]
                    out.append((zstandard.compress(n.astype("<u4").tobytes(), 1), zstandard.compress(own.astype("<u4").tobytes(), 1)))
                yield pa.RecordBatch.from_arrays([part.column("chunk"), part.column("bucket"), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))], ["chunk", "bucket", "counts", "ids"])

    none = lambda kind: F.lit(None).cast(kind)
    left = known.select(F.shiftright("wid", 32).alias("bucket"), F.lit(0).alias("side"), (F.col("wid").bitwiseAND(F.lit((1 << 32) - 1))).alias("idx"), "ids", none("long").alias("chunk"), none("binary").alias("places"))
    right = cells.select("bucket", F.lit(1).alias("side"), F.lit(0).cast("long").alias("idx"), none("array<int>").alias("ids"), "chunk", "places")
    rows = left.union(right).repartition("bucket").sortWithinPartitions("bucket", "side", "idx")
    return rows.mapInArrow(run, "chunk long, bucket long, counts binary, ids binary")


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, fold: str = "merge") -> DataFrame:
    """doc_id, ids of every document: with fold "merge" as the model's library encodes it, with "viterbi" the best path.

    A null or empty text has no ids. Rows with equal or null doc_ids each keep their row; an empty table gives none.
    Words are told apart by 64-bit hashes. A word of over LONG_WORD bytes is cut where no piece can go across, which
    changes nothing in its encoding.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    chunks = written(_chunks(docs, text, model, buckets))
    words = written(_dictionary(chunks.filter("bucket >= 0")))
    wid = F.shiftleft("bucket", 32).bitwiseOR(F.col("idx").cast("long")).alias("wid")
    distinct = words.filter("word is not null").select(wid, "word")
    # Dealt out by word, so that its edges are grouped where they are made, a few words to a task, so that they are sorted in memory.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // TASK_WORDS))
    distinct = distinct.repartition(parts, "wid")
    known = written(encode_words(distinct, pieces(spark, model), fold))
    back = _returned(known, words.filter("word is null"), model)
    back = back.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts", "ids"))).alias("back"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                counts, ids = (np.frombuffer(b"".join([zstandard.decompress(x[c]) for x in row["back"] or ()]), "<u4").astype(np.int64) for c in ("counts", "ids"))
                codes = np.frombuffer(zstandard.decompress(row["d"]), "<u4")
                n = counts[codes]
                upto = np.append(0, np.cumsum(n))
                own = ids[np.arange(upto[-1]) + np.repeat((np.cumsum(counts) - counts)[codes] - upto[:-1], n)].astype(np.int32)
                ends = upto[np.append(0, np.cumsum(np.frombuffer(row["c"], "<i4").astype(np.int64)))]
                doc_ids = pa.array(np.frombuffer(row["a"], "<i8"), mask=~np.frombuffer(row["b"], bool))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(ends.astype(np.int32), own)], ["doc_id", "ids"])

    return chunks.filter("bucket < 0").select("chunk", "a", "b", "c", "d").join(back, "chunk", "left").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL, name: str = "text") -> DataFrame:
    """``encoded`` with a column ``name`` (in place of one that has it): pieces and byte pieces end to end, marks as spaces, the first one dropped."""

    p = _processor(model)
    raw = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else b"" if p.is_control(i) or p.is_unknown(i) else p.id_to_piece(i).replace(MARK, " ").encode() for i in range(p.get_piece_size())]
    sent = encoded.sparkSession.sparkContext.broadcast(raw)
    encoded = encoded.drop(*(c for c in encoded.columns if c.lower() == name.lower()))
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.array([len(x) for x in sent.value])
        upto = np.cumsum(size) - size
        table = np.frombuffer(b"".join(sent.value), np.uint8)
        for batch in batches:
            lists = batch.column("ids")
            ids, offsets = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.int64), lists.offsets.to_numpy().astype(np.int64)
            out = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = ids[a:b]
                n = size[own]
                out.append(table[np.arange(n.sum()) + np.repeat(upto[own] - (np.cumsum(n) - n), n)].tobytes().decode("utf-8", "replace").removeprefix(" "))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, `{name}` string")
