"""MinHash near-duplicates: banded candidates, sequential Bayesian verification, exact confirmation.

Texts with equal shingle sets form a class; all further work is on one representative of each. Banded
signatures put representatives into buckets. First every bucket's members meet its smallest one (a
star, not all pairs), and each representative's best pair is confirmed; what that links is one
component. Then only buckets that still hold several components are compared across components:
first the likeliest pairs that would join them, as a spanning tree, then all pairs that are left. In
every round a pair's signatures are compared a batch at a time, and the pair is dropped as soon as
the posterior probability that its similarity reaches the threshold is below the chosen miss
probability; survivors are confirmed on their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.flat import flat, frugal, mix, steps
from stratum.llm.shared import bounded_batches, cut, written
from stratum.llm.shingles import shingle_sets
from stratum.llm.tables import components, free_name, gathered, grouped, only

#: Signature values, those that bands may use, values compared at once, and the probability that verification may miss a true pair.
HASHES, BANDED, BATCH, MISS = 384, 200, 32, 1e-4
#: Members of a bucket that one task compares with as many others at once, and documents whose sets it holds.
CHUNK, SETS = 1024, 1000


def bands(percent: int) -> tuple[int, int]:
    """Number of bands and values of each: the longest bands that miss a pair at the threshold with at most MISS / 100."""
    for rows in range(20, 0, -1):
        if (1 - (percent / 100) ** rows) ** (BANDED // rows) <= MISS / 100:
            return BANDED // rows, rows
    return BANDED, 1


@lru_cache
def fewest_matches(percent: int) -> list[tuple[int, int]]:
    """(values compared, fewest matches that keep a pair) after each batch.

    The prior of the similarity is uniform, so after m matches of n its posterior is Beta(m + 1, n - m + 1).
    Sketches keep 8 bits of a value, which match by chance once in 256. Each batch may miss its share of MISS, so that all together keep it.
    """
    rate = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in range(BATCH, HASHES - HASHES % BATCH + 1, BATCH):
        tail, m = 0.0, -1
        while tail < MISS / (HASHES // BATCH) and m < n:  # P(rate >= threshold | m of n) = P(Binomial(n + 1, threshold) <= m)
            m += 1
            tail += math.comb(n + 1, m) * rate**m * (1 - rate) ** (n + 1 - m)
        out.append((n, m))
    return out


def surviving(left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and matches of the pairs of sketches (n rows each) that every batch's bound leaves."""
    alive = np.arange(len(left))
    matches, done = np.zeros(len(left), np.int32), 0
    for n, least in fewest_matches(percent):
        matches += (left[alive, done:n] == right[alive, done:n]).sum(1, dtype=np.int32)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
        if not len(alive):
            break
    return alive, matches


def _signatures(docs: DataFrame, text: str, shingle: int, percent: int) -> DataFrame:
    """doc_id, n, d1 and d2 (a 128-bit digest of the set), band hashes and sketch of every document; null text is empty."""
    n_bands, rows = bands(percent)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(20_240_229)
        scale = random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        shift = random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
        weights = random.integers(0, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
        salts = mix(np.arange(1, n_bands + 1, dtype=np.uint64))
        for part in steps(batches, text):
            sets = shingle_sets(*flat(part.column(text)), shingle)
            signature = np.empty((len(sets), HASHES), np.uint32)
            digests = np.zeros((len(sets), 2), np.int64)
            for i, s in enumerate(sets):
                if not len(s):
                    continue
                low = (s >> np.uint64(32)).astype(np.uint32)
                signature[i] = np.min([((low[a : a + 2048, None] ^ shift) * scale).min(0) for a in range(0, len(low), 2048)], 0)
                digests[i] = np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64).view(np.int64)
            wide = signature[:, : n_bands * rows].astype(np.uint64).reshape(len(sets), n_bands, rows)
            keys = mix((mix(wide + np.uint64(1)) * weights).sum(2, dtype=np.uint64) ^ salts)
            sketch = (signature >> np.uint32(7)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([x.tobytes() for x in (keys >> np.uint64(32)).astype(np.uint32)], pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary())],
                ["doc_id", "n", "d1", "d2", "keys", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, keys binary, sketch binary")


def _bucket_rows(reps: DataFrame) -> DataFrame:
    """key, id: a row for each band of each representative; the band is part of the key."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(flat(batch.column("keys"))[0].tobytes(), np.uint32)
                n = len(keys) // batch.num_rows
                keys = np.tile(np.arange(n, dtype=np.int64), batch.num_rows) << 32 | keys.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("id").to_numpy(), n))], ["key", "id"])

    return reps.select("keys", "id").mapInArrow(run, "key long, id long")


def _matrix(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    return np.frombuffer(flat(column)[0].tobytes(), dtype).reshape(-1, width)


def _star(members: DataFrame, firsts: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b): every representative b with that smallest member a of its buckets which it shares most of them with, if the bound leaves the pair."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive, _ = surviving(_matrix(batch.column("sa"), HASHES, np.uint8), _matrix(batch.column("sb"), HASHES, np.uint8), percent)
                yield batch.select(["a", "b"]).take(pa.array(alive))

    pairs = members.join(firsts, "key").filter("id > first").groupBy(F.col("first").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("shared"))
    best = pairs.groupBy("b").agg(F.max(F.struct("shared", -F.col("a"))).alias("best")).select((-F.col("best.col2")).alias("a"), "b")
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    close = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return best.join(side("b"), "b").join(side("a"), "a").filter(close).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


class _Sets:
    """Disjoint sets of a task's ids."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def top(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def joined(self, x: int, y: int) -> bool:
        return self.top(x) == self.top(y)

    def join(self, x: int, y: int) -> None:
        self.parent[self.top(x)] = self.top(y)


def _spanning(left: np.ndarray, right: np.ndarray, matches: np.ndarray) -> list[int]:
    """Numbers of the pairs that join two sets not joined yet, likest first."""
    sets, out = _Sets(), []
    for i in np.argsort(-matches, kind="stable").tolist():
        a, b = int(left[i]), int(right[i])
        if not sets.joined(a, b):
            sets.join(a, b)
            out.append(i)
    return out


def _across(members: DataFrame, labels: DataFrame, reps: DataFrame, percent: int, tree: bool) -> DataFrame:
    """(a, b): pairs of different components that share a bucket and that the Bayesian bound leaves.

    With ``tree``, the smallest member of each component in a bucket stands for it there, and only the pairs of a
    spanning tree of the components that meet in a task's cell are told. A large bucket is dealt out as pairs of chunks, so that no task holds more than two chunks at once.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "cell"):
            label, ids, n = (group.column(c).to_numpy() for c in ("label", "id", "n"))
            side = group.column("side").to_numpy()
            sketch = _matrix(group.column("sketch"), HASHES, np.uint8)
            bands_of, band = (None, None) if tree else (_matrix(group.column("keys"), n_bands, np.uint32), group.column("band").to_numpy())
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a in range(0, len(left), CHUNK):  # one step unless hashing has made a chunk uneven
                i, j = (x.ravel() for x in np.meshgrid(left[a : a + CHUNK], right, indexing="ij"))
                keep = (label[i] != label[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent) & ((side[i] != side[j]) | (ids[i] < ids[j]))
                i, j = i[keep], j[keep]
                for b in range(0, len(i), 1 << 17):
                    x, y = i[b : b + (1 << 17)], j[b : b + (1 << 17)]
                    alive, matches = surviving(sketch[x], sketch[y], percent)
                    x, y = x[alive], y[alive]
                    if not tree:  # a pair that meets in several bands is told in the first of them alone
                        once = (bands_of[x] == bands_of[y]).argmax(1) == band[x]
                        x, y, matches = x[once], y[once], matches[once]
                    found.append((x, y, matches))
            if found:
                x, y, matches = (np.concatenate(z) for z in zip(*found, strict=True))
                if tree:
                    chosen = np.array(_spanning(label[x], label[y], matches), np.int64)
                    x, y = x[chosen], y[chosen]
                x, y = ids[x], ids[y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    n_bands, _ = bands(percent)
    marked = members.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    if tree:
        marked = marked.groupBy("key", "label").agg(F.min("id").alias("id")).select("key", "id", "label")
    mixed = marked.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).filter("x <> y").select("key", F.ceil(F.col("size") / CHUNK).alias("chunks"))
    dealt = marked.join(mixed, "key").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    # Chunk c meets every chunk d: the cell is (min, max), and side tells which of the two the member is in (2: both).
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    more = [] if tree else ["band"]
    cells = cells.withColumn("band", F.shiftright("key", 32)).select("id", "label", *more, F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"), F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0).otherwise(1).alias("side"))
    keys = [] if tree else ["keys"]
    full = cells.join(reps.select("id", "n", "sketch", *keys), "id").repartition("cell").sortWithinPartitions("cell")
    return full.select("cell", "id", "label", "n", "side", "sketch", *more, *keys).mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, text: str, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    @frugal
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(*flat(part.column(text)), shingle)], pa.binary())], ["a", "members"])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "cell"):
            first, second = group.column("a").to_pylist(), group.column("b").to_pylist()
            own = {x: np.frombuffer(group.column("members")[i].as_buffer(), np.uint64) for i, (x, y) in enumerate(zip(first, second, strict=True)) if y is None}
            links = _Sets()
            out = []
            for x, y in zip(first, second, strict=True):
                # What is connected already needs no further link.
                if y is None or x not in own or y not in own or links.joined(x, y):
                    continue
                both = np.concatenate([own[x], own[y]])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    links.join(x, y)
                    out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    # Documents are dealt into parts; a pair goes to the cell of its two parts, and a document's set to each cell that has a pair of it, once.
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    n_ids = ids.count()
    ids = cut(gathered(ids, n_ids))
    parts = max(1, -(-n_ids // SETS))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    celled = pairs.select(F.xxhash64(part("a"), part("b")).alias("cell"), "a", "b")
    own = only(docs.select(F.col("doc_id").cast("long"), text), ids, "doc_id").mapInArrow(sets, "a long, members binary").dropDuplicates(["a"])
    sent = celled.select("cell", "a").union(celled.select("cell", "b")).distinct().join(own, "a").select("cell", "a", F.lit(None).cast("long").alias("b"), "members")
    rows = sent.union(celled.select("cell", "a", "b", F.lit(None).cast("binary").alias("members")))
    return gathered(cut(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")), n_ids)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the smallest doc_id reachable, and kept marks it. Null and empty texts are linked
    with nothing. Rows that share a doc_id are one document; rows with a null doc_id are left out.
    """
    bounded_batches(docs.sparkSession)
    base = written(_signatures(docs.filter("doc_id is not null"), text, shingle, percent))
    full = base.filter("n > 0")
    classes = cut(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("id")))
    copies = cut(full.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).filter("doc_id <> id").select("doc_id").distinct())
    reps = only(full, copies, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "n", "keys", "sketch")
    rows = _bucket_rows(reps)
    firsts = rows.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("size")).filter("size > 1").select("key", "first")
    firsts = cut(firsts)
    members = written(rows.join(firsts, "key", "left_semi"))
    n_classes = classes.count()
    small = lambda df: gathered(cut(df), n_classes)  # noqa: E731  (what is read from it leaves few files)
    tried = small(_star(members, firsts, reps, percent))
    found = _confirmed(tried, docs, text, shingle, percent)
    named = lambda links: small(components(links).select(F.col("node").alias("id"), F.col("component").alias("label")))
    labels = named(found)
    for tree in (True, False):
        more = small(_across(members, labels, reps, percent, tree).join(tried, ["a", "b"], "left_anti"))
        if more.take(1):
            found, tried = found.union(_confirmed(more, docs, text, shingle, percent)), tried.union(more)
            labels = named(found)
    rows = base.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2"], "left").join(labels, "id", "left")
    component = F.when(F.col("n") > 0, F.coalesce("label", "id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one of the smallest doc_id.

    Rows of equal doc_id and text are one document, of which one row stays. Each other text of a
    doc_id, and each text without one, is a document of its own, after all others. Null and empty
    texts are near nothing.
    """
    own = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    if not own.filter("n > 1").take(1) and not docs.filter("doc_id is null").take(1):
        gone = near_duplicates(docs, shingle, percent, text).filter("not kept").select("doc_id")
        return only(docs, gone, "doc_id", "left_anti")
    t1, t2, first, number = (free_name(docs, x) for x in ("t1", "t2", "first", "number"))
    key = F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()
    keyed = docs.withColumn(t1, F.xxhash64(F.lit(1), *key)).withColumn(t2, F.xxhash64(F.lit(2), *key)).dropDuplicates(["doc_id", t1, t2])
    firsts = keyed.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(t1, t2)).alias(first))
    marked = written(keyed.join(firsts, "doc_id", "left").withColumn(first, F.coalesce(F.col(first) == F.struct(t1, t2), F.lit(False))))
    # The first text of an id keeps the id as its number; the others are numbered from the greatest on.
    greatest = marked.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0
    numbered = written(marked.withColumn(number, F.when(F.col(first), F.col("doc_id").cast("long")).otherwise(F.monotonically_increasing_id() + greatest + 1)))
    gone = near_duplicates(numbered.select(F.col(number).alias("doc_id"), text), shingle, percent, text).filter("not kept").select(F.col("doc_id").alias(number))
    return only(numbered, gone, number, "left_anti").select(*docs.columns)
