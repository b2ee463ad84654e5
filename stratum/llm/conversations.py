"""Repair of a conversation's structure with the fewest edits, by Hirschberg's divide and conquer.

A repaired conversation's role initials follow ``(s?(ua)+)?``: four states (nothing yet, after the
system's turn, after a user's, after an assistant's). Each row is kept, given the other role or
deleted, and turns may be inserted. The cost of going from any state before some rows to any state
after them is a vector of four; a forward vector over the first half of the rows and a backward one
over the second half meet in the middle, the crossing with the least audit among the cheapest is
taken, and both halves are solved the same way, so that only vectors are held.

The least audit needs no text: two audits that end in different states after the same rows are never
prefixes of each other, so that the forward vector carries the order of its four least audits along.

A conversation may hold a large share of all rows. Rows without their texts are dealt by ranges of
(conversation, turn), so that it spans as many partitions as it fills; each of its fragments is
summed up as costs and orders from every state to every state, the summaries (two a partition at
most) give the states at the borders, and every fragment is then solved on its own. Texts are
shuffled once, and stream past their conversation's audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.shared import bounded_batches, written

# The costs of edits, the roles that may be given, and what counts as white space and as an end.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
BLANK_CHARACTERS, ENDS = r"\x20\x09-\x0D", "[.!?]"

#: States: nothing yet, after s, after u, after a; classes of a role's initial and faults of a row make its code.
START, S, U, A = range(4)
CLASSES = "sua"
FINE, CUT, BLANK, SEEN = range(4)
#: What may follow a state, and how many turns must be inserted at the end.
_NEXT = {START: U, S: U, U: A, A: U}
_TAIL = (0, 2, 1, 0)
_INF = 1 << 30
#: A state that costs so much more than another can't be on a cheapest way: two insertions bring any state where another is.
_APART = 2 * INSERT
_SHORT = 8


def _edits(state: int, code: int) -> dict[int, tuple[int, str]]:
    """For each state that follows ``state`` by one row: cost and letters of the cheapest edits, inserted turns before it included."""
    role, fault = divmod(code, 4)
    out: dict[int, tuple[int, str]] = {}
    for inserted in range(3):
        ways = [(DELETE, "D", state)]
        if fault < BLANK:
            extra = TRUNCATED if fault == CUT else 0
            ways.append((REROLE + extra, "R", _NEXT[state]))
            kept = S if role == 0 and state == START else _NEXT[state] if role < 3 and _NEXT[state] == role + 1 else None
            if kept is not None:
                ways.append((KEEP + extra, "K", kept))
        for cost, letter, after in ways:
            way = (cost + INSERT * inserted, "I" * inserted + letter)
            out[after] = min(out.get(after, (_INF, "")), way)
        state = _NEXT[state]
    return out


_EDITS = [[_edits(s, c) for c in range(16)] for s in range(4)]
Vector = tuple[tuple[int, ...], tuple[int, ...]]


@lru_cache(maxsize=65536)
def _forward(vector: Vector, code: int) -> tuple[int, Vector]:
    """One row on: what the least cost grew by, and the new costs above it with the order of the four least audits."""
    costs, ranks = vector
    found = [(_INF, 0, "")] * 4
    for s in range(4):
        if costs[s] < _INF:
            for after, (cost, letters) in _EDITS[s][code].items():
                found[after] = min(found[after], (costs[s] + cost, ranks[s], letters))
    least = min(found)[0]
    order = sorted(range(4), key=lambda s: (found[s][0] >= _INF, found[s][1:]))
    return least, (tuple(c - least if c - least <= _APART else _INF for c, _, _ in found), tuple(order.index(s) for s in range(4)))


@lru_cache(maxsize=65536)
def _backward(costs: tuple[int, ...], code: int) -> tuple[int, ...]:
    """One row back: what it costs from each state to the end, above the least."""
    found = [min((costs[after] + cost for after, (cost, _) in _EDITS[s][code].items()), default=_INF) for s in range(4)]
    least = min(found)
    return tuple(min(c - least, _INF) for c in found)


def _only(state: int) -> Vector:
    return tuple(0 if s == state else _INF for s in range(4)), (0, 1, 2, 3)


def _over(codes: bytes, vector: Vector) -> tuple[int, Vector]:
    total = 0
    for code in codes:
        cost, vector = _forward(vector, code)
        total += cost
    return total, vector


def audit(codes: bytes, start: int, end: int) -> str:
    """The least of the cheapest audits of rows of these codes from ``start`` to ``end``, in memory of the rows' number."""
    out: list[str] = []
    todo = [(0, len(codes), start, end)]
    while todo:
        a, b, start, end = todo.pop()
        if b - a <= _SHORT:
            out.append(_short(codes[a:b], start, end))
        elif end in (START, S):
            out.append(_few(codes[a:b], start, end))
        else:
            middle = (a + b) // 2
            crossing = _crossing(codes[a:middle], codes[middle:b], start, end)
            todo += [(middle, b, crossing, end), (a, middle, start, crossing)]
    return "".join(out)


def _crossing(left: bytes, right: bytes, start: int, end: int) -> int:
    """The state between the halves: of the cheapest, the one whose audit is least."""
    costs, ranks = _over(left, _only(start))[1]
    back = tuple(0 if s == end else _INF for s in range(4))
    for code in reversed(right):
        back = _backward(back, code)
    return min(range(4), key=lambda s: (min(costs[s] + back[s], _INF), ranks[s]))


@lru_cache(maxsize=262144)
def _short(codes: bytes, start: int, end: int) -> str:
    if end in (START, S) or not codes:
        return _few(codes, start, end)
    if len(codes) == 1:
        return _EDITS[start][codes[0]][end][1]
    middle = len(codes) // 2
    crossing = _crossing(codes[:middle], codes[middle:], start, end)
    return _short(codes[:middle], start, crossing) + _short(codes[middle:], crossing, end)


def _few(codes: bytes, start: int, end: int) -> str:
    """To where at most a system's turn stands: all go but one, the latest that is whole, or else the latest."""
    out = ["D"] * len(codes)
    if start != end:
        whole = codes.rfind(bytes([FINE]))
        out[whole if whole >= 0 else codes.rfind(bytes([CUT]))] = "K"
    return "".join(out)


def whole_audit(codes: bytes) -> tuple[str, int]:
    """Audit and cost of a whole conversation; short ones are remembered, as their codes come again and again."""
    return _remembered(codes) if len(codes) <= 4 * _SHORT else _remembered.__wrapped__(codes)


@lru_cache(maxsize=262144)
def _remembered(codes: bytes) -> tuple[str, int]:
    total, (costs, ranks) = _over(codes, _only(START))
    end = min(range(4), key=lambda s: (costs[s] + INSERT * _TAIL[s], ranks[s]))
    return audit(codes, START, end) + "I" * _TAIL[end], total + costs[end] + INSERT * _TAIL[end]


# --- rows ----------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped) after the damage that crc32(``conv_id:turn``) % 20 names; nulls count as one space."""
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(spaced("text"), ENDS, "")).otherwise(spaced("text"))
    return rows.select("conv_id", "turn", F.when(way == 4, ROLES["u"]).otherwise(spaced("role")).alias("role"), text.alias("text"), F.when(way == 0, 0).when(way == 3, 2).otherwise(1).alias("copies"))


def _as_given(rows: DataFrame) -> DataFrame:
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    return rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), F.lit(1).alias("copies"))


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def coded(rows: DataFrame) -> DataFrame:
    """One row for equal rows (conv_id, turn, role, digest of the text), with its code and how many rows are seen copies of it: no texts.

    A row is blank, or else seen (role and text stand earlier in the conversation), or else cut, or
    fine. The first of equal rows has the code; the ``again`` others are seen (or blank).
    """
    blank = ~F.col("text").rlike(f"[^{BLANK_CHARACTERS}]")
    cut = ~F.col("text").rlike(f"{ENDS}[{BLANK_CHARACTERS}]*\\z")
    narrow = rows.filter("copies > 0").select("conv_id", "turn", "role", _digest("text").alias("digest"), F.when(blank, BLANK).when(cut, CUT).otherwise(FINE).alias("fault"), "copies")
    equal = narrow.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = equal.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.min(place).alias("_first"))
    joined = equal.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")))
    role = F.instr(F.lit(CLASSES), F.substring("role", 1, 1)) - 1
    role = F.when((F.length("role") == 0) | (role < 0), 3).otherwise(role)
    fault = F.when(F.col("fault") == BLANK, BLANK).when(place.eqNullSafe(F.col("_first")), F.col("fault")).otherwise(SEEN)
    return joined.select("conv_id", "turn", "role", "digest", (role * 4 + fault).cast("int").alias("code"), (role * 4 + F.when(fault == BLANK, BLANK).otherwise(SEEN)).cast("int").alias("later"), (F.col("n") - 1).alias("again"))


_FRAGMENT = "conv {conv}, part int, edge boolean, codes binary, first_turn long, last_turn long, low long, high long, turns long, summary array<long>, audit string, cost long"


def _fragment(codes: bytes, turns: list[np.ndarray], edge: bool) -> dict:
    known = np.concatenate(turns)
    out = {"edge": edge, "codes": codes, "first_turn": int(known[0]) if len(known) else None, "last_turn": int(known[-1]) if len(known) else None, "low": int(known[0]) if len(known) else None, "high": int(known[-1]) if len(known) else None, "turns": len(np.unique(known)), "summary": None, "audit": None, "cost": None}
    if edge:
        out["summary"] = [x for s in range(4) for total, (costs, ranks) in [_over(codes, _only(s))] for x in (*(c + total if c < _INF else _INF for c in costs), *ranks)]
    else:
        out["audit"], out["cost"] = whole_audit(codes)
    return out


def fragments(rows: DataFrame, parts: int) -> DataFrame:
    """What each of ``parts`` ranges of (conv_id, turn, role, digest) holds of a conversation: codes, turns, and the audit where the conversation can't go on in another range, else its summary."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, schema = TaskContext.get().partitionId(), None
        held: tuple[object, list[bytes], list[np.ndarray]] | None = None
        first, ready = True, []

        def close(edge: bool) -> None:
            ready.append({"conv": held[0], "part": part} | _fragment(b"".join(held[1]), held[2], edge))

        for batch in batches:
            schema = pa.schema([("conv", batch.schema.field("conv_id").type), ("part", pa.int32()), ("edge", pa.bool_()), ("codes", pa.binary()), *((x, pa.int64()) for x in ("first_turn", "last_turn", "low", "high", "turns")), ("summary", pa.list_(pa.int64())), ("audit", pa.string()), ("cost", pa.int64())])
            ids = batch.column("conv_id").to_pylist()
            turn = batch.column("turn")
            known, turns = turn.is_valid().to_numpy(zero_copy_only=False), turn.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            again = batch.column("again").to_numpy()
            both = np.stack([batch.column("code").to_numpy(), batch.column("later").to_numpy()], 1).astype(np.uint8)
            codes = np.repeat(both.ravel(), np.stack([np.ones_like(again), again], 1).ravel())
            ends = np.cumsum(again + 1)
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held is None or held[0] != ids[a]:
                    if held is not None:
                        close(first)
                        first = False
                    held = (ids[a], [], [])
                held[1].append(codes[ends[a - 1] if a else 0 : ends[b - 1]].tobytes())
                held[2].append(turns[a:b][known[a:b]])
            if len(ready) >= 1000:
                yield pa.RecordBatch.from_pylist(ready, schema)
                ready.clear()
        if held is not None:
            close(True)
            yield pa.RecordBatch.from_pylist(ready, schema)

    ordered = coded(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, _FRAGMENT.format(conv=kind))


def _borders(summaries: pd.DataFrame) -> pd.DataFrame:
    """part, start, end, last of a conversation's fragments from their summaries."""
    rows = summaries.sort_values("part")
    costs, ranks, ways = [0, _INF, _INF, _INF], [0, 1, 2, 3], []
    for x in rows["summary"]:
        m = np.asarray(x, np.int64).reshape(4, 8)
        found = [min((min(costs[s] + int(m[s, e]), _INF), ranks[s], int(m[s, 4 + e]), s) for s in range(4)) for e in range(4)]
        order = sorted(range(4), key=lambda e: (found[e][0] >= _INF, found[e][1:3]))
        costs, ranks = [f[0] for f in found], [order.index(e) for e in range(4)]
        ways.append([f[3] for f in found])
    end = min(range(4), key=lambda e: (costs[e] + INSERT * _TAIL[e], ranks[e]))
    states = [end]
    for way in reversed(ways):
        states.append(way[states[-1]])
    states.reverse()
    return pd.DataFrame({"part": rows["part"].astype("int32"), "start": np.array(states[:-1], "int32"), "end": np.array(states[1:], "int32"), "last": [*[False] * (len(rows) - 1), True]})


def solved(found: DataFrame) -> DataFrame:
    """Fragments with their audits and costs; those at the ends of ranges by the states at their borders."""
    kind = found.schema["conv"].dataType.simpleString()
    edge = found.filter("edge")
    # At most two fragments a range are at its ends, so that these states are few and small.
    states = edge.select("conv", "part", "summary").groupBy("conv").applyInPandas(lambda key, x: _borders(x).assign(conv=key[0]), f"part int, start int, end int, last boolean, conv {kind}")
    known = edge.drop("audit", "cost").join(F.broadcast(states.withColumnsRenamed({"conv": "_conv", "part": "_part"})), F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))

    @F.udf("audit string, cost long")
    def solve(codes, start, end, last):
        codes, tail = bytes(codes), _TAIL[end] if last else 0
        letters = audit(codes, start, end)
        cost, i = INSERT * tail, 0
        for x in letters:
            cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[x] + (TRUNCATED if x in "KR" and codes[i] % 4 == CUT else 0)
            i += x != "I"
        return letters + "I" * tail, cost

    done = known.withColumn("_way", solve("codes", "start", "end", "last")).withColumn("audit", F.col("_way.audit")).withColumn("cost", F.col("_way.cost"))
    return found.filter("not edge").unionByName(done.select(*found.columns))


def _illegal(codes: np.ndarray) -> int:
    role = codes >> 2
    legal = (role[:-1] == 0) & (role[1:] == 1) | (role[:-1] == 1) & (role[1:] == 2) | (role[:-1] == 2) & (role[1:] == 1)
    return int((~legal).sum())


class _Conversation:
    """What is known of one conversation while its fragments and then its texts stream past."""

    def __init__(self, conv: object):
        self.conv, self.audits, self.hash = conv, [], hashlib.sha256()
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0)
        self.low = self.high = self.last_turn = self.last_role = None
        self.letters, self.at, self.state, self.first = None, 0, START, True

    def fragment(self, codes: bytes, first_turn: int | None, last_turn: int | None, turns: int, audit: str, cost: int) -> None:
        codes, counts = np.frombuffer(codes, np.uint8), self.counts
        for name, fault in (("blank", BLANK), ("duplicate", SEEN), ("truncated", CUT)):
            counts[name] += int((codes & 3 == fault).sum())
        counts["illegal"] += _illegal(codes if self.last_role is None else np.concatenate([[self.last_role], codes]))
        counts["cost"] += cost
        counts["turns"] += turns - (first_turn is not None and first_turn == self.last_turn)
        self.last_role = codes[-1]
        if first_turn is not None:
            self.low, self.high, self.last_turn = first_turn if self.low is None else self.low, last_turn, last_turn
        self.audits.append(audit)

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("" if self.first else "\n") + f"{role}:{text}").encode())
        self.first = False

    def _insert(self) -> None:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.state = _NEXT[self.state]
            self._line(ROLES[CLASSES[self.state - 1]], "")
            self.at += 1

    def row(self, role: str, text: str, copies: int) -> None:
        if self.letters is None:
            self.letters = "".join(self.audits)
        for _ in range(copies):
            self._insert()
            letter = self.letters[self.at]
            self.at += 1
            if letter == "R":
                self.state = _NEXT[self.state]
                self._line(ROLES[CLASSES[self.state - 1]], text)
            elif letter == "K":
                self.state = CLASSES.index(role[0]) + 1
                self._line(role, text)

    def result(self) -> dict:
        self.letters = "".join(self.audits)
        self._insert()
        counts = dict(self.counts)
        turns = counts.pop("turns")
        return {"conv_id": self.conv, "gaps": self.high - self.low + 1 - turns if self.low is not None else 0, **counts, "audit": self.letters, "repaired_sha256": self.hash.hexdigest()}


def repair(rows: DataFrame, damage: bool = True, parts: int | None = None) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn, role, text, and any others, which are left alone. They are taken by
    turn (nulls first); rows of one turn by role and then by a hash of their text, so that equal rows
    stand side by side. Null roles and texts count as one space; null conv_ids are one conversation.
    A conversation of which nothing is left has zeros, an empty audit and the hash of an empty text.
    An empty table gives no rows. An audit is one value: one letter a row has to fit it.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = damaged(rows) if damage else _as_given(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    audits = solved(written(fragments(taken, parts)))
    none = lambda name, of: F.lit(None).cast(of).alias(name)
    first = audits.select("conv", F.lit(0).alias("kind"), "part", none("turn", "long"), none("role", "string"), none("digest", "binary"), none("text", "string"), none("copies", "int"), "codes", "first_turn", "last_turn", "turns", "audit", "cost")
    then = taken.select(F.col("conv_id").alias("conv"), F.lit(1).alias("kind"), none("part", "int"), F.col("turn").cast("long").alias("turn"), "role", _digest("text").alias("digest"), F.when(F.col("copies") > 0, F.col("text")).alias("text"), "copies", none("codes", "binary"), none("first_turn", "long"), none("last_turn", "long"), none("turns", "long"), none("audit", "string"), none("cost", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv").type), *((x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            column = {name: batch.column(name).to_pylist() for name in ("conv", "kind", "role", "text", "copies", "codes", "first_turn", "last_turn", "turns", "audit", "cost")}
            ready = []
            for i, conv in enumerate(column["conv"]):
                if now is None or now.conv != conv:
                    if now is not None:
                        ready.append(now.result())
                    now = _Conversation(conv)
                if column["kind"][i] == 0:
                    now.fragment(*(column[x][i] for x in ("codes", "first_turn", "last_turn", "turns", "audit", "cost")))
                elif column["copies"][i]:
                    now.row(column["role"][i], column["text"][i], column["copies"][i])
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.result()], schema)

    order = [F.col("conv").asc_nulls_first(), "kind", "part", F.col("turn").asc_nulls_first(), "role", "digest"]
    streamed = first.unionByName(then).repartition("conv").sortWithinPartitions(*order)
    return streamed.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
