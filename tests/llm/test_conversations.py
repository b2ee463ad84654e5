"""Conversation repair against plain enumeration, and against a plain row-by-row version of the whole query."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from stratum.llm import conversations
from stratum.llm.queries import op11_conversation_repair

GRAMMAR = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, codes string, part int"


def walk(rows, audit):
    """Initials, cost and lines that an audit gives, rows being (role, text, fault); None where it isn't allowed."""
    out, cost, rows, last = [], 0, list(rows), ""
    for x in audit:
        if x == "I":
            role, text = "a" if last == "u" else "u", ""
            out.append(("assistant" if role == "a" else "user", text))
            cost, last = cost + 5, role
            continue
        if not rows:
            return None
        role, text, fault = rows.pop(0)
        if x == "D":
            cost += 2
            continue
        if fault in ("blank", "duplicate"):
            return None
        if x == "R":
            role, cost = "assistant" if last == "u" else "user", cost + 1
        cost, last = cost + 5 * (fault == "truncated"), role[:1]
        out.append((role, text))
    return None if rows or not GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in out)) else (cost, audit, out)


def enumerated(rows):
    """The cheapest, least audit of a few rows by trying all with up to three insertions a place."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(("", "I", "II"), repeat=len(rows) + 1):
            if sum(map(len, gaps)) <= 3:
                found = walk(rows, "".join(g + e for g, e in zip(gaps, [*edits, ""], strict=True)))
                best = found if found and (best is None or found[:2] < best[:2]) else best
    return best


def plain(rows):
    """The cheapest, least audit by the full table of costs and audits."""
    best = {"": (0, "")}
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    for role, _, fault in rows:
        new = {}

        def offer(state, cost, audit, new=new):
            new[state] = min(new.get(state, (cost, audit)), (cost, audit))

        for state, (cost, audit) in best.items():
            for k in range(3):
                offer(state, cost + 5 * k + 2, audit + "I" * k + "D")
                if fault not in ("blank", "duplicate"):
                    extra = 5 * (fault == "truncated")
                    offer(step[state], cost + 5 * k + 1 + extra, audit + "I" * k + "R")
                    if role[:1] == step[state] or (role[:1] == "s" and state == ""):
                        offer(role[:1], cost + 5 * k + extra, audit + "I" * k + "K")
                state = step[state]
        best = new
    return min((cost + 5 * k, audit + "I" * k) for state, (cost, audit) in best.items() for k in [{"": 0, "s": 2, "u": 1, "a": 0}[state]])


def code(row):
    role, _, fault = row
    return "sua?".index(role[:1] if role[:1] in ("s", "u", "a") else "?") * 4 + {"": 0, "truncated": 1, "blank": 2, "duplicate": 3}[fault]


def draw(r, n):
    return [(str(r.choice(["system", "user", "assistant", "tool"], p=[0.15, 0.4, 0.4, 0.05])), "x", str(r.choice(["", "truncated", "blank", "duplicate"], p=[0.7, 0.1, 0.1, 0.1]))) for _ in range(n)]


def test_audits_are_the_least_of_the_cheapest():
    r = np.random.default_rng(0)
    for i in range(150):
        rows = draw(r, i % 5)
        best = enumerated(rows)
        assert conversations.whole_audit(bytes(map(code, rows))) == (best[1], best[0]) and plain(rows) == best[:2]
    for n in (7, 9, 40, 333, 2000):
        for _ in range(12):
            rows = draw(r, n)
            cost, audit = plain(rows)
            assert conversations.whole_audit(bytes(map(code, rows))) == (audit, cost)


def expected(rows, damage=True):
    """The query row by row."""
    spaced = [tuple(" " if x is None else str(x) for x in row) for row in rows]
    by = {}
    for (conv, turn, _, _), (c, t, role, text) in zip(rows, spaced, strict=True):
        way = zlib.crc32(f"{c}:{t}".encode()) % 20 if damage else -1
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        own = by.setdefault(conv, [])
        own += [(turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(x[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        marked = [(role, text, f) for (_, role, text), f in zip(own, faults, strict=True)]
        cost, audit = plain(marked)
        lines = walk(marked, audit)[2]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    texts = ["Hello there.", "What now?", "No end", " \t\n", "", "Fine!", "One. Two? Three", "É漢字.", "x" * 5000 + ".", None]
    out = []
    for conv in [*range(120), None]:
        for turn in range(int(r.integers(1, 9))):
            out.append((conv, turn if r.random() > 0.05 else None, [None, "", "system", "user", "assistant", "tool"][r.choice(6, p=[0.02, 0.02, 0.1, 0.43, 0.4, 0.03])], f"{turn} {texts[r.integers(0, 9)]}" if r.random() < 0.7 else texts[r.integers(0, 10)]))
    # One conversation of a third of all rows and more, with rows that stand many times.
    out += [(5000, i // 2, ("user", "assistant")[(i // 2 + (i % 97 == 0)) % 2], f"Turn {i // 2 if i % 5 else 0}.") for i in range(1500)] + [(5000, 9, "user", "Again.")] * 400
    return out


def test_query_equals_the_plain_version(spark, rows, tmp_path):
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], SCHEMA)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = op11_conversation_repair(spark, str(tmp_path)).collect()
    assert len(found) == len({x[0] for x in rows})
    want = expected(rows)
    for x in found:
        assert tuple(x[n] for n in names) == want[x.conv_id], x.conv_id
    # As many ranges as may be: the long conversation spans most of them.
    for damage, parts in ((True, 23), (False, 37)):
        want = expected(rows, damage)
        assert {x.conv_id: tuple(x[n] for n in names) for x in conversations.repair(df, damage, parts).collect()} == want
    assert conversations.repair(df.limit(0)).count() == 0
    gone = spark.createDataFrame([(i, j, "user", "Hi.", "c", 1) for i in range(2000) for j in (0,) if zlib.crc32(f"{i}:{j}".encode()) % 20 == 0], SCHEMA)
    assert gone.count() and {tuple(x[n] for n in names) for x in conversations.repair(gone).collect()} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
