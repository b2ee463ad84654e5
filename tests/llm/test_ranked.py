"""Ranked search against brute force over whole texts."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from stratum.llm import ranked
from stratum.llm.queries import ORACLES, op12_ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k):
    held = [(i, Counter(t), len(t)) for i, text, *_ in docs if (t := terms(text))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text, *_ in items:
        scored = []
        for doc, c, n in held:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            scored += [(-score, doc is None, doc or 0, doc)] if score > 0 else []
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    r = np.random.default_rng(5)
    vocabulary = ["the", "Of", "ÄRGER", "été", "x1", "漢字", *(f"w{i}" for i in range(300))]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    prose = lambda n: ", ".join(str(x) for x in r.choice(vocabulary, n, p=p / p.sum()))
    items = [(i, prose(int(r.integers(1, 40)))) for i in range(25)] + [(100, None), (101, "..."), (102, "unheard"), (None, "the w5"), (103, items_copy := "w7 w7 W7 w8"), (104, items_copy)]
    docs = [(i, prose(int(r.integers(1, 200))), "x", 1) for i in range(500)]
    docs += [(600 + i, items[3][1] + " " + prose(5), "x", 1) for i in range(70)] + [(700 + i, docs[3][1], "x", 1) for i in range(300)]  # near and exact copies
    docs += [(None, items[0][1], "x", 1), (5, docs[5][1], "x", 1), (900, None, "x", 1), (901, "", "x", 1), (902, " .,\n", "x", 1), (903, prose(30_000), "x", 1), (904, "漢字" * 5000, "x", 1)]
    return docs, items


def test_query_equals_brute_force(spark, tables, tmp_path):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string, item string, rank int").repartition(5)
    b = spark.createDataFrame([(*x, "s", 2) for x in items], "item_id long, text string, doc string, score int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = lambda df: sorted((tuple(x) for x in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert rows(op12_ranked_search(spark, str(tmp_path))) == brute(docs, items, 50)
    # Small buckets, so that thresholds are carried from bucket to bucket; items in several blocks.
    for k, parts, bucket, chars in ((50, 3, 16, 10**6), (3, 7, 8, 400), (1, 1, 4, 10**6)):
        assert rows(ranked.ranked_search(d, b, k, parts=parts, bucket=bucket, block_chars=chars)) == brute(docs, items, k)
    assert ranked.ranked_search(d.limit(0), b).count() == 0 and ranked.ranked_search(d, b.limit(0)).count() == 0


def test_buckets_and_documents_are_pruned(spark, tables, monkeypatch):
    """What is rescored is a part of what is searched."""
    docs, items = tables
    import pyarrow as pa

    block = ranked.Items.of(pa.array([items[3][1]]))
    weights = np.arange(len(block.hashes), 0, -1).astype(np.int64) * 100
    best = ranked._Best(2, np.array([1]))
    added = []
    monkeypatch.setattr(best, "add", lambda q, s, d, k, add=best.add: (added.append(len(s)), add(q, s, d, k)))
    heavy, lengths, weight = [block.terms[0]], np.array([np.sqrt((weights.astype(float) ** 2).sum())]), np.zeros(len(weights), np.int64)
    row = lambda n, impact: {"docs": pa.array(range(n)), "lengths": pa.array([float(np.sqrt(len(weights)) * impact)] * n), "sizes": pa.array([len(weights)] * n, pa.int32()), "terms": pa.array(np.tile(np.arange(len(weights)), n).astype(np.int32)), "impacts": pa.array(np.full(n * len(weights), impact, np.int32))}
    for impact in (1000, 900, 10):
        top = float(np.sqrt(len(weights)) * impact)
        ranked._in_bucket(row(50, impact), top, heavy, lengths, weights, weight, best)
    assert added[0] == 50 and sum(added) < 150


def test_oracle(spark, tables):
    docs, items = tables
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([x[0] for x in docs], "Int64"), "text": [x[1] for x in docs]}))
    con.register("benchmark", pd.DataFrame({"item_id": pd.array([x[0] for x in items], "Int64"), "text": [x[1] for x in items]}))
    got = con.sql(ORACLES["op12_ranked_search"]).fetchall()
    assert sorted(got, key=str) == brute(docs, items, 50)
