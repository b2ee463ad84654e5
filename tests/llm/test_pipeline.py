"""Every stage of the pipeline against brute force on its own input."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from stratum.llm import sentencepiece_lattice
from stratum.llm.queries import op7_sentencepiece
from tests.llm.test_operators import brute_components, brute_lines, brute_repeats, ids_of, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, prose(i, 60) + (" idiot scum loser" if i % 4 == 0 else "")) for i in range(160)]
    rows += [(200 + i, prose(1, 60) if i < 3 else prose(900 + i, 80) + " " + prose(77, 120) + " " + prose(950 + i, 60)) for i in range(9)]
    rows += [(300 + i, " ".join(f"edit{i}" if j == 7 * i else w for j, w in enumerate(prose(66, 150).split()))) for i in range(8)] + [(400, ""), (401, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 160 and i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs.collect())
        assert name == "best_fit_packing" or docs.columns == columns
    before, after = seen["toxicity"]
    kept = {r.doc_id for r in after}
    assert {i for i in before if i >= 160 or i % 4} <= kept and len([i for i in kept if i < 160 and i % 4 == 0]) <= 4
    before, after = seen["line_dedup"]
    gone = brute_lines(list(before.items()))
    left = {i: t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in before.items()}
    # What would keep less than a third is a copy and stays whole.
    assert {r.doc_id: r.text for r in after} == {i: t if t is None or len(left[i]) * 3 < len(t) else left[i] for i, t in before.items()}
    before, after = seen["minhash_near_dedup"]
    assert {r.doc_id for r in after} == {i for i, (_, c) in brute_components(list(before.items()), 5, 80).items() if i == c}
    before, after = seen["suffix_array_dedup"]
    assert {r.doc_id: len((r.text or "").encode()) for r in after} == {i: n - m for i, (n, m, _, _) in brute_repeats(list(before.items())).items()}
    before, after = seen["best_fit_packing"]
    assert {r.doc_id: r.length for r in after} == {i: len(ids_of(t)) + 1 for i, t in before.items()}


def through(spark, rows, folder, labels=()):
    """What each stage leaves of the rows."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect()
    return out


def test_no_document_is_lost_where_rows_repeat_or_share_an_id(spark, tmp_path):
    lines = lambda seed, n: "\n".join(prose(100 * seed + i, 15) for i in range(n))
    a, b, c, d = lines(1, 12), lines(2, 12), lines(3, 12), lines(4, 12)
    near = a.split(" ")
    near[70] = "changed"
    rows = [(1, a), (2, b), (2, b), (5, " ".join(near)), (5, c), (6, b), (7, d), (None, d), (None, lines(5, 9)), (None, lines(5, 9)), (None, lines(6, 9)), (8, ""), (8, None), (9, None), (None, None)]
    out = through(spark, rows, str(tmp_path))
    assert len(out["line_dedup"]) == len(rows)
    kept = out["minhash_near_dedup"]
    texts = sorted(r.text for r in kept if r.text)
    assert texts == sorted([a, b, c, d, lines(5, 9), lines(6, 9)])
    assert {(r.doc_id, r.text) for r in kept} >= {(1, a), (2, b), (5, c), (7, d), (8, ""), (8, None), (9, None), (None, None)}
    assert sorted(r.text for r in out["suffix_array_dedup"] if r.text) == texts
    # Every text is packed once: its own pieces and no more.
    assert sum(r.length for r in out["best_fit_packing"]) == sum(len(ids_of(r.text)) + 1 for r in kept)


def test_stages_by_themselves_keep_repeated_rows_and_shared_ids(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    b, c = prose(2, 150), prose(3, 150)
    near = c.split(" ")
    near[70] = "changed"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], columns)
    rows = [(2, b), (2, b), (None, c), (None, c)]
    assert sorted(r.text for r in corpus_pipeline.suffix_array_dedup(spark, frame(rows), "").collect()) == sorted(t for _, t in rows)
    assert [r.text for r in corpus_pipeline.suffix_array_dedup(spark, frame([(2, b), (3, b)]), "").collect()] == ["", ""]
    found = corpus_pipeline.minhash_near_dedup(spark, frame([(1, c), (5, " ".join(near)), (5, b), (5, b)]), "").collect()
    assert sorted((r.doc_id, r.text) for r in found) == [(1, c), (5, b)]
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, frame([]), "").count() == 0


def test_near_duplicates_reach_their_stage(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    corpus_pipeline.line_dedup(spark, docs, folder).write.parquet(f"{tmp_path}/lines")
    lines = spark.read.parquet(f"{tmp_path}/lines")
    assert corpus_pipeline.minhash_near_dedup(spark, lines, folder).count() <= docs.count() - 40


def test_op7_is_the_model_s_own_encoding_and_decodes(spark):
    r = np.random.default_rng(0)
    odd = ["", None, " ", "  two  spaces ", "a\nb\tc", "漢字 é ß", "x" * 100 + " y", "emoji 😀 z", "▁ mark"]
    texts = odd + [prose(i, 30) for i in range(5)] + ["".join(chr(c) for c in r.integers(32, 700, 40)) for _ in range(10)]
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_lattice.MODEL))
    out = {x.doc_id: x for x in sentencepiece_lattice.decode(sentencepiece_lattice.encode(df)).collect()}
    for i, t in enumerate(texts):
        assert out[i].ids == model.encode(t or ""), t
        assert out[i].text == (t or "").replace("▁", " ")
    assert sentencepiece_lattice.encode(df.limit(0)).count() == 0


def best_path(word, table, longest, lowest):
    """The ids of the best path of one word by plain dynamic programming; characters without a piece as byte pieces."""
    best = [(0.0, 0, 0)]
    for end in range(1, len(word) + 1):
        edges = []
        for size in range(1, min(longest, end) + 1):
            piece = word[end - size : end]
            if piece in table or size == 1:
                i, score = table[piece] if piece in table else (-ord(piece), lowest - sentencepiece_lattice.UNKNOWN)
                edges.append((best[end - size][0] + score, size, i))
        best.append(max(edges))
    ids, end = [], len(word)
    while end:
        _, size, i = best[end]
        ids = ([i] if i >= 0 else [x + 3 for x in word[end - 1].encode()]) + ids
        end -= size
    return ids


def test_op7_query_takes_the_best_path_of_every_word_and_decodes(spark, tmp_path):
    r = np.random.default_rng(1)
    odd = ["", None, " ", "   ", "  two  spaces ", "a\nb\tc", "漢字 é ß 漢字漢字" * 9, "x" * 300 + " y", "emoji 😀 z", "▁ mark", "the best path of the lattice " * 40]
    texts = odd + [prose(i, 30) for i in range(5)] + ["".join(chr(c) for c in r.integers(32, 700, 90)) for _ in range(20)]
    df = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(4, odd[4])], "doc_id long, text string")
    rows = sentencepiece_lattice.vocabulary()
    table, longest, lowest = {p: (i, s) for p, i, s in rows}, max(len(p) for p, _, _ in rows), min(s for _, _, s in rows)
    got = sentencepiece_lattice.decode(sentencepiece_lattice.encode(df, fold="viterbi")).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got) == sorted([(False, i) for i in range(len(texts)) if i != 3] + [(True, 0), (False, 4)])
    for x in got:
        text = (texts[3 if x.doc_id is None else x.doc_id] or "").replace("▁", " ")
        words = re.findall(" +[^ ]*", f" {text}") if text else []
        assert x.ids == [i for w in words for i in best_path(w, table, longest, lowest)], text
        assert x.text == text
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {x.doc_id: x for x in op7_sentencepiece(spark, str(tmp_path)).collect()}
    want = {x.doc_id: x for x in got}
    assert all(rows[i].n_pieces == len(want[i].ids) and rows[i].decoded_sha256 == hashlib.sha256(want[i].text.encode()).hexdigest() for i in want)


def test_op7_long_text_without_cut_places_in_time(spark):
    """200,000 letters in which pieces go across every place: the fold's work grows with their number."""
    import time

    rows = sentencepiece_lattice.vocabulary()
    table, longest, lowest = {p: (i, s) for p, i, s in rows}, max(len(p) for p, _, _ in rows), min(s for _, _, s in rows)
    texts = ["a" * 200_000, "e" * 3000 + "s" * 700, "a" * 513]
    began = time.time()
    got = {x.doc_id: x.ids for x in sentencepiece_lattice.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), fold="viterbi").collect()}
    assert time.time() - began < 60
    for i, text in enumerate(texts):
        assert got[i] == best_path(" " + text, table, longest, lowest)
