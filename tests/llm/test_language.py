"""Language of texts: the forward sums against plain recursion, learning against a plain version, and held-out accuracy."""

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import language
from stratum.llm.queries import op13_language_id

DATA = "/root/testdata/sf0.001"


def summed(word, probability):
    """The probability of a word by trying every cut, letters without a piece counting as one."""
    pieces = {p: i for i, p in enumerate(language.vocabulary().pieces)}
    text = language.MARK + word

    @lru_cache(None)
    def from_(i):
        if i == len(text):
            return 1.0
        total = 0.0 if text[i] in pieces else probability[-1] * from_(i + 1)
        for end in range(i + 1, min(len(text), i + language.vocabulary().longest) + 1):
            if text[i:end] in pieces:
                total += probability[pieces[text[i:end]]] * from_(end)
        return total

    return from_(0)


def model_of(seed, n=2):
    r = np.random.default_rng(seed)
    size = len(language.vocabulary().pieces) + 1
    lengths = np.array([*map(len, language.vocabulary().pieces), 1])[:, None]
    plain = r.dirichlet(np.full(size, 0.3), n).T.clip(1e-8)
    return plain, language.Model([f"l{i}" for i in range(n)], plain * language._SCALE**lengths, np.zeros(n))


WORDS = ["a", "the", "straße", "señor", "漢字", "x" * 30, "internationalisation", "ααβγ", "q", "éèê", "aβ漢z", "y" * 48]


def test_forward_sums_every_segmentation():
    plain, model = model_of(0)
    words = language.Words(model)
    codes = np.concatenate([[ord(c) for c in w] for w in WORDS]).astype(np.uint32)
    ends = np.cumsum([len(w) for w in WORDS])
    starts = np.concatenate([[0], ends[:-1]])
    for _ in range(2):  # the second time from what is remembered
        got = words.scores(codes, starts, ends, np.arange(len(WORDS)), len(WORDS))
        want = np.log([[summed(w, tuple(plain[:, j])) for j in range(2)] for w in WORDS])
        np.testing.assert_allclose(got, want, rtol=1e-9)
    for w in (*WORDS, "verylongword" * 5, "漢" * 55, "z" * 300):
        one = language.long_word(np.array([ord(c) for c in w], np.uint32), model.table)
        if len(w) <= 60:
            np.testing.assert_allclose(one, np.log([summed(w, tuple(plain[:, j])) for j in range(2)]), rtol=1e-9)
        assert np.isfinite(one).all()
    whole = "ab cd " * 500_000
    cut = list(language._pieces_of(whole))
    assert "".join(cut) == whole and len(cut) > 2 and not any(a[-1].isalpha() and b[0].isalpha() for a, b in zip(cut[:-1], cut[1:], strict=True))
    single = "a" * 2_500_000
    assert list(language._pieces_of(single + " b")) == [single, " b"]


def test_long_words_in_time():
    import time

    _, model = model_of(1)
    codes = np.full(200_000, ord("a"), np.uint32)
    began = time.time()
    assert np.isfinite(language.long_word(codes, model.table)).all() and time.time() - began < 60


def test_one_round_of_learning_is_expected_counts(spark):
    texts = [("en", "the the cat"), ("de", "der Hund"), ("en", "a cat!"), ("de", None), (None, "nobody")]
    docs = spark.createDataFrame([(i, t, x, "s") for i, (x, t) in enumerate(texts)], "doc_id long, text string, lang string, word string")
    model = language.fit(docs, rounds=1)
    pieces = [*language.vocabulary().pieces, None]
    start = 1 / len(pieces)

    def ways(text):
        if not text:
            return [()]
        return [(p, *rest) for k in range(1, len(text) + 1) if (p := text[:k]) in known for rest in ways(text[k:])]

    known = set(pieces[:-1])
    counts = {}
    for lang, text in texts:
        for word in (text or "").lower().replace("!", "").split():
            found = ways("▁" + word)
            weight = [start ** len(w) for w in found]
            for w, x in zip(found, weight, strict=True):
                for p in w:
                    counts.setdefault(lang, Counter())[p] += x / sum(weight)
    scale = language._SCALE ** np.array([*(len(p) for p in pieces[:-1]), 1])
    assert model.languages == ["de", "en"]
    np.testing.assert_allclose(np.exp(model.prior), [1 / 3, 2 / 3])
    for j, lang in enumerate(model.languages):
        seen = np.array([counts[lang][p] for p in pieces]) + language.ADDED
        np.testing.assert_allclose(model.table[:, j] / scale, np.maximum(seen / seen.sum(), language.LEAST), rtol=1e-5)


def test_odd_texts(spark):
    _, model = model_of(2)
    rows = [(1, None), (2, ""), (3, " 12 !?\n"), (4, "the"), (4, "the"), (None, "der"), (5, "ÉTÉ " * 400_000), (6, "a" * 60 + "1" + "b" * 60)]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, language string, score double")
    out = language.predict(docs, model).collect()
    assert len(out) == len(rows) and language.predict(docs.limit(0), model).count() == 0
    for x in out:
        assert (x.lang_pred == "und" and x.score == 0) if x.doc_id in (1, 2, 3) else (x.lang_pred in model.languages and 0.5 <= x.score <= 1)
    none = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(x.lang_pred, x.score) for x in language.predict(docs, none).collect()} == {("und", 0.0)}


@pytest.mark.parametrize("folder", [DATA])
def test_query_is_right_on_held_out_documents(spark, folder):
    out = op13_language_id(spark, folder).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 for x in out)
    held = [x for x in out if x.held_out]
    assert len(held) > 20 and np.mean([x.lang_pred == truth[x.doc_id] for x in held]) > 0.9
