"""Odd inputs, large groups and plain recomputations of what the operators add up."""

import hashlib
import math
import struct
import weakref
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratum.llm import flat, line_dedup, media, near_duplicates, quality, queries, repeats, tokens, toxicity
from tests.llm.test_operators import brute_components, brute_lines, labelled, prose


def encoded(encoder, texts):
    ids, at = encoder.encode_flat(*flat.flat(pa.array(texts)))
    return [ids[a:b].tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def test_encoder_gives_the_tokenizer_s_ids():
    tokenizer, r = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), np.random.default_rng(3)
    texts = ["".join(chr(c) for c in r.integers(1, 128, r.integers(1, 40))) for _ in range(5000)]
    texts += ["".join(chr(c) for c in r.choice([*range(1, 0x300), 0x3000, 0x4E2D, 0x130, 0x1F600, 0x85, 0xA0], 25)) for _ in range(3000)]
    texts += ["x <|ENDOFTEXT|> y", "x <|endoftext|> y", "a<|endoftext|>b <|EndOfText|>c", "<|startoftext|> z"]
    for order in (texts, texts[::-1]):
        got = encoded(tokens.WordEncoder(), order)
        want = [x.ids for x in tokenizer.encode_batch(order, add_special_tokens=False)]
        assert [t for t, a, b in zip(order, got, want, strict=True) if a != b] == []


def test_words_that_sums_of_powers_cannot_tell_apart():
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    data, offsets = flat.flat(pa.array([a, b]))
    starts, ends, _ = flat.words(data, offsets)
    assert len(set(flat.word_hashes(data, starts, ends).tolist())) == 2
    assert encoded(tokens.WordEncoder(), [a, b, a])[0] != encoded(tokens.WordEncoder(), [b])[0]


@pytest.mark.parametrize("words", [40, 80])
def test_op4_large_group_of_near_copies(spark, words):
    """2,000 variants of one line: with few words most are too far apart, with more all are alike."""
    base, rows = prose(300, words).split(), []
    for i in range(2000):
        w = list(base)
        for j in np.random.default_rng(i).choice(words, 1 + i % 2, replace=False):
            w[j] = f"edit{i}x{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.removed for r in line_dedup.later_lines(df).collect()} == brute_lines(rows)


def test_columns_with_the_operators_own_names(spark):
    a, b = prose(1, 30), prose(2, 90)
    rows = [(i, t, 1, 2, 3, 4, 5, 6, 7, 8.0, 9.0) for i, t in [(1, a), (2, a), (3, b), (4, b + " end"), (5, None), (6, "")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, _base int, _doc int, _removed int, _row int, spans int, t1 int, _spans int, Score double, difference double")
    keep = [c for c in df.columns if c != "text"]
    for out in (line_dedup.remove_later_lines(df), repeats.remove_repeats(df, 400)):
        assert out.columns == df.columns and sorted(map(str, out.select(keep).collect())) == sorted(map(str, df.select(keep).collect()))
    linear = toxicity.score(df, toxicity.LinearModel(np.zeros(1 << toxicity.BITS, np.float32), 0.0))
    assert sorted(linear.columns) == sorted([c for c in df.columns if c != "Score"] + ["score"]) and linear.filter("score = 0.5").count() == 6
    squeezed = quality.score(df, quality.CompressionModel(b"x" * 200, b"y" * 200, 1.0, 0.0))
    assert sorted(squeezed.columns) == sorted([c for c in df.columns if c != "Score"] + ["score"]) and squeezed.filter("difference = 9").count() == 6
    assert near_duplicates.near_duplicates(df).count() == 6
    held = media.media_features(media.with_container(df).withColumn("codec", F.lit("mine")))
    assert held.columns.count("codec") == 1 and held.filter("codec = 'raw '").count() == 6


def test_op8_damaged_containers():
    box = media.mux(b"a" * 192 * 40)
    place = box.index(b"stsz")
    for count in (2**32 - 1, 41, 0):
        assert media.sample_table(box[: place + 12] + struct.pack(">I", count) + box[place + 16 :]) is None
    assert media.sample_table(box[:-1]) is None
    deep = b""
    for _ in range(3000):
        deep = struct.pack(">I4s", 8 + len(deep), b"moov") + deep
    assert media.sample_table(deep) is None and len(list(media.boxes(deep))) == 3000
    place = box.index(b"stsc")
    wide = box[: place + 12] + struct.pack(">III", 1, 2**32 - 1, 1) + box[place + 24 :]  # all samples in the first chunk: they do follow each other
    assert media.read_payload(wide, media.sample_table(wide)) == b"a" * 192 * 40
    assert media.read_payload(box, media.sample_table(box)) == b"a" * 192 * 40


def test_op5_names_and_cuts_passages_of_many_words(spark):
    short = lambda seed, n: " ".join("".join(chr(97 + c) for c in np.random.default_rng(seed * 1000 + i).integers(0, 26, 4)) for i in range(n))
    shared, few = short(1, 55), short(2, 45)
    assert len(shared) < 400 and len(few) > 200
    rows = [(i, f"{short(10 + i, 60)} {shared} {short(30 + i, 60)}") for i in range(3)] + [(10 + i, f"{short(50 + i, 70)} {few} {short(70 + i, 40)}") for i in range(2)] + [(20, short(99, 300)), (21, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x for x in repeats.repeat_spans(df).collect()}
    assert {i: len(x.passages) for i, x in got.items()} == {0: 1, 1: 1, 2: 1, 10: 0, 11: 0, 20: 0, 21: 0} and all(x.n_removed == 0 for x in got.values())
    texts = dict(rows)
    for i in range(3):
        span = got[i].passages[0]
        assert texts[i].encode()[span.start : span.end].decode().strip() == shared
    assert {x.doc_id: x.text for x in repeats.remove_repeats(df).collect()} == texts
    cut = {x.doc_id: x.text for x in repeats.remove_repeats(df, words=50).collect()}
    assert all(shared not in cut[i] and len(cut[i]) >= len(texts[i]) - len(shared) - 2 for i in range(3)) and all(cut[i] == texts[i] for i in (10, 11, 20, 21))


def plain_grams(text):
    """Hashed n-grams of a text, one by one."""
    fold = [c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in (text or "").encode()]
    out, mask = set(), 0xFFFFFFFF
    for n in toxicity.ORDERS:
        for i in range(len(fold) - n + 1):
            h = n * 0x9E3779B1 & mask
            for c in fold[i : i + n]:
                h = (h * 0x01000193 & mask) ^ c
            h = ((h ^ h >> 15) * 0x85EBCA6B & mask) >> (32 - toxicity.BITS)
            out.add(h)
    return out


def test_op2_counts_ratios_and_scores_from_scratch(spark):
    docs, labels = labelled(spark)
    some = docs.filter("doc_id < 50 or doc_id >= 5000")
    rows = {r.doc_id: r.text for r in some.collect()}
    y = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in rows and r.toxic is not None}
    sample = some.join(spark.createDataFrame(list(y.items()), "doc_id long, y int"), "doc_id")
    counts = toxicity._counts(sample, "text")
    seen = [Counter(), Counter()]
    for i, label in y.items():
        seen[label].update(plain_grams(rows[i]))
    assert {r.id: (r.p, r.q) for r in counts.collect()} == {g: (seen[1][g], seen[0][g]) for g in seen[0].keys() | seen[1].keys()}
    n1, n0 = sum(y.values()), len(y) - sum(y.values())
    ids, ratios = toxicity._chosen(counts, n1, n0, 500)
    want = {g: math.log((seen[1][g] + 1) / (n1 + 2)) - math.log((seen[0][g] + 1) / (n0 + 2)) for g in ids.tolist()}
    assert all(abs(want[g] - x) < 1e-9 for g, x in zip(ids.tolist(), ratios.tolist(), strict=True))
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(some, model).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.intercept + sum(float(model.weights[g]) for g in plain_grams(r.text))))), abs=1e-4)


def test_op10_sizes_and_probabilities_from_scratch(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    some = docs.filter("doc_id < 25 or doc_id between 1000 and 1024 or doc_id >= 5000")
    size = lambda d, x: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(x))
    for r in quality.score(some, model).collect():
        raw = (r.text or "").encode()
        blocks = [raw[i : i + quality.BLOCK_BYTES] for i in range(0, len(raw), quality.BLOCK_BYTES)]
        g, b = (sum(size(d, x) for x in blocks) for d in (model.good, model.bad))
        assert r.score == pytest.approx(1 / (1 + math.exp(-((b - g) / max(1, b + g) * model.slope + model.intercept))), abs=1e-9)


def test_ids_beyond_the_range_of_products(spark):
    docs, labels = labelled(spark)
    big = lambda df: df.withColumn("doc_id", F.col("doc_id") + F.lit(1 << 61))
    model = quality.fit(big(docs), big(labels))
    assert quality.score(big(docs), model).count() == docs.count()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels = labelled(spark)
    docs.select("doc_id", "text").union(docs.filter("doc_id in (1, 2)").select("doc_id", "text")).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize(("query", "divisor", "held", "limit"), [(queries.op2_toxicity, 3, 1, 0.7), (queries.op10_quality_classifier, 5, 0, 0.3)])
def test_classifier_queries(spark, folder, query, divisor, held, limit):
    out = query(spark, folder)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = out.collect()
    assert len(rows) == 404
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == held) and r.predicted == int(r.score >= limit) and 0 <= r.score <= 1
    assert len({(r.doc_id, r.score) for r in rows}) == 402


def test_op8_and_op9_queries(spark, folder):
    rows = queries.op8_media_columns(spark, folder).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in rows:
        raw = texts[r.doc_id]
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])) and r.feature.startswith("codec=raw ")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_minhash_near_dedup(spark, folder).collect()}
    assert got == brute_components([(i, t.decode()) for i, t in texts.items()], 3, 85)


def test_a_task_gives_memory_back_when_its_variables_are_gone(monkeypatch):
    """An idle worker stands beside those that work, so that it mustn't keep what its last task held."""
    seen, left = [], []

    @flat.frugal
    def task(batches):
        held = np.zeros(1 << 20)
        left.append(weakref.ref(held))
        yield from batches

    monkeypatch.setattr(flat, "give_back", lambda: seen.append(left[0]() is None))
    assert list(task(iter([1, 2]))) == [1, 2] and seen == [True]


def test_op4_tasks_take_a_bounded_number_of_chunks(spark, monkeypatch):
    """40 chunks go to more tasks than the session's four shuffle partitions."""
    monkeypatch.setattr(line_dedup, "CHUNK_BYTES", 2000)
    rows = [(i, prose(i % 30, 60) + f" number {i}\n" + prose(900 + i % 7, 12)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    chunks = line_dedup._chunks(df.withColumn("_base", F.lit(0)), "text", 5)
    n = chunks.count()
    parts = -(-n // line_dedup.TASK_CHUNKS)
    assert n >= 40 and line_dedup._rarities(chunks.withColumn("later", F.array().cast("array<int>")), 5, 9, parts).rdd.getNumPartitions() == parts
    assert {r.doc_id: r.removed for r in line_dedup.later_lines(df).collect()} == brute_lines(rows)
