"""The ten operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratum.llm import flat, line_dedup, media, near_duplicates, packing, quality, repeats, token_counts, topk, toxicity
from stratum.llm.shared import new_folder

SCHEMA = "doc_id long, text string, lang string, chunk int, bin string, token string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(f"{WORDS[a]}{b}" for a, b in zip(r.integers(0, 12, n), r.integers(0, 900, n), strict=True))


@pytest.fixture(scope="module")
def texts():
    base, other, shared = prose(1, 120), prose(2, 300), prose(3, 90)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, other), (5, None), (6, ""), (7, "  \n\t "), (8, "one"), (9, "ONE"), (10, "two words"),
        (11, prose(4, 80) + "\n" + shared + "\n" + prose(5, 40)), (12, prose(6, 70) + "\n" + shared + "\nÄöü ß é 漢字"), (13, shared + " " + shared),
        (14, "x" * 3000), (15, prose(7, 5000)), (16, "Don't <|endoftext|> it's 12.5 ²"),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1, "b", "t") for i, t in texts], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids


def test_op1_top_k_with_ties_and_odd_vectors(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, 8)], "x") for i in range(120)]
    rows[7] = (7, rows[3][1], "x")  # a tie
    rows += [(200, None, "x"), (201, [float("nan")] * 8, "x"), (202, [float("inf")] + [0.0] * 7, "x"), (203, [], "x"), (250, [0.5, None] + [0.0] * 6, "x")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string")
    got = {}
    for x in topk.top_k(v, v.filter("vec_id % 50 = 0")).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    q = {i: np.floor(256 * np.array(e, np.float32).astype(float)).astype(int) for i, e, _ in rows if e is not None and None not in e and np.isfinite(e).all()}
    q[203] = np.zeros(8, int)
    for a in (0, 50, 100):
        best = sorted(((int(q[a] @ q[b]), b) for b in q if b != a), key=lambda p: (-p[0], p[1]))[:5]
        assert sorted(got[a]) == [(k + 1, b, s) for k, (s, b) in enumerate(best)]
    assert set(got) == {0, 50, 100}
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_op1_stops_early_only_with_proof():
    r = np.random.default_rng(1)
    m = (r.normal(0, 60, (3000, 16)) * (r.random((3000, 1)) * 3)).astype(np.int64)
    values = m.ravel()
    level = np.abs(values) * topk.LEVELS // (np.abs(values).max() + 1)
    postings, ends = np.argsort(-level, kind="stable"), np.cumsum(np.bincount(level, minlength=topk.LEVELS)[::-1])
    for q, rows in zip(m[:20], topk.possible_members(m, postings, ends, m[:20], 5), strict=True):
        s = m @ q
        assert set(np.flatnonzero(s >= np.sort(s)[-5])) <= set(rows)


def test_op1_stop_fires_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(topk.quantise("embedding").alias("v")).filter("v is not null").collect()
    m = np.array([r.v for r in table], np.int64)
    postings, ends = topk.impact_order(m.ravel())
    assert len(ends) == 3 and ends[-1] == m.size
    found = topk.possible_members(m, postings, ends, m[:50], 6)
    assert max(map(len, found)) <= topk.POSSIBLE * 6
    # The proof is there before the last segment: without it, the same rows are possible.
    early = topk.possible_members(m, postings, np.array([ends[0], ends[1], m.size - 1]), m[:50], 6)
    assert all((a == b).all() for a, b in zip(found, early, strict=True))
    for q, rows in zip(m[:50], found, strict=True):
        s = m @ q
        assert set(np.flatnonzero(s >= np.sort(s)[-6])) <= set(rows)


def test_op1_repeated_and_null_ids(spark):
    r = np.random.default_rng(4)
    rows = [(i if i % 9 else None, [float(x) for x in r.normal(0, 0.3, 6)], "x") for i in range(60)] + [(50, [0.2] * 6, "x"), (7, [9.0] * 6, "x"), (7, [9.0] * 6, "x")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    q = [(i, np.floor(256 * np.array(e, np.float32).astype(float)).astype(int)) for i, e, _ in rows if i is not None]
    got = sorted((x.query_id, x.vec_id, x.score) for x in topk.top_k(v, v.filter("vec_id = 50").limit(1)).collect())
    first = next(e for i, e in q if i == 50)
    # Which of the rows of one id is the query is open where there are several: either way its own rows are no candidates.
    ways = [sorted((50, i, s) for s, i in sorted(((int(e @ w), i) for i, e in q if i != 50), key=lambda x: (-x[0], x[1]))[:5]) for w in (first, q[-3][1])]
    assert got in ways


def labelled(spark):
    rows = [(i, prose(i, 40) + (" you idiot loser" if i % 3 == 0 else " fine day")) for i in range(300)]
    junk = [(1000 + i, "$$$ !!! ### " * 20 + prose(i, 3)) for i in range(100)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows + junk] + [(5000, "", "x"), (5001, None, "x")], "doc_id long, text string, score2 string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i, _ in rows] + [(i, 0, 0) for i, _ in junk] + [(7, None, None), (99999, 1, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    return docs, labels


def test_op2_and_op10_learn_held_out_rows(spark):
    docs, labels = labelled(spark)
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        model = module.fit(docs, labels.filter("doc_id % 4 <> 0 or doc_id is null"), label)
        out = {r.doc_id: r.score for r in module.score(docs, model).collect()}
        assert len(out) == 402 and all(0 <= s <= 1 for s in out.values())
        test = [(r.doc_id, r[label]) for r in labels.collect() if r.doc_id is not None and r[label] is not None and r.doc_id % 4 == 0 and r.doc_id < 5000]
        assert np.mean([(out[i] >= 0.5) == y for i, y in test]) > 0.95
        one_class = module.fit(docs, labels.filter(f"{label} = 1"), label)
        assert module.score(docs, one_class).agg(F.min("score")).first()[0] > 0.9
        assert module.score(docs, module.fit(docs, labels.limit(0), label)).agg(F.max("score")).first()[0] == pytest.approx(0.5)


def test_op2_capped_and_whole_fits_give_like_scores(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(6000):
        toxic = int(i % 20 == 0)
        mark = r.random() < (0.7 if toxic else 0.1)
        rows.append((i, toxic, " ".join([*r.choice(WORDS, 4), *(["idiot"] if mark else [])])))
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y, _ in rows], "doc_id long, toxic int")
    whole, capped, both = ([x.score for x in toxicity.score(docs, toxicity.fit(docs, labels, per_class=n, features=200)).orderBy("doc_id").collect()] for n in (10_000, 300, 200))
    logit = lambda p: np.log(np.array(p) / (1 - np.array(p)))
    for other in (capped, both):
        assert abs((logit(other) - logit(whole)).mean()) < 0.5
        assert abs(np.mean(other) - 0.05) < 0.02


def test_op3_counts_across_blocks(spark, docs, texts, empty):
    got = {r.doc_id: (r.n_tokens, r.n_end_ids) for r in token_counts.token_counts(docs, new_folder(spark, "t")).collect()}
    assert got == {i: (len(ids_of(t)), ids_of(t).count(token_counts.SPELLED_ID)) for i, t in texts} and sum(n for _, n in got.values()) > 0
    folder = new_folder(spark, "t")
    names = token_counts.write_token_files(docs, folder)
    files = names.select("file").distinct().join(token_counts.token_files(spark, folder), "file")
    scan = lambda size: sorted(map(tuple, token_counts.separator_scan(files, folder, block_bytes=size).select("file", "ordinal", "start", "n_tokens").collect()))
    assert scan(64) == scan(1 << 20) and len(scan(64)) == len(texts)
    assert token_counts.token_counts(empty, new_folder(spark, "t")).count() == 0


def line_sets(texts):
    for i, t in sorted(texts, key=lambda x: x[0]):
        for k, line in enumerate(t.split("\n") if t is not None else []):
            w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in re.split(r"[\x20\x09-\x0d]+", line) if x]
            yield i, k, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def brute_lines(texts):
    seen, gone = [], {}
    for i, k, s in line_sets(texts):
        if s and any(100 * len(s & x) >= 80 * len(s | x) for x in seen):
            gone.setdefault(i, []).append(k)
        seen.append(s) if s else None
    return gone


def test_op4_lines_against_brute_force(spark, docs, texts, empty):
    assert {r.doc_id: r.removed for r in line_dedup.later_lines(docs).collect()} == brute_lines(texts)
    family = []
    for i in range(60):  # a large group: variants of one line, and a passage inside many different lines
        w = prose(50, 60).split()
        for j in np.random.default_rng(i).choice(60, i % 7, replace=False):
            w[j] = f"edit{i}x{j}"
        family.append((i + 1, " ".join(w) + "\n" + prose(100 + i, 30) + " " + prose(51, 25)))
    df = spark.createDataFrame(family, "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.later_lines(df).collect()} == brute_lines(family)
    out = line_dedup.remove_later_lines(docs)
    assert out.columns == docs.columns and out.count() == len(texts)
    assert line_dedup.line_report(empty).count() == 0 and line_dedup.remove_later_lines(empty).count() == 0


def test_op4_rows_that_share_a_doc_id(spark):
    a, b, c, d = (prose(200 + i, 30) for i in range(4))
    rows = [(1, a + "\n" + b), (1, a + "\n" + b), (2, c), (2, a + "\n" + d), (3, b), (3, b), (4, d + "\n" + c), (5, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sorted(map(tuple, line_dedup.remove_later_lines(df).collect()))
    assert out == sorted([rows[0], rows[1], (2, c), (2, d), (3, ""), (3, ""), (4, ""), (5, "")])
    report = sorted((r.doc_id, r.n_lines, r.n_removed, r.removed) for r in line_dedup.line_report(df).collect())
    assert report == [(1, 2, 0, []), (1, 2, 0, []), (2, 1, 0, []), (2, 2, 1, [0]), (3, 1, 1, [0]), (3, 1, 1, [0]), (4, 2, 2, [0, 1]), (5, 1, 1, [0])]


def brute_repeats(texts, n=400):
    raw = {i: (t or "").encode() for i, t in texts}
    count = {}
    for b in raw.values():
        for p in range(len(b) - n + 1):
            count[b[p : p + n]] = count.get(b[p : p + n], 0) + 1
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_op5_repeats_against_brute_force(docs, texts, empty):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeat_spans(docs).collect()}
    assert got == brute_repeats(texts)
    out = {r.doc_id: r.text for r in repeats.remove_repeats(docs).collect()}
    assert out[1] == "" and out[4] == dict(texts)[4] and out[5] is None
    assert repeats.repeat_spans(empty).count() == 0 and repeats.remove_repeats(empty).count() == 0


def test_op5_null_doc_ids_take_part(spark):
    shared = prose(70, 120)
    rows = [(None, prose(71, 50) + shared), (1, prose(72, 60) + shared), (None, prose(73, 90))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: x for i, x in brute_repeats(list(enumerate(t for _, t in rows))).items()}
    assert want[0][1] >= 400 and want[1][1] >= 400
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeat_spans(df).collect())
    assert got == sorted(want.values())


@pytest.mark.parametrize("group", [50_000, 4])
def test_op6_packs_every_piece_once(docs, texts, empty, group):
    rows = packing.pack(docs, group_bins=group).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in texts:
        ids = [*ids_of(t), 0]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 2048))
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own]
        assert sum(r.length for r in own) == len(ids)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty).count() == 0


def test_best_fit_is_close_to_the_bound():
    n = np.random.default_rng(0).integers(1, 1400, 3000)
    bins, at, fills = packing.best_fit(n, 2048)
    assert fills.max() <= 2048 and fills.sum() == n.sum() and len(fills) <= 1.02 * n.sum() / 2048


def test_op8_containers_round_trip(docs, texts, empty):
    rows = {r.doc_id: r for r in media.media_features(media.with_container(docs)).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.codec == "raw " and r.n_samples == len(payload) // 192 and len(r.keyframes) == -(-r.n_samples // media.KEY_EVERY)
    assert rows[1].media_sha256 == rows[2].media_sha256
    assert media.media_features(media.with_container(empty)).count() == 0
    box = media.mux(b"a" * 192)
    for cut in (b"", box[:40], b"\0" * 64, box[:-200]):
        assert media.sample_table(cut) is None or media.read_payload(cut, media.sample_table(cut)) != b"a" * 192


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.split(r"[\x20\x09-\x0d]+", t or "") if x]
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = sorted((label[a], label[b]), reverse=True)
                label = {i: new if x == old else x for i, x in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_op9_components_against_brute_force(spark, docs, texts, empty, shingle, percent):
    family = [(100 + i, " ".join(f"edit{i}" if j in np.random.default_rng(i).choice(200, i % 9, replace=False) else w for j, w in enumerate(prose(80, 200).split()))) for i in range(60)]
    df = docs.union(spark.createDataFrame([(i, t, "en", 1, "b", "t") for i, t in family], SCHEMA))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df, shingle, percent).collect()}
    assert got == brute_components(texts + family, shingle, percent)
    assert near_duplicates.near_duplicates(empty, shingle, percent).count() == 0


def test_bayesian_bounds_never_drop_what_can_reach_the_threshold():
    same = np.zeros((4, near_duplicates.HASHES), np.uint8)
    other = np.ones((4, near_duplicates.HASHES), np.uint8)
    other[0] = 0
    other[1, : int(0.86 * near_duplicates.HASHES)] = 0
    rng = np.random.default_rng(0)
    other = other[:, rng.permutation(near_duplicates.HASHES)]
    assert set(near_duplicates.surviving(same, other, 85)[0]) == {0, 1}


@pytest.mark.parametrize("percent", [80, 85])
def test_op9_all_batches_together_keep_the_miss_probability(percent):
    rate = percent / 100 + (1 - percent / 100) / 256
    alive, done, dropped = np.ones(1), 0, 0.0
    for n, least in near_duplicates.fewest_matches(percent):
        for _ in range(n - done):
            alive = np.append(alive * (1 - rate), 0) + np.append(0, alive * rate)
        dropped += alive[:least].sum()
        alive[:least] = 0
        done = n
    assert 0 < dropped <= near_duplicates.MISS


def test_words_stop_at_row_ends():
    import pyarrow as pa

    data, offsets = flat.flat(pa.array(["ab", "cd ef", None, "", " g"]))
    starts, ends, rows = flat.words(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"ef", b"g"] and rows.tolist() == [0, 1, 1, 4]
