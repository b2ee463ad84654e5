"""Language of texts: unigrams over pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is
the sum over all ways to cut it into pieces, which a forward pass over its letters adds up; a text's
is the product over its words. The probabilities are learned by expectation maximisation: a forward
and a backward pass give how often each piece is expected in the words of a language, and Spark adds
that up over a table of distinct words and their counts.

Words are runs of letters of the lower-cased text, with the vocabulary's word mark before them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.flat import prefix_hash, runs, steps, substring_hash
from stratum.llm.shared import bounded_batches, written
from stratum.llm.tables import free_name

MODEL, MARK = "piece_bpe_32k.model", "▁"
#: Documents of each language that are learned from (in the mean), rounds, and what is added to each piece's count.
PER_LANGUAGE, ROUNDS, ADDED = 2_000, 3, 0.05
#: Letters of a word whose lattice is made beside others'; longer ones go letter by letter and aren't learned from.
LONG_WORD = 48
#: No piece is less probable; a letter that no piece has counts as one more piece.
LEAST = 1e-8
#: What each letter's probability is multiplied by, so that products over a word stay within doubles.
_SCALE = 1000.0
#: Words that a task remembers, and characters that one step works on.
CACHE_WORDS, STEP_CHARS = 200_000, 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Vocabulary:
    """Hashes of all beginnings of pieces in ascending order, and the number of the piece that each is (-1: of none)."""

    pieces: list[str]
    keys: np.ndarray
    numbers: np.ndarray

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)


@lru_cache(maxsize=2)
def vocabulary(model: str = MODEL) -> Vocabulary:
    """The pieces that words can hold: letters without upper case, after a mark or not."""
    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    found = [x for i in range(p.get_piece_size()) if (x := p.id_to_piece(i)) and (x == MARK or x.removeprefix(MARK).isalpha()) and x.lower() == x]
    number = {x: i for i, x in enumerate(found)}
    begins = sorted({x[:k] for x in found for k in range(1, len(x) + 1)})
    keys = np.array([_hash(x) for x in begins], np.uint64)
    order = np.argsort(keys)
    return Vocabulary(found, keys[order], np.array([number.get(x, -1) for x in begins], np.int32)[order])


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass
class Lattice:
    """The edges of many words, in groups; no two edges of a group end or begin at the same place."""

    size: int
    first: np.ndarray
    last: np.ndarray
    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    groups: np.ndarray

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """For each place, the summed products of the edges' weights over all ways from its word's beginning."""
        out = np.zeros((self.size, *weight.shape[1:]))
        out[self.first] = 1
        for a, b in zip(self.groups[:-1].tolist(), self.groups[1:].tolist(), strict=True):
            out[self.target[a:b]] += out[self.source[a:b]] * weight[a:b]
        return out

    def backward(self, weight: np.ndarray) -> np.ndarray:
        """For each place, the same over all ways to its word's end."""
        out = np.zeros((self.size, *weight.shape[1:]))
        out[self.last] = 1
        for a, b in zip(self.groups[-2::-1].tolist(), self.groups[:0:-1].tolist(), strict=True):
            out[self.source[a:b]] += out[self.target[a:b]] * weight[a:b]
        return out


def lattice(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocab: Vocabulary) -> Lattice:
    """All pieces that the words codes[start:end] hold; a letter that is no piece is an edge of number ``len(pieces)``."""
    size = ends - starts + 1  # with the mark
    base = np.cumsum(size + 1) - size - 1  # a word of n characters has n + 1 places
    inner = np.cumsum(size) - size
    flat = np.full(int(size.sum()), ord(MARK), np.uint64)
    within = np.arange(len(flat)) - np.repeat(inner, size)
    flat[within > 0] = codes[(np.repeat(starts - 1, size) + within)[within > 0]]
    place, left = np.repeat(base, size) + within, np.repeat(size, size) - within
    alive, h = np.arange(len(flat)), np.zeros(len(flat), np.uint64)
    source, target, piece, order = [], [], [], []
    for k in range(1, vocab.longest + 1):
        keep = left[alive] >= k
        alive, h = alive[keep], h[keep]
        if not len(alive):
            break
        h = h * _BASE + flat[alive + (k - 1)] + np.uint64(1)
        at = np.minimum(np.searchsorted(vocab.keys, h), len(vocab.keys) - 1)
        known = vocab.keys[at] == h
        number = np.where(known, vocab.numbers[at], -1)
        edge = number >= 0
        if k == 1:  # a letter by itself is always an edge
            number, edge = np.where(edge, number, len(vocab.pieces)), np.ones(len(number), bool)
        source.append(place[alive[edge]])
        target.append(place[alive[edge]] + k)
        piece.append(number[edge])
        order.append(((within[alive[edge]] + k) * (vocab.longest + 1) + k).astype(np.uint16))
        alive, h = alive[known], h[known]
    if not source:
        none = np.zeros(0, np.int64)
        return Lattice(0, none, none, none, none, none, np.zeros(1, np.int64))
    key = np.concatenate(order)
    by = np.argsort(key, kind="stable")
    key = key[by]
    groups = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    return Lattice(int((size + 1).sum()), base, base + size, *(np.concatenate(x)[by] for x in (source, target, piece)), groups)


@lru_cache(maxsize=2)
def _numbers(model: str = MODEL) -> dict[int, int]:
    return dict(zip(vocabulary(model).keys.tolist(), vocabulary(model).numbers.tolist(), strict=True))


def long_word(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The log probability of one word by each language, place by place with the last few places held."""
    if not table.shape[1]:
        return np.zeros(0)
    number, longest, unknown = _numbers(), vocabulary().longest, table[-1]
    chars = [ord(MARK), *codes.tolist()]
    held, total = [np.ones(table.shape[1])], np.zeros(table.shape[1])
    coming: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]  # (length, piece) of the edges that end so many places on
    for i in range(len(chars)):
        h, single = 0, True
        for k in range(1, min(longest, len(chars) - i) + 1):
            h = (h * int(_BASE) + chars[i + k - 1] + 1) & 0xFFFFFFFFFFFFFFFF
            n = number.get(h)
            if n is None:
                break
            if n >= 0:
                coming[k].append((k, n))
                single = single and k > 1
        coming.append([])
        coming.pop(0)
        now = sum((held[-k] * table[n] for k, n in coming[0]), np.zeros(table.shape[1])) if coming[0] else np.zeros(table.shape[1])
        if single:
            now = now + held[-1] * unknown
        held = [*held, now][-longest:]
        by = np.maximum(now, 1e-300)
        if by.max() > 1e50 or by.min() < 1e-50:
            total, held = total + np.log(by), [x / by for x in held]
    return total + np.log(np.maximum(held[-1], 1e-300)) - len(chars) * np.log(_SCALE)


@dataclass
class Model:
    """Languages in ascending order, the probabilities of pieces (rows; the last is a letter without one) by language, scaled by _SCALE a letter, and the log shares of the languages."""

    languages: list[str]
    table: np.ndarray
    prior: np.ndarray


class Words:
    """Log probabilities of words; remembers those of many."""

    def __init__(self, model: Model):
        self.model, self.vocab = model, vocabulary()
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)))

    def _new(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts), len(self.model.languages)))
        short = ends - starts <= LONG_WORD
        g = lattice(codes, starts[short], ends[short], self.vocab)
        if g.size:
            out[short] = np.log(g.forward(self.model.table[g.piece])[g.last]) - (ends - starts + 1)[short, None] * np.log(_SCALE)
        for i in np.flatnonzero(~short).tolist():
            out[i] = long_word(codes[starts[i] : ends[i]], self.model.table)
        return out

    def scores(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Summed log probabilities of the words of each of ``n`` rows."""
        sums = prefix_hash(codes)
        keys, first, back = np.unique(substring_hash(sums, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        value = np.empty((len(keys), len(self.model.languages)))
        value[hit] = self.values[at[hit]]
        value[~hit] = self._new(codes, starts[first[~hit]], ends[first[~hit]])
        if len(self.keys) + (~hit).sum() > CACHE_WORDS:
            self.keys, self.values = keys, value
        else:
            where = np.searchsorted(self.keys, keys[~hit])
            self.keys, self.values = np.insert(self.keys, where, keys[~hit]), np.insert(self.values, where, value[~hit], 0)
        return np.stack([np.bincount(rows, value[back, j], n) for j in range(value.shape[1])], 1) if value.shape[1] else np.zeros((n, 0))


def _pieces_of(text: str) -> Iterator[str]:
    """A long text cut after characters that aren't letters, in parts of about STEP_CHARS."""
    at = 0
    while len(text) - at > STEP_CHARS:
        end = at + STEP_CHARS
        while end > at and text[end - 1].isalpha():
            end -= 1
        if end == at:  # one word, whole
            end = at + STEP_CHARS
            while end < len(text) and text[end].isalpha():
                end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, start and end of every run of letters, and its text's place."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, *runs(letters()[codes], np.cumsum([0, *map(len, low)]))


def _sums(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Summed log probabilities of each text, and whether it has a letter."""
    out, any_word = np.zeros((len(texts), len(words.model.languages))), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        if text and len(text) > STEP_CHARS:
            for part in _pieces_of(text):
                codes, starts, ends, rows = _words([part])
                if len(starts):
                    out[i] += words.scores(codes, starts, ends, rows, 1)[0]
                    any_word[i] = True
    rest = [t if t and len(t) <= STEP_CHARS else "" for t in texts]
    codes, starts, ends, rows = _words(rest)
    if len(starts):
        out += words.scores(codes, starts, ends, rows, len(texts))
        any_word[np.unique(rows)] = True
    return out, any_word


def _word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n of the words that are learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            langs = np.asarray(part.column("lang").to_pylist(), object)
            codes, starts, ends, rows = _words([t or "" for t in part.column("text").to_pylist()])
            fit = ends - starts <= LONG_WORD
            starts, ends, rows = starts[fit], ends[fit], rows[fit]
            number, own = np.unique(langs, return_inverse=True)
            keys = substring_hash(prefix_hash(codes), starts, ends) * np.uint64(len(number) + 1) + own[rows].astype(np.uint64)
            _, first, n = np.unique(keys, return_index=True, return_counts=True)
            words = [codes[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(langs[rows[first]].tolist(), pa.string()), pa.array(words, pa.string()), pa.array(n)], ["lang", "word", "n"])

    return docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Learn from ``docs`` (rows that may be learned from; null languages and texts are left out).

    Of a language with more than ``per_language`` rows a hash of the id and the text picks as many in
    the mean; whole texts are read. What comes to the driver is a number for each piece and language.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    usable = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("id")).filter("lang is not null and text is not null")
    shares = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # as many rows as languages
    languages = sorted(shares)
    vocab, n_pieces = vocabulary(), len(vocabulary().pieces) + 1
    if not languages:
        return Model([], np.zeros((n_pieces, 0)), np.zeros(0))
    prior = np.log([shares[x] for x in languages]) - np.log(sum(shares.values()))
    part = spark.createDataFrame([(x, per_language / shares[x]) for x in languages], "lang string, share double")
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    counts = written(_word_counts(usable.join(F.broadcast(part), "lang").filter(place < F.col("share"))))
    number = {x: i for i, x in enumerate(languages)}
    lengths = np.array([*(len(x) for x in vocab.pieces), 1])[:, None]
    table = np.full((n_pieces, len(languages)), 1 / n_pieces)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(table * _SCALE**lengths)

        def expected(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table = sent.value
            total = np.zeros(table.size)
            for batch in batches:
                for a in range(0, batch.num_rows, 20_000):
                    rows = batch.slice(a, 20_000)
                    words = rows.column("word").to_pylist()
                    own = np.array([number[x] for x in rows.column("lang").to_pylist()], np.int64)
                    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
                    ends = np.cumsum([len(w) for w in words])
                    g = lattice(codes, np.concatenate([[0], ends[:-1]]), ends, vocabulary())
                    word = np.searchsorted(g.first, g.source, side="right") - 1
                    cell = g.piece * table.shape[1] + own[word]
                    weight = table.ravel()[cell]
                    ahead, behind = g.forward(weight), g.backward(weight)
                    share = ahead[g.source] * weight * behind[g.target] / ahead[g.last][word]
                    total += np.bincount(cell, share * rows.column("n").to_numpy()[word], len(total))
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["cell", "n"])

        # Added up in the order of the cells' parts: the same input gives the same model.
        sums = counts.mapInArrow(expected, "cell long, n double").groupBy("cell").agg(F.sum(F.col("n").cast("decimal(38,9)")).alias("n")).toPandas()
        seen = np.zeros(table.size)
        seen[sums["cell"].to_numpy()] = sums["n"].astype(float).to_numpy()
        seen = seen.reshape(table.shape) + ADDED
        table = np.maximum(seen / seen.sum(0), LEAST)
    return Model(languages, table * _SCALE**lengths, prior)


def predict(docs: DataFrame, model: Model, text: str = "text", name: str = "lang_pred", score: str = "score", none: str = "und") -> DataFrame:
    """``docs`` with the likeliest language of each whole text (the first in order of equals) and its probability, in place of columns of these names.

    A null text or one without letters has ``none`` and the score 0, and so has every text where the
    model has no languages.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*(c for c in docs.columns if c.lower() in (name.lower(), score.lower())))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    first, second = free_name(docs, "language"), free_name(docs, "probability")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(sent.value)
        languages = [*sent.value.languages, none]
        for part in steps(batches, text):
            sums, able = _sums(part.column(text).to_pylist(), words)
            if not sent.value.languages:
                best, p = np.full(len(sums), -1), np.zeros(len(sums))
            else:
                sums = sums + sent.value.prior
                best = np.where(able, sums.argmax(1), -1)
                p = np.where(able, 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1), 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([languages[i] for i in best.tolist()], pa.string()), pa.array(p)], [*part.schema.names, first, second])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{first}` string, `{second}` double").withColumnsRenamed({first: name, second: score})
