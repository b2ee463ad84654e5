"""Token ids of the lower-casing word tokenizer for batches of whole texts, by way of a bounded cache.

The tokenizer's normaliser (NFC, white space to one space, lower case) and its pre-tokenizer never
look across white space, and white space yields no ids. The ids of a text are therefore the ids of
its words end to end. A batch is cut into words and hashed with numpy; a worker gives the tokenizer
each word that it meets once and gathers the ids of all others from the cache.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from stratum.llm.flat import mix, word_hashes, words

WORD_TOKENIZER = "word_bpe_49k.json"
#: Words that a Python worker remembers (about 40 bytes each) before it starts anew.
CACHE_WORDS = 500_000
#: New words that wait before they are merged into the sorted cache.
RECENT_WORDS = 60_000
#: Below this character, NFC changes nothing and lower case goes character by character.
_PLAIN_BELOW = "İ"
_CASED = np.uint64(0xC2B2AE3D27D4EB4F)
# Fixed value: the pre-tokenizer's pattern, as the tokenizer file has it.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known:
    """Sorted word hashes with their ids' place in the pool."""

    def __init__(self):
        self.keys, self.starts, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def add(self, keys: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        keys, starts, counts = (np.concatenate(x) for x in ((self.keys, keys), (self.starts, starts), (self.counts, counts)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.counts = keys[order], starts[order], counts[order]


class WordEncoder:
    """Encodes batches of texts; holds a worker's cache."""

    def __init__(self, name: str = WORD_TOKENIZER):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.old, self.recent = _Known(), _Known()
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode_whole(self, text: str) -> list[int]:
        """The tokenizer itself."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_word(self, word: str) -> list[int]:
        """As :meth:`encode_whole`; where normalisation changes a word's case alone, without the call's overhead."""
        if max(word) >= _PLAIN_BELOW or len(word) > 255 or "<|" in word or not word.isprintable():
            return self.encode_whole(word)
        word = word.lower()
        if word.isascii():
            pieces = [word] if word.isalpha() else _PIECES.findall(word)
        else:
            pieces = ["".join([self.letters[b] for b in piece.encode()]) for piece in _PIECES.findall(word)]
        return [t.id for piece in pieces for t in self.model.tokenize(piece)]

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self.old.keys) + len(self.recent.keys) > CACHE_WORDS:
            self.forget()
        ids = [self.encode_word(bytes(data[a:b]).decode()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        counts = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.recent.add(keys, self.used + np.cumsum(counts, dtype=np.int64) - counts, counts)
        self.used += len(flat)
        if len(self.recent.keys) > RECENT_WORDS:
            self.old.add(self.recent.keys, self.recent.starts, self.recent.counts)
            self.recent = _Known()

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and where each text's ids start (n + 1 offsets)."""
        starts, ends, rows = words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes = word_hashes(data, starts, ends)
        # The tokenizer knows its special tokens by their case: words that may hold one are told apart by it too.
        marked = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        if len(marked):
            at = np.unique(np.searchsorted(starts, marked, side="right") - 1)
            hashes[at] = mix(word_hashes(data, starts[at], ends[at], lower=False) ^ _CASED)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place, count = np.empty(len(keys), np.int64), np.empty(len(keys), np.int32)
        missing = ~(self.old.find(keys)[1] | self.recent.find(keys)[1])
        if missing.any():
            had = len(self.old.keys) + len(self.recent.keys)
            self._learn(keys[missing], data, starts[first[missing]], ends[first[missing]])
            if len(self.old.keys) + len(self.recent.keys) < had:  # it has forgotten: learn the others again
                rest = ~(self.old.find(keys)[1] | self.recent.find(keys)[1])
                self._learn(keys[rest], data, starts[first[rest]], ends[first[rest]])
        for known in (self.old, self.recent):
            at, hit = known.find(keys)
            place[hit], count[hit] = known.starts[at[hit]], known.counts[at[hit]]
        counts = count[back].astype(np.int64)
        cum = np.cumsum(counts)
        ids = self.pool[np.arange(cum[-1]) + np.repeat(place[back] - (cum - counts), counts)]
        at = np.searchsorted(rows, np.arange(len(offsets)))  # the first word of each text
        return ids, np.concatenate([[0], cum])[at]


def word_encoder(name: str = WORD_TOKENIZER) -> WordEncoder:
    """A task's encoder. It goes with the task: workers are reused, and what they keep adds up."""
    return WordEncoder(name)
