"""Sets of word shingles of whole texts, as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from stratum.llm.flat import mix, word_hashes, words

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's distinct shingles of ``k`` lower-cased words; of fewer words, their whole sequence; of none, nothing."""
    starts, ends, rows = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    long = np.zeros(0, np.uint64)
    if len(hashes) >= k:
        long = hashes[: len(hashes) - k + 1]
        for j in range(1, k):
            long = mix(long * _STEP + hashes[j : len(hashes) - k + 1 + j])
    out = []
    for a, m in zip(first.tolist(), n.tolist(), strict=True):
        if m >= k:
            out.append(np.unique(long[a : a + m - k + 1]))
        elif m:
            h = np.array([m], np.uint64)
            for x in hashes[a : a + m]:
                h = mix(h * _STEP + x)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
