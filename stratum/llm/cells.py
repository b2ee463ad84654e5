"""Hashes that chunks tell to buckets: dealt out by their leading bits, sorted, and packed as differences."""

from __future__ import annotations

import numpy as np

#: Bits of a hash that is dealt out.
HASH_BITS = 50


def heads(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    head = np.ones(len(values), bool)
    head[1:] = values[1:] != values[:-1]
    return head


def dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each hash of HASH_BITS by its leading bits, and 32 bits of what follows them; sorted hashes give sorted pairs."""
    half = np.uint64(HASH_BITS // 2)
    mask = np.uint64((1 << HASH_BITS // 2) - 1)
    low = (hashes & mask) * np.uint64(buckets)
    high = (hashes >> half) * np.uint64(buckets) + (low >> half)
    rest = (high & mask) << half | low & mask
    return (high >> half).astype(np.int64), (rest >> np.uint64(HASH_BITS - 32)).astype(np.uint32)


def pack(ascending: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as their differences, of 3 bytes each if those fit."""
    raw = np.diff(ascending, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return raw[:, :3].tobytes() if not raw[:, 3].any() else raw.tobytes()


def unpack(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of :func:`pack`."""
    wide = np.zeros((n, 4), np.uint8)
    wide[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(n, -1)
    return np.cumsum(wide.view("<u4").ravel(), dtype=np.uint32)
