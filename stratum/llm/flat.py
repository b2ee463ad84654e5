"""Arrow batches as flat byte arrays, for vectorised work on whole texts inside Spark tasks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

# Python workers are reused for hours: freed buffers must go back to the system, not into a pool.
pa.set_memory_pool(pa.system_memory_pool())

#: Bytes of text that one numpy step works on; longer texts form a step of their own.
STEP_BYTES = 1_000_000


def give_back() -> None:
    """Hand freed memory back to the system, where its allocator can: the next task may run in another worker beside this one."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task``, which gives its memory back when it has ended and its variables are gone: a worker waits beside others that work."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


def steps(batches: Iterable[pa.RecordBatch], column: str, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part holds about ``step_bytes`` of ``column``, or one row."""
    for batch in batches:
        _, offsets = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + step_bytes, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    give_back()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and where each row starts (n + 1 offsets).

    Null rows are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """Each row's UTF-8 bytes; null rows are empty."""
    data, offsets = flat(column)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64, at least ``n`` of each."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            line = np.full(size, base, np.uint64)
            line[0] = 1
            out.append(np.cumprod(line, dtype=np.uint64))
        have = _POWERS[0] = (out[0], out[1])
    return have


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial sums modulo 2**64: n + 1 values from which any substring's hash follows."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def substring_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end); equal strings have equal hashes, wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes without ASCII white space, and the row that it stands in."""
    return runs(~SPACE[data], offsets)


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of members, and the row that it stands in."""
    data, inside = member, np.zeros(len(member) + 2, bool)
    inside[1:-1] = member
    change = inside[1:] != inside[:-1]
    starts, ends = np.flatnonzero(change & inside[1:]), np.flatnonzero(change & ~inside[1:])
    # A word never runs across a row's end: cut those that do.
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data)) & (cuts != offsets[:-2])]
    if len(cuts):
        cuts = cuts[inside[cuts] & inside[cuts + 1]]
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return starts, ends, rows


#: Longer words are hashed by xxhash: sums modulo 2**64 can't tell some strings of 1,024 bytes and more apart.
LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of the words, with A-Z lower-cased if ``lower``; byte by byte over all words that are so long, so in memory of the words' number."""
    folded = _LOWER[data] if lower else np.ascontiguousarray(data)
    size = ends - starts
    order = np.argsort(np.minimum(size, LONG_WORD + 1).astype(np.int16), kind="stable")[::-1]
    at, out = starts[order].copy(), np.zeros(len(starts), np.uint64)
    longer = np.cumsum(np.bincount(np.minimum(size, LONG_WORD), minlength=LONG_WORD + 1)[::-1])[::-1]  # words of so many bytes or more
    for j in range(1, LONG_WORD + 1):
        k = int(longer[j])
        if not k:
            break
        part = out[:k]
        part *= np.uint64(_BASE)
        part += folded[at[:k]]
        part += np.uint64(1)
        at[:k] += 1
    hashes = np.empty(len(starts), np.uint64)
    hashes[order] = mix(out + size[order].astype(np.uint64))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(folded[starts[i] : ends[i]])
    return hashes
