"""Media columns: ISO base media containers written and read with numpy and struct, payload undecoded.

:func:`mux` stores a binary payload as 8-bit samples of a sound track in a container;
:func:`demux` walks a container's nested boxes, decodes the sample tables and gives codec, duration
and the byte range of every keyframe (sync sample), without decoding any payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.flat import steps, texts_as_bytes

#: Bytes of a sample, samples of a chunk and between keyframes, and samples a second.
SAMPLE_BYTES, CHUNK_SAMPLES, KEY_EVERY, RATE = 192, 16, 8, 250
# The box types whose payload is boxes, from the container format's definition.
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes) -> bytes:
    """A container whose only track holds ``payload`` as 8-bit samples; the length is a positive multiple of SAMPLE_BYTES."""
    if not payload or len(payload) % SAMPLE_BYTES:
        raise ValueError("the payload's length is not a positive multiple of the sample size")
    n = len(payload) // SAMPLE_BYTES
    full, last = divmod(n, CHUNK_SAMPLES)
    chunks = full + bool(last)
    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = _box(b"raw ", bytes(6), struct.pack(">HQHHHHI", 1, 0, 1, 8, 0, 0, 8000 << 16))
    runs = [(1, CHUNK_SAMPLES, 1)] * bool(full) + [(full + 1, last, 1)] * bool(last)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (CHUNK_SAMPLES * SAMPLE_BYTES)
        places = _full(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes()) if first + len(payload) < 1 << 32 else _full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes())
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *x) for x in runs)),
            _full(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)),
            places,
        )
        data = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        media = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", struct.pack(">I4s", 0, b"soun"), bytes(12), b"\0"), _box(b"minf", _full(b"smhd", bytes(4)), data, table))
        track = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=7)
        movie = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", movie, _box(b"trak", track, media))

    head = len(kind) + len(moov(0)) + 8
    return kind + moov(head) + struct.pack(">I4s", 8 + len(payload), b"mdat") + payload


def boxes(media: bytes) -> Iterator[tuple[bytes, int, int]]:
    """Every box, outer ones before those within: type, payload start and payload end."""
    open_: list[tuple[int, int]] = [(0, len(media))]
    while open_:
        start, end = open_.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", media, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                continue
            size, head = struct.unpack_from(">Q", media, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            continue  # a cut or damaged box ends the walk of what holds it
        yield kind, start + head, start + size
        open_.append((start + size, end))
        if kind in _NESTED:
            open_.append((start + head, start + size))


def _table(media: bytes, start: int, dtype: str, width: int = 1, skip: int = 4) -> np.ndarray:
    n = struct.unpack_from(">I", media, start + skip)[0]
    return np.frombuffer(media, dtype, n * width, start + skip + 4).astype(np.int64).reshape(-1, width)


def sample_table(media: bytes) -> dict | None:
    """Codec, time scale, duration, and each sample's offset, size and sync mark.

    None if there is no readable track: no tables, tables that contradict each other, or samples beyond the end.
    """
    at: dict[bytes, tuple[int, int]] = {}
    for kind, a, b in boxes(media):
        if kind == b"trak" and b"trak" in at:
            break  # the first track
        at.setdefault(kind, (a, b))
    if not {b"mdhd", b"stsd", b"stts", b"stsc", b"stsz"} <= at.keys() or not at.keys() & {b"stco", b"co64"}:
        return None
    try:
        place = at[b"mdhd"][0]
        scale, duration = struct.unpack_from(">IQ", media, place + 20) if media[place] else struct.unpack_from(">II", media, place + 12)
        size, n = struct.unpack_from(">II", media, at[b"stsz"][0] + 4)
        if size * n > len(media):
            return None
        sizes = np.full(n, size, np.int64) if size else _table(media, at[b"stsz"][0], ">u4", skip=8)[:, 0]
        chunk_at = (_table(media, at[b"stco"][0], ">u4") if b"stco" in at else _table(media, at[b"co64"][0], ">u8"))[:, 0]
        runs = _table(media, at[b"stsc"][0], ">u4", 3)
        run_of = np.searchsorted(runs[:, 0], np.arange(1, len(chunk_at) + 1), side="right") - 1
        ends = np.cumsum(np.where(run_of >= 0, runs[run_of, 1], 0))
        chunk = np.searchsorted(ends, np.arange(n), side="right")
        before = np.cumsum(sizes) - sizes
        first = np.append(0, ends)[chunk]
        offsets = chunk_at[chunk] + before - before[first]
        keys = _table(media, at[b"stss"][0], ">u4")[:, 0] - 1 if b"stss" in at else np.arange(n)
        if not n or offsets.min() < 0 or (offsets + sizes).max() > len(media) or (len(keys) and (keys.min() < 0 or keys.max() >= n)):
            return None
        codec = struct.unpack_from(">4s", media, at[b"stsd"][0] + 12)[0].decode("latin-1")
    except (struct.error, ValueError, IndexError):
        return None
    return {"codec": codec, "scale": scale, "duration": duration, "offsets": offsets, "sizes": sizes, "keys": keys}


def read_payload(media: bytes, table: dict) -> bytes:
    """The stored bytes of all samples; neighbouring samples are read together."""
    offsets, sizes = table["offsets"], table["sizes"]
    ends = offsets + sizes
    cuts = np.flatnonzero(offsets[1:] != ends[:-1]) + 1
    starts, stops = offsets[np.concatenate([[0], cuts]).astype(int)], ends[np.concatenate([cuts - 1, [len(ends) - 1]]).astype(int)]
    return b"".join(media[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True))


def with_container(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8 bytes, filled up with spaces, in a container.

    A null text is empty; an empty text is one sample of spaces. Repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            raw = texts_as_bytes(part.column(text))
            media = [mux(x + b" " * (-len(x) % SAMPLE_BYTES if x else SAMPLE_BYTES)) for x in raw]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(table: DataFrame, media: str = "media") -> DataFrame:
    """Replace a container column by what its boxes and sample tables tell, in columns of their own.

    codec, time_scale, duration, n_samples, keyframes (array of start and end bytes in the container),
    media_bytes, media_sha256, payload_bytes, payload_sha256 and tail_crc32 (of the payload's last 16
    bytes). Where there is no readable track (null, empty or damaged), codec is null and counts are 0.
    Columns of ``table`` with these names are replaced.
    """
    schema = "codec string, time_scale long, duration long, n_samples long, keyframes array<struct<start:long,end:long>>, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long"
    names = [x.split()[0] for x in schema.replace("struct<start:long,end:long>", "x").split(", ")]
    keep = [c for c in table.columns if c != media and c.lower() not in names]
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), ranges, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def features(x: bytes) -> tuple:
        found = sample_table(x)
        if not found:
            return (None, 0, 0, 0, [], len(x), hashlib.sha256(x).hexdigest(), 0, hashlib.sha256().hexdigest(), 0)
        payload = read_payload(x, found)
        begin = found["offsets"][found["keys"]]
        spans = [{"start": a, "end": b} for a, b in zip(begin.tolist(), (begin + found["sizes"][found["keys"]]).tolist(), strict=True)]
        return (found["codec"], found["scale"], found["duration"], len(found["sizes"]), spans, len(x), hashlib.sha256(x).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, media):
            rows = [features(x) for x in texts_as_bytes(part.column(media))]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], keep + names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields if f.name in keep)
    return table.mapInArrow(run, f"{kept}, {schema}" if kept else schema)
