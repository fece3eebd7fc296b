"""Media columns: ISO media containers.

A container is a tree of boxes: a big-endian size, a four-letter type, and content or further boxes. The
writer makes an uncompressed mono track of 8-bit samples: `ftyp`, `mdat` with the samples, `moov` with the
sample tables. The prober walks the boxes of any such file and decodes `stts`, `stsc`, `stsz`/`stz2`,
`stco`/`co64` and `stss` of every track into codec, duration and the byte ranges of chunks and keyframes; it never
decodes payloads. Samples in movie fragments (`moof`) are refused, with the reason.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import arrow_map, batch_of, stored, texts_of

ALIGN, RATE, CODEC = 64, 8000, b"raw "
#: Samples in a chunk of the file, and every how many of them one counts as a keyframe.
CHUNK, KEY_EVERY = 64 * 1024, 64 * 1024
#: Boxes that hold boxes.
_TREES = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


def box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *content: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *content)


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of ALIGN."""
    return data + bytes(max(ALIGN, -(-len(data) // ALIGN) * ALIGN) - len(data))


def write_container(payload: bytes) -> bytes:
    """A file whose one track holds each byte of payload as an 8-bit sample."""
    n = len(payload)
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isommp41")
    data = box(b"mdat", payload)
    first = len(head) + len(data) - n
    starts = range(0, n, CHUNK)
    keys = range(1, n + 1, KEY_EVERY)
    runs = [(1, min(n, CHUNK), 1)] + ([(len(starts), n % CHUNK, 1)] if n > CHUNK and n % CHUNK else [])
    entry = box(CODEC, bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    table = box(
        b"stbl",
        full_box(b"stsd", struct.pack(">I", 1), entry),
        full_box(b"stts", struct.pack(">III", 1, n, 1)),
        full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full_box(b"stsz", struct.pack(">II", 1, n)),
        full_box(b"co64", struct.pack(f">I{len(starts)}Q", len(starts), *(first + s for s in starts))),
        full_box(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
    )
    media = box(
        b"mdia",
        full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)),
        full_box(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
        box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), table),
    )
    track = box(b"trak", full_box(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0x100, 0), matrix, bytes(8), flags=7), media)
    movie = box(b"moov", full_box(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2)), track)
    return head + data + movie


def walk(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, content start, content end) of every box, outer before inner. A damaged size raises ValueError."""
    todo = [((), start, len(data) if end is None else end)]
    while todo:
        path, at, stop = todo.pop()
        inner = []
        while at < stop:
            if stop - at < 8:
                raise ValueError("a box is cut off")
            size, kind = struct.unpack_from(">I4s", data, at)
            body = at + 8
            if size == 1:
                if stop - at < 16:
                    raise ValueError("a box is cut off")
                size, body = struct.unpack_from(">Q", data, body)[0], at + 16
            elif size == 0:
                size = stop - at
            if at + size > stop or at + size < body:
                raise ValueError(f"box {kind!r} has a wrong size")
            yield (*path, kind), body, at + size
            if kind in _TREES:
                inner.append(((*path, kind), body, at + size))
            at += size
        todo += reversed(inner)


@dataclass
class Track:
    """What the tables of one track say."""

    codec: str = ""
    handler: str = ""
    timescale: int = 0
    #: The sum of stts, or what mdhd says where there is none; and what mdhd says.
    duration: int = 0
    declared: int = 0
    samples: int = 0
    #: (first byte, end byte) of each run of samples that lies together, in order.
    chunks: list[tuple[int, int]] = field(default_factory=list)
    #: (sample from 1, first byte, end byte) of each keyframe.
    keyframes: list[tuple[int, int, int]] = field(default_factory=list)


def _entries(data: bytes, at: int, end: int, layout: str) -> list[tuple]:
    n = struct.unpack_from(">I", data, at + 4)[0]
    size = struct.calcsize(f">{layout}")
    if at + 8 + n * size > end:
        raise ValueError("a sample table is longer than its box")
    return list(struct.iter_unpack(f">{layout}", data[at + 8 : at + 8 + n * size]))


def probe(data: bytes) -> list[Track]:
    """The tracks of a file; ValueError if its boxes or tables are damaged or don't give the sizes of samples."""
    boxes = list(walk(data))
    if any(path[-1] == b"moof" for path, _, _ in boxes):
        raise ValueError("samples in fragments are not read")
    return [_track(data, at, end) for path, at, end in boxes if path == (b"moov", b"trak")]


def _track(data: bytes, start: int, stop: int) -> Track:
    track, tables = Track(), {}
    for path, at, end in walk(data, start, stop):
        kind = path[-1]
        if kind == b"mdhd":
            track.timescale, track.declared = struct.unpack_from(">IQ" if data[at] else ">II", data, at + (20 if data[at] else 12))
        elif kind == b"hdlr":
            track.handler = data[at + 8 : at + 12].decode("latin-1")
        elif kind == b"stsd":
            track.codec = data[at + 12 : at + 16].decode("latin-1").strip()
        elif kind in (b"stts", b"stsc", b"stsz", b"stz2", b"stco", b"co64", b"stss"):
            tables[kind] = (at, end)
    if not tables.keys() & {b"stsz", b"stz2"}:
        raise ValueError("a track has neither stsz nor stz2, so its samples are not found")
    _resolve(data, track, tables)
    return track


def _sizes(data: bytes, tables: dict[bytes, tuple[int, int]]) -> tuple[int, np.ndarray | None]:
    """The number of samples, and the bytes before each and after the last; None where stsz has one size for all."""
    if b"stsz" in tables:
        at, end = tables[b"stsz"]
        size, n = struct.unpack_from(">II", data, at + 4)
        if size:
            return n, None
        bits, begin = 32, at + 12
    else:
        at, end = tables[b"stz2"]
        bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        begin = at + 12
    if bits not in (4, 8, 16, 32) or begin + -(-n * bits // 8) > end:
        raise ValueError("a table of sample sizes is longer than its box")
    raw = np.frombuffer(data, np.uint8, -(-n * bits // 8), begin)
    sizes = np.stack([raw >> 4, raw & 15], axis=1).reshape(-1)[:n] if bits == 4 else raw.view(f">u{bits // 8}")
    return n, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _resolve(data: bytes, track: Track, tables: dict[bytes, tuple[int, int]]) -> None:
    track.samples, before = _sizes(data, tables)
    each = 0 if before is not None else struct.unpack_from(">I", data, tables[b"stsz"][0] + 4)[0]
    reach = (lambda k: k * each) if before is None else (lambda k: int(before[k]))  # bytes of the first k samples
    timed = _entries(data, *tables[b"stts"], "II") if b"stts" in tables else []
    track.duration = sum(n * d for n, d in timed) if timed else track.declared
    if timed and sum(n for n, _ in timed) != track.samples:
        raise ValueError("stts does not time all samples")
    offsets = [x for (x,) in (_entries(data, *tables[b"co64"], "Q") if b"co64" in tables else _entries(data, *tables[b"stco"], "I"))]
    runs = _entries(data, *tables[b"stsc"], "III")
    counts: list[int] = []
    for (first, per, _), following in zip(runs, [*(r[0] for r in runs[1:]), len(offsets) + 1], strict=True):
        counts += [per] * (following - first)
    firsts = [0]
    for offset, n in zip(offsets, counts, strict=True):
        if firsts[-1] + n > track.samples:
            raise ValueError("the sample tables do not agree")
        track.chunks.append((offset, offset + reach(firsts[-1] + n) - reach(firsts[-1])))
        firsts.append(firsts[-1] + n)
    if firsts[-1] != track.samples or any(b > len(data) for _, b in track.chunks):
        raise ValueError("the sample tables do not agree")
    keys = [k for (k,) in _entries(data, *tables[b"stss"], "I")] if b"stss" in tables else range(1, track.samples + 1)
    chunk = 0
    for k in keys:
        while firsts[chunk + 1] < k:
            chunk += 1
        begin = track.chunks[chunk][0] + reach(k - 1) - reach(firsts[chunk])
        track.keyframes.append((k, begin, begin + reach(k) - reach(k - 1)))


def read_payload(data: bytes, track: Track) -> bytes:
    """The stored bytes of a track, by its chunk ranges."""
    return b"".join(data[a:b] for a, b in track.chunks)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media: a container with the text's UTF-8 bytes as samples.

    A null text counts as empty and gives ALIGN zero samples. Rows stand alone: repeated rows, null doc_ids,
    extra columns and empty tables need no rule of their own.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t.encode() for t in texts_of(batch)]
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > 16 << 20 or i + 1 == len(texts):
                some = texts[at : i + 1]
                yield batch_of({"doc_id": batch.column(0).slice(at, len(some)), "n_bytes": [len(x) for x in some], "media": [write_container(padded(x)) for x in some]}, {"n_bytes": pa.int64(), "media": pa.binary()})
                at, size = i + 1, 0

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<sample:long,start:long,stop:long>>, tracks array<struct<codec:string,handler:string,timescale:long,duration:long,declared:long,samples:long,chunks:long,keyframes:array<struct<sample:long,start:long,stop:long>>>>, problem string"


_KEYS = pa.list_(pa.struct([("sample", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))
_TRACK = pa.struct([("codec", pa.string()), ("handler", pa.string()), *((x, pa.int64()) for x in ("timescale", "duration", "declared", "samples", "chunks")), ("keyframes", _KEYS)])


def probe_column(media: DataFrame) -> DataFrame:
    """Features of the containers in column media, next to doc_id and n_bytes.

    Payload, feature (codec, handler, rate, samples, chunks, keyframes), codec, duration_s and keyframes (byte ranges)
    are those of the first track; tracks has all. A null or damaged container gives nulls and says why in `problem`;
    no row is lost. Repeated rows, null doc_ids and empty tables need no rule of their own; containers of any length
    are read whole.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "keyframes", "tracks", "problem"]
    types = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "codec": pa.string(), "duration_s": pa.float64(), "keyframes": _KEYS, "tracks": pa.list_(_TRACK), "problem": pa.string()}

    def one(data: bytes | None) -> tuple:
        try:
            if data is None:
                raise ValueError("no media")
            tracks = probe(data)
            if not tracks:
                raise ValueError("no track")
        except (ValueError, KeyError, IndexError, struct.error) as e:
            return (None, None, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), None, None, None, None, None, str(e) or type(e).__name__)
        t = tracks[0]
        payload = read_payload(data, t)
        seconds = t.duration / t.timescale if t.timescale else None
        feature = f"{t.codec};{t.handler};{t.timescale};{t.samples};{len(t.chunks)};{len(t.keyframes)}"
        keys = lambda x: [{"sample": k, "start": a, "stop": b} for k, a, b in x.keyframes]
        listed = [{"codec": x.codec, "handler": x.handler, "timescale": x.timescale, "duration": x.duration, "declared": x.declared, "samples": x.samples, "chunks": len(x.chunks), "keyframes": keys(x)} for x in tracks]
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(data), hashlib.sha256(data).hexdigest(), feature, t.codec, seconds, keys(t), listed, None)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = list(zip(*map(one, (x.as_py() for x in batch.column(2))), strict=True))
        yield batch_of(dict(zip(names, [batch.column(0), batch.column(1), *rows], strict=True)), types)

    return arrow_map(media.select("doc_id", "n_bytes", "media"), run, FEATURES)


def stored_features(docs: DataFrame) -> DataFrame:
    """Writes the media column of docs to the shared folder and probes it from there: codec, duration and keyframe
    byte ranges are columns of the result. Rows as in media_column()."""
    return probe_column(stored(media_column(docs), "media")).drop("problem", "tracks")
