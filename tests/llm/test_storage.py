"""Sharding and media columns."""

import hashlib
import heapq
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest

from tomeflow.llm import media, sharding

from .conftest import edge_rows


def test_lpt_plan_is_what_a_heap_gives():
    r = random.Random(3)
    for _ in range(30):
        sizes = sorted((r.choice([5, 7, 100, 1000, 50_000]) for _ in range(r.randint(1, 3000))), reverse=True)
        classes = [(s, n, s * n) for s, n in Counter(sizes).items()]
        plan, heap = sharding.lpt_plan(classes, 16), [(0, s) for s in range(16)]
        loads = [0] * 16
        for s, ends in plan.items():
            assert ends[-1] == Counter(sizes)[s]
            for k, (a, b) in enumerate(zip([0, *ends], ends)):
                loads[k] += (b - a) * s
        for s in sizes:
            load, k = heapq.heappop(heap)
            heapq.heappush(heap, (load + s, k))
        assert max(loads) - min(loads) <= max(x for x, _ in heap) - min(x for x, _ in heap) + 1e-6


def test_shards_keep_equal_texts_together(edges, empty):
    rows = sharding.shard_by_size(edges, 4).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in edge_rows())
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 4
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    groups = defaultdict(set)
    for r in rows:
        groups[(r.size, r.text_crc32)].add(r.shard)
    assert all(len(x) == 1 for x in groups.values())
    assert sharding.shard_by_size(empty, 4).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 70_000])
def test_container_round_trip(n):
    payload = media.padded(bytes(i % 251 for i in range(n)))
    assert len(payload) % 64 == 0 and len(payload) >= 64
    data = media.write_container(payload)
    (track,) = media.probe(data)
    assert media.read_payload(data, track) == payload
    assert (track.codec, track.handler, track.samples, track.duration) == ("raw", "soun", len(payload), len(payload))
    assert len(track.keyframes) == -(-len(payload) // media.KEY_EVERY) and all(b - a == 1 for _, a, b in track.keyframes)


def test_probe_reads_tables_of_other_shapes():
    """Sample sizes of their own, 32-bit offsets, two runs of chunks, no duration in the header."""
    body = b"AAAABBBBBBCCDDDDDDD"
    sizes = [4, 6, 2, 7]
    head = media.box(b"ftyp", b"isom")
    first = len(head) + 8
    full = media.full_box
    stbl = media.box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(8))), full(b"stts", struct.pack(">IIIII", 2, 3, 100, 1, 50)),
        full(b"stsc", struct.pack(">I6I", 2, 1, 3, 1, 2, 1, 1)), full(b"stsz", struct.pack(">II4I", 0, 4, *sizes)),
        full(b"stco", struct.pack(">III", 2, first, first + 12)), full(b"stss", struct.pack(">III", 2, 1, 4)),
    )
    mdia = media.box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), media.box(b"minf", stbl))
    data = head + media.box(b"mdat", body) + media.box(b"moov", media.box(b"trak", mdia))
    (t,) = media.probe(data)
    assert (t.codec, t.duration, t.samples, t.timescale) == ("avc1", 350, 4, 1000)
    assert [data[a:b] for _, a, b in t.keyframes] == [b"AAAA", b"DDDDDDD"] and media.read_payload(data, t) == body


def test_media_column_on_edges(edges, empty):
    rows = media.stored_features(edges).collect()
    want = []
    for i, t in edge_rows():
        raw = (t or "").encode()
        p = media.padded(raw)
        want.append((str(i), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(d := media.write_container(p)), hashlib.sha256(d).hexdigest()))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows) == sorted(want)
    assert media.stored_features(empty).count() == 0


def test_damaged_media_say_so(spark):
    good = media.write_container(media.padded(b"hi"))
    df = spark.createDataFrame([(1, 2, good[:-9]), (2, 2, None), (3, 2, b""), (4, 2, good)], "doc_id long, n_bytes long, media binary")
    found = {r.doc_id: r.problem for r in media.probe_column(df).collect()}
    assert found[4] is None and all(found[k] for k in (1, 2, 3))


def test_tracks_without_sample_sizes_are_a_problem():
    good = media.write_container(media.padded(b"hi"))
    with pytest.raises(ValueError, match="stsz"):
        media.probe(good.replace(b"stsz", b"stzz"))
    with pytest.raises(ValueError, match="fragments"):
        media.probe(good + media.box(b"moof", b""))


def test_all_tracks_with_compact_sizes(spark):
    """Two tracks, one with sizes of four bits and no keyframe table; stts counts, not the header."""
    full, head, body = media.full_box, media.box(b"ftyp", b"isom"), b"AABCCCDD"
    first = len(head) + 8

    def track(codec, sizes, chunks, keys, stts):
        stbl = media.box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), media.box(codec, bytes(8))), full(b"stts", struct.pack(">I", len(stts)), *(struct.pack(">II", *x) for x in stts)),
            full(b"stsc", struct.pack(">IIII", 1, 1, chunks[1], 1)), sizes, full(b"stco", struct.pack(">II", 1, chunks[0])), *([full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys))] if keys else []),
        )
        return media.box(b"trak", media.box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 100, 7, 0, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"vide")), media.box(b"minf", stbl)))

    compact = full(b"stz2", bytes([0, 0, 0, 4]), struct.pack(">I", 3), bytes([0x21, 0x30]))
    single = full(b"stsz", struct.pack(">II", 1, 2))
    data = head + media.box(b"mdat", body) + media.box(b"moov", track(b"avc1", compact, (first, 3), [], [(3, 40)]), track(b"raw ", single, (first + 6, 2), [2], [(2, 1)]))
    a, b = media.probe(data)
    assert [data[x:y] for _, x, y in a.keyframes] == [b"AA", b"B", b"CCC"] and (a.duration, a.declared) == (120, 7)
    assert [data[x:y] for _, x, y in b.keyframes] == [b"D"] and media.read_payload(data, b) == b"DD"
    row = media.probe_column(spark.createDataFrame([(1, 2, data)], "doc_id long, n_bytes long, media binary")).first()
    assert [t.codec for t in row.tracks] == ["avc1", "raw"] and len(row.keyframes) == 3 and row.problem is None
