"""BPE, token counts and the token store against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tomeflow.llm import bpe, token_counts, token_store

from .conftest import edge_rows


@pytest.fixture(scope="module")
def byte_library(tokenizer):
    return Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


def fuzz(n, seed=5):
    r = random.Random(seed)
    some = ["ing", "th", "er", "the", "Th", " ", "  ", "\n", "tion", "a", "..", "--", "==", "é", "'s", "0", "中", "<|endoftext|>", "\x1c", "́"]
    return ["".join(r.choice(some) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_codec_and_counter_agree_with_library(byte_library, tokenizer):
    texts = fuzz(4000) + ["", "a" * 3000, " " * 500, "ab" * 2000]
    codec, counter = bpe.SpeculativeCodec(tokenizer("byte_bpe_50k.json")), token_counts.Counter(tokenizer("byte_bpe_50k.json"))
    expected = [x.ids for x in byte_library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in codec.encode(texts)] == expected
    assert counter.count(texts) == [len(x) for x in expected]
    assert [codec.decode(x) for x in expected] == [byte_library.decode(x, skip_special_tokens=False) for x in expected]
    assert codec.speculated and codec.exact  # both ways were taken


def test_word_table_forgets_and_relearns(byte_library, tokenizer):
    codec = bpe.SpeculativeCodec(tokenizer("byte_bpe_50k.json"))
    codec.table._limit = 50
    texts = fuzz(300, 9)
    assert [x.tolist() for t in texts for x in codec.encode([t])] == [x.ids for x in byte_library.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_on_edges(edges, empty, byte_library, tokenizer):
    path = tokenizer("byte_bpe_50k.json")
    want = sorted((str(i), len(ids := byte_library.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in edge_rows())
    assert sorted((str(r[0]), *r[1:]) for r in bpe.round_trip(edges, path).collect()) == want
    assert sorted((str(r.doc_id), r.text) for r in bpe.decode(bpe.encode(edges, path), path).collect()) == sorted((str(i), t or "") for i, t in edge_rows())
    assert bpe.round_trip(empty, path).count() == 0


def test_token_counts_on_edges(edges, empty, byte_library, tokenizer):
    path = tokenizer("byte_bpe_50k.json")
    want = sorted((str(i), len((t or "").encode()), n := len(byte_library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in edge_rows())
    assert sorted((str(r[0]), *r[1:]) for r in token_counts.token_counts(edges, path).collect()) == want
    assert token_counts.token_counts(empty, path).count() == 0


def test_token_store_reads_back_what_the_library_gives(spark, edges, tokenizer):
    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    at = token_store.write_store(edges, path)
    rows = sorted(token_store.read_back(spark, at).collect(), key=lambda r: r.start)
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(rows) == len(edge_rows())
    ids = sorted((str(i), [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in edge_rows())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()] and all(r.verified for r in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in token_store.reconstruct(spark, at).collect()) == ids
    chunks = token_store._object_rows(spark, at, "chunk")
    assert chunks.count() == chunks.select("key").distinct().count()


def test_token_store_of_an_empty_table(spark, empty, tokenizer):
    at = token_store.write_store(empty, tokenizer("word_bpe_49k.json"))
    assert token_store.read_back(spark, at).count() == 0


def test_damaged_chunk_is_not_verified(spark, edges, tokenizer):
    at = token_store.write_store(edges.where("doc_id in (10, 19)"), tokenizer("word_bpe_49k.json"))
    chunks = token_store._object_rows(spark, at, "chunk").collect()
    longest = max(chunks, key=lambda c: len(c.payload))
    kept = [(bytes(c.key), bytes(c.payload)) for c in chunks if c.key != longest.key]
    spark.createDataFrame(kept, "key binary, payload binary").write.mode("overwrite").parquet(f"{at}/objects/kind=chunk")
    found = {r.doc_id: r.verified for r in token_store.read_back(spark, at).collect()}
    assert found == {10: False, 19: True}


def test_cut_points_follow_content():
    r = np.random.default_rng(1)
    ids = r.integers(0, 49_000, 30_000).astype("<u4")
    a = token_store.cut_points(ids)
    b = token_store.cut_points(np.concatenate([ids[:100] + 1, ids]))
    assert a[-1] == 30_000 and len({x + 100 for x in a} & set(b)) > 0.9 * len(a)
    assert max(np.diff([0, *a])) <= token_store.LONGEST and len(token_store.cut_points(ids[:0])) == 0


def test_crc_of_joined_strings():
    parts = [b"", b"a", b"hello world" * 50, b"\0" * 77]
    crcs, sizes = np.array([zlib.crc32(p) for p in parts] * 2), np.array([len(p) for p in parts] * 2)
    found = token_store.crcs_of_joined(crcs, sizes, np.array([0, 4, 4, 8]))
    assert found.tolist() == [zlib.crc32(b"".join(parts)), 0, zlib.crc32(b"".join(parts))]
