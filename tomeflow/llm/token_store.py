"""Content-addressed store of token ids.

Layout under one folder, all Parquet:

  objects/kind=chunk   key (sha256 of payload), payload (a byte with the width, then ids, little-endian)
  recipes              doc_id, part, n_ids, digests (32 bytes a chunk), root; ascending doc_id

A rolling hash over the last `WINDOW` ids cuts a document's id stream where its top bits are zero, so equal
passages give equal chunks wherever they stand. A chunk is stored once. `root` is the Merkle root over the
document's chunk digests; reading back hashes each stored payload and rebuilds the root from those hashes.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import arrow_map, batch_of, bucket_count, drop_stored, shared_dir, texts_of
from ._pieces import BEYOND_LATIN, LETTERS, NUMBERS, SPACES, WordTable, runs

END_ID = 1
WINDOW, CUT_BITS, SHORTEST, LONGEST = 8, 9, 64, 4096


class IdEncoder:
    """The tokenizers library over whole texts, asked once for each distinct word.

    For a tokenizer that lower-cases, drops white space and marks each word's last token with a suffix, a
    text that is below U+0250 in lower case and without special strings falls into words (by the tokenizer's own split pattern) that
    are encoded apart; the library gets the new words of a run of texts in one line. Any other text it gets
    whole.
    """

    _WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        spec = json.loads(self.library.to_str())
        suffix = spec["model"]["end_of_word_suffix"]
        self.by_word = bool(suffix) and {"type": "Lowercase"} in (spec["normalizer"] or {}).get("normalizers", [])
        self.special = [a["content"] for a in spec["added_tokens"]]
        shared = set.intersection(*map(set, self.special)) if self.special else {""}
        self._sign = min(shared or {""}, key=lambda c: (c.isalnum(), c))  # in every special string
        self._last = np.zeros(size, bool)
        for token, i in self.library.get_vocab().items():
            self._last[i] = bool(suffix) and token.endswith(suffix)
        self.table = WordTable(self._encode_new, limit=900_000, chars=18_000_000)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate(self._whole([" ".join(words[i : i + 256]) for i in range(0, len(words), 256)]))
        ends = np.flatnonzero(self._last[ids]) + 1
        if len(ends) != len(words):  # a word whose end the vocabulary can't spell
            found = self._whole(words)
            ids, ends = np.concatenate(found), np.cumsum([len(x) for x in found])
        return ids, np.diff(ends, prepend=0)

    def _run(self, texts: list[str]) -> list[np.ndarray]:
        lower = [t.lower() for t in texts]
        odd = [i for i, t in enumerate(lower) if not self.by_word or not (t.isascii() or BEYOND_LATIN.search(t) is None) or (self._sign in t and any(x in t for x in self.special))]
        for i in odd:
            lower[i] = ""
        found = self.table.ids([self._WORDS.findall(t) for t in lower])
        for i, x in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
            found[i] = x
        return found

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for run in runs(texts):
            yield from self._run(run)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random 64-bit number for each id."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def cut_points(ids: np.ndarray) -> list[int]:
    """Where the chunks of a stream end: after ids whose rolling hash has CUT_BITS zero bits on top.

    No chunk but the last is shorter than SHORTEST, none longer than LONGEST; an empty stream has no chunk.
    """
    n = len(ids)
    rolling = np.zeros(n, np.uint64)
    mixed, factor = _mixed(ids), np.uint64(0xD6E8FEB86659FD93)
    weight = np.uint64(1)
    for back in range(min(WINDOW, n)):
        rolling[back:] += mixed[: n - back] * weight
        weight = np.uint64(int(weight) * int(factor) & 0xFFFFFFFFFFFFFFFF)
    ends, last = [], 0
    for at in (np.flatnonzero(rolling >> np.uint64(64 - CUT_BITS) == 0) + 1).tolist():
        while at - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if at - last >= SHORTEST:
            last = at
            ends.append(at)
    while n - last > LONGEST:
        last += LONGEST
        ends.append(last)
    return ends if last == n else [*ends, n]


def ids_of(payload: bytes) -> bytes:
    """The ids of a stored chunk as little-endian unsigned 32-bit integers."""
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4").tobytes()


def merkle_root(digests: list[bytes]) -> bytes:
    """The root of a binary tree over chunk digests; an odd node moves up as it is."""
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(level) & ~1 :]
    return level[0]


_OBJECT = "key binary, kind string, payload binary, doc_id long, n_ids long, digests binary, root binary"


def _objects(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A recipe for each row of docs, and each chunk once for a batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, width = TaskContext.get().partitionId(), 0, encoder(tokenizer).width
        types = {"key": pa.binary(), "kind": pa.string(), "payload": pa.binary(), "doc_id": pa.int64(), "n_ids": pa.int64(), "digests": pa.binary(), "root": pa.binary()}
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            seen: set[bytes] = set()
            rows: list[tuple] = []
            size = 0
            for doc_id, ids in zip(doc_ids, encoder(tokenizer).encode(texts_of(batch)), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                raw, digests, last = ids.astype(f"<u{width}").tobytes(), [], 0
                for end in cut_points(ids):
                    payload = bytes([width]) + raw[width * last : width * end]
                    digests.append(digest := hashlib.sha256(payload).digest())
                    if digest not in seen:
                        seen.add(digest)
                        rows.append((digest, "chunk", payload, None, None, None, None))
                        size += len(payload)
                    last = end
                rows.append((b"recipe %d %d" % (task, row), "recipe", None, doc_id, len(ids), b"".join(digests), merkle_root(digests)))
                row += 1
                if size > 8 << 20:
                    yield batch_of(dict(zip(types, zip(*rows))), types)
                    rows, size = [], 0
            if rows:
                yield batch_of(dict(zip(types, zip(*rows))), types)

    return docs.select("doc_id", "text").mapInArrow(run, _OBJECT)


def write_store(docs: DataFrame, tokenizer: str) -> str:
    """Encodes every row of docs, each id stream ended by END_ID, into a new store; gives its folder.

    Null texts have END_ID alone. Repeated rows have a recipe each and share their chunks; null doc_ids come
    first. An empty table makes an empty store.
    """
    spark = docs.sparkSession
    at = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    found = _objects(docs, tokenizer).groupBy("key").agg(*(F.first(c).alias(c) for c in ("kind", "payload", "doc_id", "n_ids", "digests", "root")))
    found.write.partitionBy("kind").parquet(f"{at}/objects")
    recipes = _object_rows(spark, at, "recipe")
    parts = bucket_count(recipes.count())
    ordered = recipes.select("doc_id", "n_ids", "digests", "root").repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root").withColumn("part", F.spark_partition_id())
    ordered.write.parquet(f"{at}/recipes")
    drop_stored(spark, f"{at}/objects/kind=recipe")
    return at


def _object_rows(spark: SparkSession, at: str, kind: str) -> DataFrame:
    return spark.read.schema(_OBJECT).parquet(f"{at}/objects").where(F.col("kind") == kind)


def recipes(spark: SparkSession, at: str) -> DataFrame:
    """The recipes with `start`, the number of ids of all documents before, in the order of doc_id.

    Sums run inside each of the table's parts (ranges of doc_id as written); only one row a part is scanned
    in order.
    """
    rows = spark.read.schema("doc_id long, n_ids long, digests binary, root binary, part int").parquet(f"{at}/recipes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("part").agg(F.sum("n_ids").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(firsts, "part").withColumn("start", F.col("_first") + F.col("_inside")).drop("_first", "_inside")


def read_chunks(spark: SparkSession, at: str) -> DataFrame:
    """Of each stored chunk, from its bytes: digest (as hashed now), n, and the crc32 of its ids."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        payloads = batch.column(0).to_pylist()
        ids = [ids_of(p) for p in payloads]
        yield batch_of({"digest": [hashlib.sha256(p).digest() for p in payloads], "n": [len(x) // 4 for x in ids], "crc": [zlib.crc32(x) for x in ids]}, {"digest": pa.binary(), "n": pa.int64(), "crc": pa.int64()})

    return arrow_map(_object_rows(spark, at, "chunk").select("payload"), run, "digest binary, n long, crc long")


def _references(spark: SparkSession, at: str) -> DataFrame:
    """A row for each chunk of each recipe: start (one document's own), place and digest."""
    rows = recipes(spark, at).select("start", "doc_id", "root", "digests")
    places = F.sequence(F.lit(0), (F.length("digests") / 32).cast("int") - 1)
    return rows.withColumn("place", F.explode(places)).withColumn("digest", F.col("digests").substr(F.col("place") * 32 + 1, F.lit(32))).drop("digests")


def _times_x(power: int) -> int:
    """x to a power modulo the CRC-32 polynomial, bits reflected."""
    result, square = 1 << 31, 1 << 30
    while power:
        if power & 1:
            result = _product(result, square)
        square, power = _product(square, square), power >> 1
    return result


def _product(a: int, b: int) -> int:
    """The product of two polynomials modulo the CRC-32 polynomial, bits reflected."""
    found = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            found ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return found


@functools.lru_cache(maxsize=LONGEST + 1)
def _shift(size: int) -> int:
    return _times_x(8 * size)


def crcs_of_joined(crcs: np.ndarray, sizes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The crc32 of each run of byte strings joined, from the crc32 and length of each string.

    Run i is strings edges[i]:edges[i + 1]. The k-th strings of all runs are joined at once.
    """
    lengths, back = np.unique(sizes, return_inverse=True)
    shift = np.array([_shift(int(n)) for n in lengths], np.uint64)[back] if len(sizes) else np.zeros(0, np.uint64)
    found, counts = np.zeros(len(edges) - 1, np.uint64), np.diff(edges)
    crcs, one, poly = crcs.astype(np.uint64), np.uint64(1), np.uint64(0xEDB88320)
    for k in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > k)
        at = edges[live] + k
        a, b, product = found[live], shift[at], np.zeros(len(live), np.uint64)
        for bit in range(31, -1, -1):
            product ^= np.where(a >> np.uint64(bit) & one, b, np.uint64(0))
            b = b >> one ^ np.where(b & one, poly, np.uint64(0))
        found[live] = product ^ crcs[at]
    return found


def read_back(spark: SparkSession, at: str) -> DataFrame:
    """Per document, from the stored files: doc_id, start, n_tokens, ids_crc32, root (hex) and verified.

    Chunks are read and hashed once each, whatever the number of documents that share them; a document's
    checksum is joined from those of its chunks. verified: all chunks are there and give the recipe's root.
    """
    joined = _references(spark, at).join(read_chunks(spark, at), "digest", "left")
    whole = joined.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("place", "digest", "n", "crc"))).alias("chunks"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(3)
        edges = np.array(lists.offsets) - lists.offsets[0].as_py()
        digests, n, crc = (lists.flatten().field(k) for k in (1, 2, 3))
        missing, digests = np.array(n.is_null()), digests.to_pylist()
        sizes = np.array(n.fill_null(0))
        crcs = crcs_of_joined(np.array(crc.fill_null(0)), 4 * sizes, edges)
        whole = [not missing[a:b].any() for a, b in zip(edges, edges[1:])]
        roots = batch.column(2).to_pylist()
        good = [w and merkle_root(digests[a:b]) == r for w, a, b, r in zip(whole, edges, edges[1:], roots)]
        sums = np.concatenate([[0], np.cumsum(sizes)])[edges]
        yield batch_of({"doc_id": batch.column(1), "start": batch.column(0), "n_tokens": np.diff(sums), "ids_crc32": pa.array(crcs.astype(np.int64), mask=~np.array(whole, bool)), "root": [r.hex() for r in roots], "verified": good}, {"root": pa.string(), "verified": pa.bool_()})

    return arrow_map(whole, run, "doc_id long, start long, n_tokens long, ids_crc32 long, root string, verified boolean")


def reconstruct(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start and ids (little-endian unsigned 32-bit) of every document, from chunks and recipes."""
    chunks = _object_rows(spark, at, "chunk").select(F.col("key").alias("digest"), "payload")
    pieces = _references(spark, at).join(chunks, "digest")
    whole = pieces.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("place", "payload"))).alias("chunks"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = [b"".join(ids_of(c["payload"]) for c in chunks) for chunks in batch.column(2).to_pylist()]
        yield batch_of({"doc_id": batch.column(1), "start": batch.column(0), "ids": ids}, {"ids": pa.binary()})

    return arrow_map(whole, run, "doc_id long, start long, ids binary")
