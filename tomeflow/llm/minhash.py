"""Near duplicates by BagMinHash over multisets of word shingles.

The weight axis of a shingle is cut into levels [0,1), [1,2), [2,4), [4,8) ... Each level has a Poisson
process of its own, seeded by shingle and level, whose rate is the level's length for each of the signature's
components; a point falls into a cell of the level by halving it, bit after bit. A shingle that occurs w
times contributes the points in cells below w, so two texts share exactly the points below the lesser of
their weights, and a component's least point agrees with the probability of their weighted Jaccard
similarity. Points are drawn in rising order up to a bound that all components meet with high probability;
texts with a component left empty are drawn again up to twice the bound.

Signatures are banded. Texts that share a band are verified by exact multiset overlap (see bucket_groups), and
linked texts form groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Shelf, arrow_map, batch_of, renamed, stored, text_digest, texts_of
from ._graph import Checks, Groups, Linker, bucket_groups, in_band
from ._words import Words, mixed, shingles, text_runs

BANDS, ROWS = 24, 6
WIDTH, SIMILARITY = 5, 0.8


def multiset(hashes: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, times each occurs) of a text's word hashes."""
    return np.unique(shingles(hashes, width), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two multisets; two empty ones are alike."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (total - shared)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """The signature of each bag, m numbers a row; an empty bag has infinities."""
    found = np.full((len(bags), m), np.inf)
    weights = np.array([w.sum() for _, w in bags], float)
    todo, factor = np.flatnonzero(weights > 0), math.log(m) + 4
    while len(todo):
        bound = np.full(len(bags), -1.0)
        bound[todo] = factor / weights[todo]
        _draw([bags[i] for i in todo], bound[todo], found, todo)
        todo = todo[~np.isfinite(found[todo]).all(axis=1)]
        factor *= 2
    return found


def _draw(bags: list[tuple[np.ndarray, np.ndarray]], bound: np.ndarray, found: np.ndarray, rows: np.ndarray) -> None:
    """Puts the least point up to each bag's bound into each component of its row."""
    m = found.shape[1]
    of = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    shingle, weight = np.concatenate([h for h, _ in bags]), np.concatenate([w for _, w in bags])
    level = 0
    parts: list[tuple[np.ndarray, ...]] = []
    below = 0  # where the level begins on the weight axis
    while len(of):
        length = max(1, below)
        seed = mixed(shingle + np.uint64((level + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        parts.append((of, seed, weight - below, np.full(len(of), length)))
        below += length
        keep = weight > below
        of, shingle, weight, level = of[keep], shingle[keep], weight[keep], level + 1
    of, seed, reach, length = (np.concatenate(x) for x in zip(*parts, strict=True))
    at, limit, flat = np.zeros(len(of)), bound[of], found.reshape(-1)
    place = rows[of] * m
    while len(of):
        seed = seed + np.uint64(0x9E3779B97F4A7C15)
        drawn = mixed(seed)
        at = at - np.log1p(-((drawn >> np.uint64(11)) * 2.0**-53)) / (length * m)
        live = at <= limit
        of, seed, reach, length, at, limit, place, drawn = (x[live] for x in (of, seed, reach, length, at, limit, place, drawn))
        where = mixed(drawn ^ np.uint64(0xA0761D6478BD642F))
        cell = (where >> np.uint64(40)).astype(np.int64) & (length - 1)
        hit = cell < reach
        component = ((where & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(flat, (place + component)[hit], at[hit])


def band_keys(found: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A bucket number for each band of each signature."""
    bits = np.ascontiguousarray(found).view(np.uint64).reshape(len(found), bands, -1)
    key = np.zeros(bits.shape[:2], np.uint64)
    for k in range(bits.shape[2]):
        key = mixed(key * np.uint64(0x100000001B3) + bits[:, :, k])
    band = np.arange(bands, dtype=np.uint64)
    return in_band(mixed(key + band * np.uint64(0xD1342543DE82EF95)), band)


def linker(similarity: float) -> Linker:
    """For bucket_groups: texts are linked whose multisets of shingles overlap in at least similarity."""

    def link(texts: list[str], i: np.ndarray, j: np.ndarray, groups: Groups) -> Checks:
        bags: list[tuple[np.ndarray, np.ndarray]] = []
        for _, some in text_runs(texts, 1 << 19):
            words = Words(some)
            bags += [multiset(words.hashes[a:b]) for a, b in zip(words.edges, words.edges[1:])]
        total = np.array([w.sum() for _, w in bags])
        close = np.minimum(total[i], total[j]) >= (similarity - 1e-12) * np.maximum(total[i], total[j])
        i, j = i[close], j[close]
        edges = np.concatenate([[0], np.flatnonzero(i[1:] != i[:-1]) + 1, [len(i)]]).tolist() if len(i) else [0]
        for a, b in zip(edges, edges[1:]):  # pairs come sorted by i
            one, others = int(i[a]), j[a:b]
            others = others[groups.label[others] != groups.label[one]]
            if len(others):
                shingle, weight = bags[one]
                sizes = np.array([len(bags[k][0]) for k in others])
                theirs, times = (np.concatenate([bags[k][x] for k in others]) for x in range(2))
                at = np.minimum(np.searchsorted(shingle, theirs), len(shingle) - 1)
                common = np.where(shingle[at] == theirs, np.minimum(weight[at], times), 0)
                shared = np.add.reduceat(common, np.cumsum(sizes) - sizes)
                for k in others[shared / (total[others] + total[one] - shared) >= similarity - 1e-12].tolist():
                    groups.join(one, k)
        yield from ()

    return link


SIGNED = "doc_id long, digest binary, n long, bands array<long>"


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, digest (md5 of the text), n shingles and band keys of every row of docs."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = texts_of(batch)
        for at, some in text_runs(texts, 1 << 19):
            digests = [hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in some]
            place = {d: k for k, d in enumerate(dict.fromkeys(digests))}
            back = np.array([place[d] for d in digests])
            first = np.unique(back, return_index=True)[1]
            words = Words([some[i] for i in first])
            bags = [multiset(words.hashes[a:b]) for a, b in zip(words.edges, words.edges[1:])]
            keys = band_keys(signatures(bags, bands * rows), bands)[back]
            n = np.array([int(w.sum()) for _, w in bags])[back]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
            yield batch_of({"doc_id": batch.column(0).slice(at, len(some)), "digest": digests, "n": n, "bands": lists}, {"digest": pa.binary()})

    return arrow_map(docs.select("doc_id", "text"), run, SIGNED)


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of every row of docs, and (digest, class_id, class_rows, best) of every text."""
    with Shelf(docs.sparkSession) as shelf:
        all_rows = shelf.put(signed(docs), "signed", compression="zstd")
        rows = stored(all_rows.select("doc_id", "digest"), "rows", compression="zstd")
        copies = all_rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        nodes = shelf.put(copies.withColumn("id", F.monotonically_increasing_id()), "nodes", compression="zstd")
        shelf.drop("signed")

        def payload(wanted: DataFrame) -> DataFrame:
            named = wanted.join(nodes.select("id", "digest", "first"), "id")
            texts = docs.select("doc_id", "text", text_digest().alias("digest")).join(named.withColumnRenamed("digest", "_digest"), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("_digest")))
            return texts.groupBy("id").agg(F.max("text").alias("text"))

        members = nodes.where("n > 0").select("id", F.explode("bands").alias("bucket"))
        groups = bucket_groups(members, payload, linker(similarity))
        placed = nodes.select("id", "digest", "first", "copies").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        placed = shelf.put(placed, "placed", compression="zstd")
        best = placed.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "digest")).alias("best"), F.sum("copies").alias("class_rows"))
        best = shelf.put(best.select("root", F.col("best.first").alias("class_id"), F.col("best.digest").alias("best"), "class_rows"), "best")
        classes = placed.join(best, "root").select("digest", "class_id", "class_rows", (F.col("digest") == F.col("best")).alias("best"))
        return rows, stored(classes, "classes", compression="zstd")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, digest (md5 of the text), class_id (the least doc_id of the group), class_rows and keep for every row of docs.

    A group holds texts joined by links of at least `similarity` weighted Jaccard over five-word shingles,
    with all their copies. Words are lower-cased and without marks; a text of one to four words is one
    shingle. Texts without any word have no links: only equal ones (null counts as empty) form a group.
    Texts of any length are compared whole. keep is true for the rows of the group's least doc_id and, of
    several texts with that doc_id, the least digest; rows that repeat doc_id and text are kept or not
    together. A null doc_id counts only where a group has no other. An empty table gives no rows; other
    columns are not read and may have any name.
    """
    rows, classes = _classes(docs, similarity)
    return rows.join(classes, "digest").select("doc_id", "digest", "class_id", "class_rows", (F.col("best") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("keep"))


def first_of_each_group(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each group of near duplicates (see near_duplicates), with the columns of docs as they are.

    It is a row that near_duplicates keeps; of several that repeat doc_id and text, the one whose columns have
    the least hash. Null and empty texts are equal, so one row of them all stays. Columns may have any name and
    type but map; an empty table gives no rows.
    """
    kept = stored(near_duplicates(docs, similarity).where("keep").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("times")), "kept")
    plain, back = renamed(docs)
    own = [plain[f"c{docs.columns.index(x)}"] for x in ("doc_id", "text")]
    found = plain.withColumn("own", text_digest(own[1])).join(kept, own[0].eqNullSafe(kept["doc_id"]) & (F.col("own") == kept["digest"]))
    once = found.where("times = 1").select(*plain.columns)
    several = found.where("times > 1").groupBy("doc_id", "digest").agg(F.min_by(F.struct(*plain.columns), F.xxhash64(*plain.columns)).alias("row")).select("row.*")
    return back(once.unionByName(several))
