"""Benchmark decontamination with a distributed positional inverted index.

Documents are dealt into segments of about `SEGMENT_WORDS` words. A segment row holds its documents, its
terms and for each term the ascending positions where it stands, as differences; positions leave a gap
after each document. The index is a table that any number of searches can read. A search takes windows of
test words, per segment starts from the postings of a window's rarest term, shifts them to the window's
start, and intersects with the postings of the other terms, shifted alike, from rarest to most frequent.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Shelf, arrow_map, batch_of, renamed, stored, text_digest

WINDOW = 13
SEGMENT_WORDS = 1_000_000
#: Test texts are searched in blocks of at most so many words.
BLOCK_WORDS = 2_000_000
#: Postings that are shifted and intersected at once.
_AT_ONCE = 4_000_000
#: Bytes of words as they are (A-Z lower-cased); all others divide words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

INDEX = "segment string, doc_ids array<long>, digests array<binary>, n_words array<long>, terms binary, ends binary, gaps binary"


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, the runs of letters a-z, digits and all beyond ASCII; null has none."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index of docs: one row per segment.

    A document is known by its doc_id and the md5 of its text. Each row of docs is one of its own, with a null or repeated doc_id too; null and empty texts are
    there with no words. An empty table gives an empty index. A document longer than a segment gets one of
    its own, whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        ids: dict[bytes, int] = {}
        flat: list[np.ndarray] = []
        docs_in: list[int | None] = []
        digests: list[bytes] = []
        sizes: list[int] = []

        def segment() -> pa.RecordBatch:
            terms = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            n = np.array(sizes, np.int64)
            place = np.arange(len(terms), dtype=np.int64) + np.repeat(np.arange(len(n)), n)
            order = np.argsort(terms, kind="stable")
            ends = np.cumsum(np.bincount(terms, minlength=len(ids)))
            gaps = np.diff(place[order], prepend=0)
            row = {"segment": [f"{task}-{k}"], "doc_ids": [list(docs_in)], "digests": [list(digests)], "n_words": [list(sizes)], "terms": [b" ".join(ids)], "ends": [ends.astype("<i8").tobytes()], "gaps": [gaps.astype("<i4" if len(place) == 0 or place[-1] < 1 << 31 else "<i8").tobytes()]}
            return batch_of(row, {"segment": pa.string(), "doc_ids": pa.list_(pa.int64()), "digests": pa.list_(pa.binary()), "n_words": pa.list_(pa.int64()), "terms": pa.binary(), "ends": pa.binary(), "gaps": pa.binary()})

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                words = words_of(text)
                if docs_in and held + len(words) > segment_words:
                    yield segment()
                    k, held = k + 1, 0
                    ids, flat, docs_in, digests, sizes = {}, [], [], [], []
                docs_in.append(doc_id)
                digests.append(hashlib.md5(text.encode(), usedforsecurity=False).digest())
                sizes.append(len(words))
                if words:
                    number = ids.setdefault
                    flat.append(np.fromiter((number(w, len(ids)) for w in words), np.int32, len(words)))
                held += len(words)
        if docs_in:
            yield segment()

    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


@dataclass
class Segment:
    """A row of the index, with the postings of some terms."""

    doc_ids: list[int | None]
    n_words: np.ndarray
    starts: np.ndarray
    size: int
    #: Of each wanted term: where its postings are in `keys`, which holds term * size + position, ascending.
    first: np.ndarray
    count: np.ndarray
    keys: np.ndarray

    def postings(self, term: int) -> np.ndarray:
        return self.keys[self.first[term] : self.first[term] + self.count[term]] - term * self.size

    def holds(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each term stands at the place beside it."""
        want = terms * self.size + places
        at = np.searchsorted(self.keys, want)
        found = at < len(self.keys)
        found[found] = self.keys[at[found]] == want[found]
        return found


def open_segment(row: dict, wanted: dict[bytes, int]) -> Segment:
    n_words = np.array(row["n_words"], np.int64)
    starts = np.concatenate([[0], np.cumsum(n_words + 1)])[:-1].astype(np.int64)
    ends = np.frombuffer(row["ends"], "<i8")
    total = int(ends[-1]) if len(ends) else 0
    place = np.cumsum(np.frombuffer(row["gaps"], "<i4" if len(row["gaps"]) == 4 * total else "<i8").astype(np.int64))
    size = int(n_words.sum()) + len(n_words) + 1
    here = [(wanted[t], i) for i, t in enumerate(row["terms"].split(b" ") if total else []) if t in wanted]
    here.sort()
    first, count, lists, at = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64), [], 0
    for term, i in here:
        a, b = int(ends[i - 1]) if i else 0, int(ends[i])
        first[term], count[term] = at, b - a
        at += b - a
        lists.append(place[a:b] + term * size)
    return Segment(row["doc_ids"], n_words, starts, size, first, count, np.concatenate(lists) if lists else np.zeros(0, np.int64))


class Windows:
    """The distinct windows of some test texts, as rows of term numbers (-1: beyond a short window's end)."""

    def __init__(self, items: list[tuple[object, str | None]], width: int = WINDOW) -> None:
        self.terms: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words_of(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                of[tuple(ids[i : i + width])].add(item)
        self.items = [sorted(x, key=str) for x in of.values()]
        self.rows = np.array([(*w, *[-1] * (width - len(w))) for w in of], np.int64).reshape(-1, width)
        self.lengths = (self.rows >= 0).sum(axis=1)

    def occurrences(self, seg: Segment) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every place where a window stands whole."""
        counts = np.where(self.rows >= 0, seg.count[self.rows], np.int64(1 << 60))
        order = np.argsort(counts, axis=1, kind="stable")
        rare = np.take_along_axis(counts, order[:, :1], 1)[:, 0] if len(counts) else np.zeros(0, np.int64)
        some = np.flatnonzero((rare > 0) & ~((self.rows >= 0) & (counts == 0)).any(axis=1))
        found_w, found_p = [], []
        while len(some):
            n = max(1, int(np.searchsorted(np.cumsum(rare[some]), _AT_ONCE, "right")))
            block, some = some[:n], some[n:]
            offset = order[block, 0]
            term = self.rows[block, offset]
            windows = np.repeat(block, rare[block])
            inside = np.arange(len(windows)) - np.repeat(np.cumsum(rare[block]) - rare[block], rare[block])
            place = seg.keys[np.repeat(seg.first[term], rare[block]) + inside] - np.repeat(term * seg.size + offset, rare[block])
            for k in range(1, order.shape[1]):
                offset = order[windows, k]
                term = self.rows[windows, offset]
                keep = (term < 0) | seg.holds(term, place + offset)
                windows, place = windows[keep], place[keep]
            found_w.append(windows)
            found_p.append(place)
        return (np.concatenate(found_w), np.concatenate(found_p)) if found_w else (np.zeros(0, np.int64),) * 2


def _blocks(tests: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """(item_id, text) of the test texts in blocks of BLOCK_WORDS, rows without either left out."""
    block, held = [], 0
    for row in tests.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        block.append((row[0], row[1]))
        held += len(words_of(row[1]))
        if held > BLOCK_WORDS:
            yield block
            block, held = [], 0
    if block:
        yield block


MATCHES = "segment string, doc long, doc_id long, digest binary, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def _search_block(index: DataFrame, block: list[tuple[object, str | None]]) -> DataFrame:
    types = {"segment": pa.string(), "doc": pa.int64(), "doc_id": pa.int64(), "digest": pa.binary(), "n_words": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), "items": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(block)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                seg = open_segment(row, windows.terms)
                w, p = windows.occurrences(seg)
                covered = np.zeros(seg.size + WINDOW + 1, np.int64)
                np.add.at(covered, p, 1)
                np.add.at(covered, p + windows.lengths[w], -1)
                edge = np.diff((np.cumsum(covered) > 0).astype(np.int8), prepend=0)
                begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                spans, items = defaultdict(list), defaultdict(set)
                for a, b, d in zip(begin.tolist(), stop.tolist(), (np.searchsorted(seg.starts, begin, "right") - 1).tolist(), strict=True):
                    spans[d].append({"start": a - int(seg.starts[d]), "stop": b - int(seg.starts[d])})
                pairs = np.unique((np.searchsorted(seg.starts, p, "right") - 1) * len(windows.items) + w)
                for x in pairs.tolist():
                    items[x // len(windows.items)].update(map(str, windows.items[x % len(windows.items)]))
                n = len(seg.doc_ids)
                yield batch_of({"segment": [row["segment"]] * n, "doc": list(range(n)), "doc_id": seg.doc_ids, "digest": row["digests"], "n_words": seg.n_words, "spans": [spans.get(d, []) for d in range(n)], "items": [sorted(items.get(d, ())) for d in range(n)]}, types)

    return index.mapInArrow(run, MATCHES)


def phrase_matches(index: DataFrame, tests: DataFrame) -> DataFrame:
    """Of each indexed document: spans (words covered by any occurring window) and items (that have one).

    A window is WINDOW consecutive words of a test text, or all its words where it has fewer. Test rows
    without item_id or text and texts without words match nothing; a repeated item_id counts once.
    """
    blocks = list(_blocks(tests)) or [[]]
    if len(blocks) == 1:
        return _search_block(index, blocks[0])
    index = stored(index, "index", compression="zstd")  # segments are named by task, so they must be made once
    all_of = _search_block(index, blocks[0])
    for b in blocks[1:]:
        all_of = all_of.unionByName(_search_block(index, b))
    joined = all_of.groupBy("segment", "doc").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.first("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merge = """aggregate(spans, cast(array() as array<struct<start:bigint,stop:bigint>>), (a, x) ->
      if(size(a) > 0 and x.start <= element_at(a, -1).stop,
         concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'stop', greatest(element_at(a, -1).stop, x.stop)))),
         concat(a, array(x))))"""
    return joined.withColumn("spans", F.expr(merge))


def contamination(matches: DataFrame, per: int = 20, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and per * n_hit >= n_words), and
    extra columns of matches."""
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)")
    return matches.withColumn("n_hit", hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * per >= F.col("n_words"))).alias("contaminated"), *extra,
    )


def stored_index(docs: DataFrame) -> DataFrame:
    return stored(build_index(docs), "index", compression="zstd")


def decontaminated(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs as they are, whatever their names.

    Rows are matched with their judgement by doc_id and the md5 of the text, so rows that repeat both share it. Null
    and empty texts have no words and stay, as does all where there are no test texts; an empty table gives no rows.
    """
    with Shelf(docs.sparkSession) as shelf:
        index = shelf.put(build_index(docs), "index", compression="zstd")
        matches = phrase_matches(index, tests)
        bad = contamination(matches, extra=("digest",)).where("contaminated").select("doc_id", "digest").distinct()
        bad = stored(bad, "contaminated")
    plain, back = renamed(docs)
    doc, text = (f"c{docs.columns.index(x)}" for x in ("doc_id", "text"))
    return back(plain.withColumn("own", text_digest(text)).join(bad, F.col(doc).eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("digest")), "left_anti"))


def proximity_matches(index: DataFrame, tests: DataFrame, slop: int = 8) -> DataFrame:
    """doc_id, item_id, start and stop (words) of places that hold all distinct words of a window, in any
    order, within the window's length and slop more words; the shortest place for each document and window.
    """
    found = []
    for block in _blocks(tests):

        def run(batch: pa.RecordBatch, block: list = block) -> Iterator[pa.RecordBatch]:
            windows = Windows(block)
            out: dict[tuple, tuple] = {}
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                seg = open_segment(row, windows.terms)
                for w, length in enumerate(windows.lengths.tolist()):
                    terms = sorted(set(windows.rows[w, :length].tolist()), key=lambda t: seg.count[t])
                    if not seg.count[terms[0]]:
                        continue
                    reach, lists = length + slop, [seg.postings(t) for t in terms]
                    at = lists[0]
                    for other in lists[1:]:
                        low = np.searchsorted(other, at - reach + 1)
                        at = at[np.searchsorted(other, at + reach, "left") > low]
                    for p in at.tolist():
                        d = int(np.searchsorted(seg.starts, p, "right")) - 1
                        begin, end = int(seg.starts[d]), int(seg.starts[d] + seg.n_words[d])
                        near = sorted((int(q), t) for t, x in enumerate(lists) for q in x[np.searchsorted(x, max(begin, p - reach + 1)) : np.searchsorted(x, min(end, p + reach))])
                        last: dict[int, int] = {}
                        for q, t in near:
                            last[t] = q
                            if len(last) == len(lists) and (size := q + 1 - (a := min(last.values()))) <= reach:
                                for item in windows.items[w]:
                                    key = (row["segment"], d, str(item), w)
                                    if key not in out or out[key][2] - out[key][1] > size:
                                        out[key] = (seg.doc_ids[d], a - begin, q + 1 - begin)
            yield batch_of({"doc_id": [v[0] for v in out.values()], "item_id": [k[2] for k in out], "start": [v[1] for v in out.values()], "stop": [v[2] for v in out.values()]}, {"doc_id": pa.int64(), "item_id": pa.string(), "start": pa.int64(), "stop": pa.int64()})

        found.append(arrow_map(index, run, "doc_id long, item_id string, start long, stop long"))
    if not found:
        return index.sparkSession.createDataFrame([], "doc_id long, item_id string, start long, stop long")
    joined = found[0]
    for x in found[1:]:
        joined = joined.unionByName(x)
    return joined
