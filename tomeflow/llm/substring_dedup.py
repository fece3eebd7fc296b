"""Substring dedup by hashing lines, and units inside lines.

A line is normalised to its words and hashed. Digests are grouped globally: the occurrence of a line in the
earliest document (least doc_id), where it comes first, is kept and all others are repeats. Since a passage can
begin or end inside a line, lines are also cut into units, where a sentence ends and after words whose hash says so
(one in `CUT_EVERY`); a unit is hashed together with the unit before it, since short units alone recur by chance,
and grouped in the same way. Repeated lines that follow each other and repeated units that overlap form a span;
spans of LEAST_WORDS words or more are removed, with their offsets in the original.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Shelf, arrow_map, batch_of, renamed, stored, texts_of, whole_groups
from ._words import Words, mixed, spans_hashed, text_runs

CUT_EVERY, LEAST_WORDS, LONGEST = 5, 20, 127
#: high, low: digest of the row (row_digest). chars: first character << 32 | the one after the last. words: first
#: word << 32 | number of words << 1 | 1 if the text has had the line or unit before.
PLACE = "doc_id long, high long, low long, chars long, words long"


def row_digest(doc_id: int | None, text: str) -> bytes:
    """What tells rows apart: rows that agree in doc_id and text (null counts as empty) are one document."""
    return hashlib.md5(f"{'' if doc_id is None else doc_id} {text}".encode(), usedforsecurity=False).digest()


def _row_digest(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


def unit_edges(words: Words) -> np.ndarray:
    """Where the units of a run of texts begin, counted in words, and the number of words."""
    n = len(words.hashes)
    raw = np.frombuffer(words.raw, np.uint8)
    line = np.searchsorted(np.flatnonzero(raw == 10), words.starts)
    after = raw[words.ends]
    ends = (words.hashes % np.uint64(CUT_EVERY) == 0) | (after == ord(".")) | (after == ord("!")) | (after == ord("?"))
    ends[:-1] |= line[1:] != line[:-1]
    ends[-1:] = True  # of the last text; others end in a newline
    edges = np.concatenate([[0], np.flatnonzero(ends) + 1])
    if np.diff(edges).max(initial=0) > LONGEST:
        edges = np.unique(np.concatenate([edges, *(np.arange(a, b, LONGEST) for a, b in zip(edges, edges[1:]) if b - a > LONGEST), [n]]))
    return edges


def _lines(words: Words) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Digests of all lines that have words, and the first word and the one after the last of each."""
    stops = np.flatnonzero(np.frombuffer(words.raw, np.uint8) == 10)
    edges = np.concatenate([[0], np.searchsorted(words.starts, stops)])
    full = np.flatnonzero(edges[1:] > edges[:-1])
    first, stop = edges[full], edges[full + 1]
    return [spans_hashed(words.hashes, first, stop), spans_hashed(mixed(words.hashes + np.uint64(0x9E3779B97F4A7C15)), first, stop)], first, stop


def _units(words: Words) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Digests of all units, each with the one before it in its text if any, and their words as in _lines."""
    edges = unit_edges(words)
    first, stop = edges[:-1], edges[1:]
    doc = np.searchsorted(words.edges, first, "right") - 1
    inside = np.append(False, doc[1:] == doc[:-1])
    prior = np.arange(len(doc)) - inside
    digest = spans_hashed(words.hashes, first, stop)
    return [mixed(digest + np.where(inside, mixed(digest[prior]), np.uint64(0)))], first[prior], stop


def _places(docs: DataFrame, keys: list[str], pieces: Callable[[Words], tuple[list[np.ndarray], np.ndarray, np.ndarray]]) -> DataFrame:
    """keys (digests) and the place of each piece of each document."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        once = {row_digest(i, t): (i, t) for i, t in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True)}
        rows = np.array([np.frombuffer(d, ">i8") for d in once], np.int64)
        doc_ids, texts = pa.array([i for i, _ in once.values()], pa.int64()), [t for _, t in once.values()]
        for at, some in text_runs(texts):
            words = Words(some)
            if not len(words.hashes):
                continue
            digests, first, stop = pieces(words)
            doc = np.searchsorted(words.edges, first, "right") - 1
            _, new = np.unique(digests[0] ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
            again = np.ones(len(doc), np.int64)
            again[new] = 0
            chars = np.concatenate([[0], np.cumsum((np.frombuffer(words.raw, np.uint8) & 0xC0) != 0x80)])
            start, end = chars[words.starts[first]] - chars[words.begins[doc]], chars[words.ends[stop - 1]] - chars[words.begins[doc]]
            place = {"doc_id": doc_ids.take(pa.array(doc + at)), "high": rows[doc + at, 0], "low": rows[doc + at, 1], "chars": start << 32 | end, "words": (first - words.edges[doc]) << 32 | (stop - first) << 1 | again}
            yield batch_of({k: d.view(np.int64) for k, d in zip(keys, digests, strict=True)} | place, {})

    return arrow_map(docs.select("doc_id", "text"), run, f"{', '.join(f'{k} long' for k in keys)}, {PLACE}")


def _repeats(shelf: Shelf, places: DataFrame, keys: list[str], name: str, touch: int) -> DataFrame:
    """The places that are not the first of their digest, with the doc_id of the first. touch: 1 if spans are to join
    places that only touch."""
    first = places.groupBy(*keys).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "low")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    known = shelf.put(first.select(*keys, F.col("first.doc_id").alias("first_doc"), F.col("first.low").alias("_low")), name, compression="zstd")
    again = F.col("words").bitwiseAND(F.lit(1)) == 1
    return places.join(known, keys).where(again | (F.col("low") != F.col("_low"))).select("high", "low", "chars", "words", "first_doc", F.lit(touch).alias("touch"))


def _spans(found: DataFrame, least_words: int) -> DataFrame:
    """(high, low, start, stop, n_words, first_doc) of the places found in each document, put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ["high", "low"]):
            high, low, chars, words, touch = (part.column(c).to_numpy() for c in ("high", "low", "chars", "words", "touch"))
            new = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))
            first = words >> 32
            stop = first + ((words & 0xFFFFFFFF) >> 1)
            apart = np.cumsum(new) << 33  # keeps the reach of one document out of the next
            reach = np.maximum.accumulate(stop + touch + apart)
            begins = np.flatnonzero(new | np.append(True, first[1:] + apart[1:] >= reach[:-1]))
            n_words = np.maximum.reduceat(stop, begins) - first[begins]
            keep = n_words >= least_words
            docs = [x if x is not None else 1 << 63 for x in part.column("first_doc").to_pylist()]
            least = [min(docs[a:b]) for a, b, k in zip(begins, [*begins[1:], len(docs)], keep) if k]
            at = begins[keep]
            yield batch_of({"high": high[at], "low": low[at], "start": np.minimum.reduceat(chars >> 32, begins)[keep], "stop": np.maximum.reduceat(chars & 0xFFFFFFFF, begins)[keep], "n_words": n_words[keep], "first_doc": [None if x == 1 << 63 else x for x in least]}, {"first_doc": pa.int64()})

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "high", "low").sortWithinPartitions("high", "low", F.shiftright("words", 32)).mapInArrow(run, "high long, low long, start long, stop long, n_words long, first_doc long")


def _row_spans(docs: DataFrame, least_words: int) -> DataFrame:
    """(digest, start, stop, n_words, first_doc) of each span, digest as _row_digest."""
    with Shelf(docs.sparkSession) as shelf:
        lines = shelf.put(_places(docs, ["d1", "d2"], _lines), "lines", compression="zstd")
        found = _repeats(shelf, lines, ["d1", "d2"], "known-lines", 1).unionByName(_repeats(shelf, _places(docs, ["d1"], _units), ["d1"], "known-units", 0))
        half = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
        return stored(_spans(found, least_words).select(F.concat(half("high"), half("low")).alias("digest"), "start", "stop", "n_words", "first_doc"), "spans", compression="zstd")


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, digest (hex; see row_digest), start, stop (characters of the original text), n_words and first_doc (the
    least doc_id that has a line or unit of the span) of each span to remove.

    Documents rank by doc_id, null last, and then by digest. Rows that repeat doc_id and text are one document: they
    have the same spans, once for each row, and don't repeat each other. Repeats inside a text count, whatever its
    rank. Null and empty texts and empty tables have no spans. Texts of any length are cut whole; other columns are
    not read. least_words = 1 gives every repeated line.
    """
    spans = _row_spans(docs, least_words)
    return docs.select("doc_id", _row_digest(docs["doc_id"], docs["text"]).alias("digest")).join(spans, "digest").select("doc_id", "digest", "start", "stop", "n_words", "first_doc")


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with repeated spans (see repeated_spans) taken out of text; no row is dropped.

    Null and empty texts, and all other columns, whatever their names, stay as they are; an empty table gives no rows.
    """
    spans = _row_spans(docs, least_words).groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    plain, back = renamed(docs)
    doc, text = (f"c{docs.columns.index(x)}" for x in ("doc_id", "text"))
    joined = plain.withColumn("own", _row_digest(F.col(doc), F.col(text))).join(spans, F.col("own") == F.col("digest"), "left").withColumn("whole", F.col(text))
    left = F.expr("""array_join(zip_with(concat(array(0L), transform(spans, s -> s.stop)), concat(transform(spans, s -> s.start), array(bigint(length(whole)))),
      (a, b) -> substring(whole, int(a + 1), int(b - a))), '')""")
    return back(joined.withColumn(text, F.when(F.col("spans").isNull(), F.col("whole")).otherwise(left)))
