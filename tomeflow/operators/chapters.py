"""Chapters: by font, by bookmarks, by table of contents with anchors; selections of them.

Matching contents to blocks moves a cursor forward only and skips what it can't find, so each match depends
on the one before: a fold in one grouped Arrow UDF per book, over no more than a book's own rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

HEADING_FONT, HEADING_LENGTH = 1.15, 120


def _in_order():
    return Window.partitionBy("book_id").orderBy("block_no")


def is_heading(median: Column) -> Column:
    return (F.col("font_size") >= median * HEADING_FONT) & (F.length("text") <= HEADING_LENGTH)


def by_font(blocks: DataFrame, language: str = "en") -> DataFrame:
    """blocks (book_id, block_no, text, page, font_size) with kind, chapter_idx and chapter_title.

    A heading begins a chapter; text before the first one is an untitled chapter.
    """
    median = F.percentile("font_size", F.lit(0.5), F.length("text")).over(Window.partitionBy("book_id"))
    df = blocks.withColumn("kind", F.when(is_heading(median), "heading").otherwise("paragraph"))
    df = df.withColumn("_run", F.count(F.when(F.col("kind") == "heading", 1)).over(_in_order()))
    first = F.min("_run").over(Window.partitionBy("book_id"))
    title = F.first(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(Window.partitionBy("book_id", "_run"))
    return df.withColumn("chapter_idx", (F.col("_run") - first).cast("int")).withColumn("chapter_title", F.coalesce(title, F.lit(T.UNTITLED[language]))).drop("_run")


def cut_at_marks(blocks: DataFrame, marks: DataFrame, language: str = "en") -> DataFrame:
    """blocks cut at marks (book_id, block_no, title, is_heading): a chapter runs to the next mark.

    Blocks before the first mark are the opening chapter.
    """
    df = blocks.join(marks.select("book_id", "block_no", F.col("title").alias("_title"), F.col("is_heading").alias("_head")), ["book_id", "block_no"], "left")
    df = df.withColumn("_run", F.count("_title").over(_in_order()))
    base = F.min("_run").over(Window.partitionBy("book_id"))
    title = F.first("_title", ignorenulls=True).over(Window.partitionBy("book_id", "_run"))
    kind = F.when(F.coalesce("_head", F.lit(False)), "heading").otherwise("paragraph")
    return df.withColumn("kind", kind).withColumn("chapter_title", F.coalesce(title, F.lit(T.OPENING[language]))).withColumn("chapter_idx", (F.col("_run") - base).cast("int")).drop("_title", "_head", "_run")


def bookmark_marks(blocks: DataFrame, toc: DataFrame) -> DataFrame:
    """Marks for toc (book_id, toc_idx, title, page): the block with the title on its page after the last
    mark, else the first block there of that page or a later one. Titles are repaired as block texts are.
    """
    entries = toc.select("book_id", F.lit(1).alias("_kind"), F.col("toc_idx").alias("_no"), F.trim(T.clean_text(F.col("title"))).alias("_key"), F.col("page").alias("_page"), F.col("title").alias("_title"))
    rows = blocks.select("book_id", F.lit(0).alias("_kind"), F.col("block_no").alias("_no"), F.trim(F.col("text")).alias("_key"), F.col("page").alias("_page"), F.lit("").alias("_title"))

    def match(book: pd.DataFrame) -> pd.DataFrame:
        own = book[book["_kind"] == 0].sort_values("_no")
        found, at = [], 0
        numbers, pages = own["_no"].tolist(), own["_page"].tolist()
        exact: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(pages, own["_key"].tolist())):
            exact.setdefault(key, []).append(k)
        for e in book[book["_kind"] == 1].sort_values("_no").itertuples():
            here = next((k for k in exact.get((e._5, e._4), ()) if k >= at), None)
            k = here if here is not None else next((k for k in range(at, len(pages)) if pages[k] >= e._5), None)
            if k is not None:
                found.append((e.book_id, numbers[k], e._6, here is not None))
                at = k + 1
        return pd.DataFrame(found, columns=["book_id", "block_no", "title", "is_heading"])

    both = rows.unionByName(entries)
    return both.groupBy("book_id").applyInPandas(match, f"book_id {both.schema['book_id'].dataType.simpleString()}, block_no int, title string, is_heading boolean")


def anchor_marks(pieces: DataFrame, toc: DataFrame) -> DataFrame:
    """Marks for toc (book_id, toc_idx, title, document, anchor) on pieces (book_id, block_no, document,
    anchors): the first piece after the last mark of that document that has the anchor, if one is named."""
    entries = toc.select("book_id", F.lit(1).alias("side"), F.col("toc_idx").alias("no"), "document", F.array(F.coalesce("anchor", F.lit(""))).alias("anchors"), "title")
    rows = pieces.select("book_id", F.lit(0).alias("side"), F.col("block_no").alias("no"), "document", "anchors", F.lit("").alias("title"))

    def match(book: pd.DataFrame) -> pd.DataFrame:
        own = list(book[book["side"] == 0].sort_values("no").itertuples())
        found, at = [], 0
        for e in book[book["side"] == 1].sort_values("no").itertuples():
            anchor = e.anchors[0]
            k = next((k for k in range(at, len(own)) if own[k].document == e.document and (not anchor or anchor in own[k].anchors)), None)
            if k is not None:
                found.append((e.book_id, own[k].no, e.title, False))
                at = k + 1
        return pd.DataFrame(found, columns=["book_id", "block_no", "title", "is_heading"])

    both = rows.unionByName(entries)
    return both.groupBy("book_id").applyInPandas(match, f"book_id {both.schema['book_id'].dataType.simpleString()}, block_no int, title string, is_heading boolean")


def without_endnotes(pieces: DataFrame, toc: DataFrame) -> DataFrame:
    """Pieces but those of documents outside the contents whose first paragraph is a bare number."""
    first = F.first("text").over(Window.partitionBy("book_id", "document").orderBy("block_no"))
    listed = toc.select("book_id", "document").distinct().withColumn("_listed", F.lit(True))
    df = pieces.withColumn("_first", first).join(listed, ["book_id", "document"], "left")
    return df.where(F.col("_listed").isNotNull() | ~T.is_bare_number(F.col("_first"))).drop("_first", "_listed")


def select_chapters(blocks: DataFrame, wanted: list[int]) -> DataFrame:
    """Blocks of the wanted chapters, renumbered in the order asked for; numbers out of range are ignored."""
    picks = blocks.sparkSession.createDataFrame([(c, i) for i, c in enumerate(wanted)], "chapter_idx int, _new int")
    return blocks.join(F.broadcast(picks), "chapter_idx").drop("chapter_idx").withColumnRenamed("_new", "chapter_idx")


def char_counts(blocks: DataFrame) -> DataFrame:
    """Characters, minutes of speech and short title of each chapter, numbered from 1."""
    found = blocks.groupBy("book_id", "chapter_idx").agg(F.min("chapter_title").alias("title"), F.sum(F.length("text")).alias("chars"))
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_idx"))
    return found.select("book_id", number.alias("number"), F.substring("title", 1, 60).alias("title"), "chars", F.bround(F.col("chars") / T.CHARS_PER_SECOND / 60, 1).alias("minutes"))
