"""Laid-out pages: tables of blocks, pages, contents and books; and a layout derived from plain documents.

raw_blocks: book_id, page, seq, text, font_size, x0, y0, x1, y1, is_mono; raw_pages: book_id, page, width,
height; toc: book_id, toc_idx, title, page; books: book_id, path, title, author. Pages are a table of their own,
since pages without blocks count in thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 600.0, 800.0


def page_selection(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of pages first..last (from 1, inclusive); the filter reaches the scan."""
    if first < 1 or first > last:
        raise ValueError(f"bad page range: {first}-{last}")
    return rows.where(F.col("page").between(first, last))


def range_problems(pages: DataFrame, last: int) -> DataFrame:
    """book_id, n_pages and problem (null if the book has page `last`) of each book."""
    sizes = pages.groupBy("book_id").agg(F.max("page").cast("long").alias("n_pages"))
    said = F.concat(F.lit(f"page {last} is past the end, the document has "), F.col("n_pages").cast("string"))
    return sizes.withColumn("problem", F.when(F.col("n_pages") < last, said))


def toc_of_pages(toc: DataFrame, first: int, last: int | None = None, rebased: bool = False) -> DataFrame:
    """Entries of contents from page first on, up to page last if there is one; rebased numbers pages from first."""
    kept = toc.where(F.col("page") >= first if last is None else F.col("page").between(first, last))
    return kept.withColumn("page", F.col("page") - first + 1) if rebased else kept


def cut_pages(blocks: DataFrame, pages: DataFrame, toc: DataFrame, first: int, last: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A clipping of pages first..last with page numbers and contents of its own."""
    renumbered = [page_selection(x, first, last).withColumn("page", F.col("page") - first + 1) for x in (blocks, pages)]
    return *renumbered, toc_of_pages(toc, first, last, rebased=True)


def titled(books: DataFrame) -> DataFrame:
    """books with the file's name for a missing title and null for an empty author."""
    stem = F.regexp_extract("path", "([^/]*?)(\\.[^./]+)?$", 1)
    return books.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), stem)).withColumn("author", F.nullif("author", F.lit("")))


def read_layout(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(raw_blocks, raw_pages, toc, books) of a folder of Parquet tables, of pages first..last if given.

    raw_blocks may have lines (see block_text) in place of text, font_size and is_mono. Only the pages asked for are
    read; a book without page `last` makes the pages fail when they are, with range_problems' words.
    """
    blocks, pages, toc, books = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("raw_blocks", "raw_pages", "toc", "books"))
    if first is not None:
        last = first if last is None else last
        short = range_problems(pages, last).where("problem is not null").select("book_id", "problem")
        pages = page_selection(pages, first, last).join(short, "book_id", "left").where(F.coalesce(F.assert_true(F.col("problem").isNull(), F.col("problem")).cast("boolean"), F.lit(True))).drop("problem")
        blocks, toc = page_selection(blocks, first, last), toc_of_pages(toc, first)
    if "lines" in blocks.columns:
        blocks = from_lines(blocks)
    return blocks, pages, toc, titled(books)


def from_lines(raw: DataFrame) -> DataFrame:
    """raw_blocks of rows with lines; blocks without text are gone."""
    lines = F.col("lines")
    found = raw.withColumns({"text": block_text(lines), "font_size": block_font_size(lines), "is_mono": block_is_mono(lines)})
    return found.where(F.length("text") > 0).drop("lines")


def block_text(lines: Column) -> Column:
    """Text of array<struct<spans: array<struct<text, size, flags>>>>: spans flush, lines spaced."""
    joined = F.array_join(F.transform(lines, lambda line: F.array_join(line["spans"]["text"], "")), " ")
    return F.trim(F.regexp_replace(joined, "(?U)[\\s\\x1c-\\x1f]+", " "))


def block_font_size(lines: Column) -> Column:
    return F.coalesce(F.array_max(F.flatten(F.transform(lines, lambda line: line["spans"]["size"]))), F.lit(0.0))


def block_is_mono(lines: Column) -> Column:
    flags = F.flatten(F.transform(lines, lambda line: line["spans"]["flags"]))
    return (F.size(flags) > 0) & F.forall(flags, lambda x: x.bitwiseAND(F.lit(8)) != 0)


def synthetic_layout(docs: DataFrame, columns: int = 1) -> tuple[DataFrame, DataFrame]:
    """(raw_blocks, raw_pages) derived from documents by arithmetic alone.

    Each non-blank line is a body block, four to a page (eight in two columns); pages also get a running
    head, and some of them a page number, captions and a footnote.
    """
    per = 4 * columns
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x)) > 0)
    body = docs.where(F.size(lines) > 0).select(F.col("doc_id").alias("book_id"), "source", F.posexplode(lines).alias("i", "text"))
    slot = F.col("i") % per
    row = (slot / columns).cast("int")
    side = slot % columns
    left = F.when(side == 0, 50.0).otherwise(320.0)
    right = F.when(side == 0, 550.0 if columns == 1 else 280.0).otherwise(550.0)
    size = F.when((slot == 0) & (F.length("text") <= 120), 16.0).otherwise(12.0)
    blocks = body.select("book_id", (F.col("i") / per).cast("int").alias("_p"), slot.alias("seq"), "text", size.alias("font_size"), left.alias("x0"), (row * 140 + 110.0).alias("y0"), right.alias("x1"), "source")
    blocks = blocks.withColumn("page", F.col("_p") + 1).drop("_p")
    pages = docs.where(F.size(lines) > 0).select(F.col("doc_id").alias("book_id"), "source", F.explode(F.sequence(F.lit(1), F.ceil(F.size(lines) / per).cast("int"))).alias("page"))
    p = F.col("page")
    extra = [
        (F.lit(True), F.concat("source", F.lit(" · "), p.cast("string")), 10.0, 20.0),
        (p % 4 == 0, p.cast("string"), 10.0, 770.0),
        (p % 2 == 0, F.lit("\x02 caption"), 9.0, 640.0),
        (p % 5 == 0, F.lit("1160 - 1170"), 9.0, 660.0),
        (p % 3 == 0, F.lit("1. note"), 9.0, 680.0),
    ]
    items = F.filter(F.array(*(F.when(when, F.struct(F.lit(per + k).alias("seq"), text.alias("text"), F.lit(size).alias("font_size"), F.lit(top).alias("y0"))) for k, (when, text, size, top) in enumerate(extra))), lambda x: x.isNotNull())
    added = pages.select("book_id", "page", F.explode(items).alias("b")).select("book_id", "page", "b.seq", "b.text", "b.font_size", F.lit(50.0).alias("x0"), "b.y0", F.lit(550.0).alias("x1"))
    order = ["book_id", "page", "seq", "text", "font_size", "x0", "y0", "x1"]
    both = blocks.select(*order).unionByName(added.select(*order)).withColumn("y1", F.col("y0") + 12).withColumn("is_mono", F.lit(False))
    return both, pages.select("book_id", "page", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
