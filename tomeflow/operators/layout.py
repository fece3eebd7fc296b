"""Cleaning laid-out pages: guarded drop rules, reading order, paragraphs, and the report.

Every book is one shuffle: rows are dealt by book_id once, and all windows (book; book and page) keep that
prefix. Rules run one after another on what is left, each with a guard that undoes it on pages where it
would keep too little.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Thresholds of the rules.
EDGE_BAND, RUNNING_SHARE, MAX_DROP_SHARE = 0.12, 0.3, 0.6
SMALL_FONT, FOOTNOTE_BAND = 0.92, 0.75
NOISE_SHARE, NOISE_LENGTH, NUMERIC_SHARE = 0.30, 40, 0.6
FONT_TOLERANCE, MERGED_LENGTH = 0.6, 5000
COLUMN_TOLERANCE, COLUMN_BLOCKS, FULL_WIDTH = 0.04, 3, 0.7
RULES = ("running_heads", "page_numbers", "figure_captions", "listings", "numeric_captions", "footnotes")
RULE_LABELS = {"running_heads": "running heads", "page_numbers": "page numbers", "figure_captions": "figure captions", "listings": "listings and tables", "numeric_captions": "numeric captions", "footnotes": "footnotes"}


def _book():
    return Window.partitionBy("book_id")


def _page():
    return Window.partitionBy("book_id", "page")


def with_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with width and height of their page, the book's page count and its median font size.

    The median weighs each font size by the length of its text.
    """
    sized = pages.withColumn("n_pages", F.count(F.lit(1)).over(_book()))
    joined = blocks.repartition("book_id").join(sized, ["book_id", "page"])
    return joined.withColumn("median_font", F.percentile("font_size", F.lit(0.5), F.length("text")).over(_book()))


def weighted_median(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("book_id").agg(F.percentile("font_size", F.lit(0.5), F.length("text")).alias("median_font"))


def in_edge_band() -> Column:
    band = F.col("height") * EDGE_BAND
    return (F.col("y0") < band) | (F.col("y0") > F.col("height") - band)


def _small() -> Column:
    return F.col("font_size") < F.col("median_font") * SMALL_FONT


def rule_columns() -> dict[str, Column]:
    """Whether each rule would drop a row; running heads rely on column `_form_pages`."""
    text = F.col("text")
    noise = T.non_alpha_share(text)
    return {
        "running_heads": in_edge_band() & (F.col("_form_pages") >= F.greatest(F.lit(2.0), F.col("n_pages") * RUNNING_SHARE)),
        "page_numbers": in_edge_band() & T.looks_like_page_number(text),
        "figure_captions": T.has_figure_marker(text),
        "listings": (F.length(text) >= NOISE_LENGTH) & (noise > NOISE_SHARE),
        "numeric_captions": _small() & (noise > NUMERIC_SHARE),
        "footnotes": _small() & (F.col("y0") > F.col("height") * FOOTNOTE_BAND) & T.starts_like_footnote(text),
    }


def guarded(df: DataFrame, name: str, drop: Column) -> DataFrame:
    """Marks rows in dropped_by, among those not marked, unless the page would keep less than its share."""
    alive = F.col("dropped_by").isNull()
    df = df.withColumn("_drop", alive & drop)
    total = F.count(F.when(alive, 1)).over(_page())
    kept = F.count(F.when(alive & ~F.col("_drop"), 1)).over(_page())
    spared = kept < total * (1 - MAX_DROP_SHARE)
    return df.withColumn("_drop", F.col("_drop") & ~spared).withColumn("dropped_by", F.when(F.col("_drop"), F.lit(name)).otherwise(F.col("dropped_by"))).drop("_drop")


def tag_dropped(blocks: DataFrame, pages: DataFrame, only: tuple[str, ...] = RULES, rules: Callable[[], dict[str, Column]] = rule_columns) -> DataFrame:
    """Blocks with dropped_by: the first rule that drops them, or null."""
    df = with_pages(blocks, pages).withColumn("dropped_by", F.lit(None).cast("string"))
    df = df.withColumn("_form", F.when(in_edge_band(), T.matching_form(F.col("text"))))
    forms = Window.partitionBy("book_id", "_form")
    df = df.withColumn("_form_pages", F.size(F.collect_set(F.when(F.col("_form").isNotNull(), F.col("page"))).over(forms)))
    columns = rules()
    for name in only:
        df = guarded(df, name, columns[name])
    return df.drop("_form", "_form_pages")


def column_count() -> Column:
    """Over the rows of a page: 2 if both sides have enough blocks that don't span the page, else 1."""
    middle, tolerance = F.col("width") / 2, F.col("width") * COLUMN_TOLERANCE
    narrow = F.col("x1") - F.col("x0") < F.col("width") * FULL_WIDTH
    is_left = F.col("x1") <= middle + tolerance
    left = F.count(F.when(narrow & is_left, 1)).over(_page())
    right = F.count(F.when(narrow & ~is_left & (F.col("x0") >= middle - tolerance), 1)).over(_page())
    return F.when((left >= COLUMN_BLOCKS) & (right >= COLUMN_BLOCKS), 2).otherwise(1)


def column_of() -> Column:
    spans = F.col("x1") - F.col("x0") >= F.col("width") * FULL_WIDTH
    return F.when(spans, 0).when(F.col("x0") >= F.col("width") / 2 - F.col("width") * COLUMN_TOLERANCE, 1).otherwise(0)


def reading_order(df: DataFrame) -> DataFrame:
    """Adds n_columns and order_no, the place of a block in its page's reading order from 1."""
    df = df.withColumn("n_columns", column_count())
    by = Window.partitionBy("book_id", "page").orderBy(F.when(F.col("n_columns") == 2, column_of()).otherwise(0), F.bround("y0", 1), "x0", "seq")
    return df.withColumn("order_no", F.row_number().over(by))


def _runs(df: DataFrame, *more: Column) -> DataFrame:
    """(book_id, _run, _merged, more) of blocks in reading order; rows with _gone count in more only.

    _merged: the paragraphs of a run, as merge_continuations says.
    """
    item = "struct<text:string,page:int,font:double>"
    w = Window.partitionBy("book_id").orderBy("_gone", "page", "order_no")
    ended = F.lag(~T.is_open(F.col("text"))).over(w)
    df = df.withColumn("_ended", F.coalesce(ended, F.lit(False)).cast("int")).withColumn("_run", F.sum("_ended").over(w))
    block = F.struct("page", "order_no", "text", F.col("font_size").cast("double").alias("font"))
    books = df.groupBy("book_id", "_run").agg(F.array_sort(F.collect_list(F.when(~F.col("_gone"), block))).alias("_blocks"), *more)
    open_ = f"not regexp_like(a.cur.text, '{T.TERMINAL_CLASS}(?U)[\\\\s\\\\x1c-\\\\x1f]*$')"
    fold = f"""aggregate(_blocks,
      struct(cast(array() as array<{item}>) as done, cast(null as {item}) as cur),
      (a, b) -> if(a.cur is null,
        struct(a.done as done, struct(b.text as text, b.page as page, b.font as font) as cur),
        if({open_} and abs(a.cur.font - b.font) <= {FONT_TOLERANCE}D and length(a.cur.text) + 1 + length(b.text) <= {MERGED_LENGTH},
          struct(a.done as done, struct(concat(a.cur.text, ' ', b.text) as text, a.cur.page as page, a.cur.font as font) as cur),
          struct(concat(a.done, array(a.cur)) as done, struct(b.text as text, b.page as page, b.font as font) as cur))),
      a -> if(a.cur is null, a.done, concat(a.done, array(a.cur))))"""
    return books.withColumn("_merged", F.expr(fold)).drop("_blocks")


def merge_continuations(df: DataFrame) -> DataFrame:
    """Paragraphs of each book: (book_id, block_no, text, page, font_size).

    A block joins the one before if that is open (no terminal mark), the fonts agree with the first block
    of the paragraph and the text stays short enough. After a block with a terminal mark a new paragraph
    begins whatever came before, so a book falls into runs between such marks; only inside a run does what
    came before decide, by a fold over its few blocks.
    """
    merged = _runs(df.withColumn("_gone", F.lit(False))).select("book_id", "_run", F.posexplode("_merged").alias("_k", "b"))
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("_run", "_k")) - 1
    return merged.select("book_id", number.alias("block_no"), F.col("b.text").alias("text"), F.col("b.page").alias("page"), F.col("b.font").alias("font_size"))


def cleaned_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """All rules, reading order, paragraphs and text repair; blocks that end up empty are gone."""
    alive = tag_dropped(blocks, pages).where("dropped_by is null")
    merged = merge_continuations(reading_order(alive))
    return merged.withColumn("text", T.clean_text(F.col("text"))).where(F.length("text") > 0)


def clean_report(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a book: a count for each rule, kept, chars_before, chars_after and summary.

    Blocks that rules drop stay in the rows, without a place on the page, so one pass counts them and puts the
    others together.
    """
    gone = F.col("dropped_by").isNotNull()
    tagged = tag_dropped(blocks, pages).withColumn("_gone", gone).withColumns({c: F.when(~gone, F.col(c)) for c in ("x0", "x1")})
    counts = [F.count(F.when(F.col("dropped_by") == r, 1)).alias(r) for r in RULES]
    runs = _runs(reading_order(tagged), *counts, F.sum(F.length("text")).alias("chars_before"))
    chars = F.filter(F.transform("_merged", lambda b: F.length(T.clean_text(b["text"]))), lambda n: n > 0)
    runs = runs.withColumn("_chars", chars).withColumn("kept", F.size("_chars")).withColumn("chars_after", F.aggregate("_chars", F.lit(0).cast("long"), lambda a, n: a + n))
    both = runs.groupBy("book_id").agg(*(F.sum(c).alias(c) for c in (*RULES, "chars_before", "kept", "chars_after")))
    said = F.array_join(F.filter(F.array(*(F.when(F.col(r) > 0, F.concat(F.lit(RULE_LABELS[r] + " "), F.col(r).cast("string"))) for r in RULES)), lambda x: x.isNotNull()), ", ")
    loss = F.concat(T.one_decimal((1 - F.col("chars_after") / F.nullif(F.col("chars_before"), F.lit(0))) * 100), F.lit("%"))
    tail = F.when(F.length(said) > 0, F.concat(F.lit(": "), said)).otherwise("")
    return both.withColumn("summary", F.when(F.col("chars_before") == 0, "nothing to clean").otherwise(F.concat(F.lit("cleaning removed "), loss, F.lit(" of the characters"), tail)))


def text_layer(blocks: DataFrame, pages: DataFrame, least: int = 100) -> DataFrame:
    """Characters a page of each book, and whether that is enough to be text and not a scan."""
    chars = blocks.groupBy("book_id").agg(F.sum(F.length("text")).alias("chars"))
    sizes = pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages"))
    per = F.coalesce("chars", F.lit(0)) / F.greatest(F.lit(1), F.col("n_pages"))
    return sizes.join(chars, "book_id", "left").select("book_id", "n_pages", per.alias("chars_per_page"), (per >= least).alias("has_text_layer"))


def text_problems(layer: DataFrame, report: DataFrame) -> DataFrame:
    """book_id and problem of text_layer and clean_report rows: no text layer, nothing left after cleaning, or null."""
    said = F.when(~F.col("has_text_layer"), F.format_string("no text layer (%.0f characters per page)", F.bround("chars_per_page", 0))).when(F.coalesce("kept", F.lit(0)) == 0, F.lit("no text was left after cleaning"))
    return layer.join(report.select("book_id", "kept"), "book_id", "left").select("book_id", said.alias("problem"))
