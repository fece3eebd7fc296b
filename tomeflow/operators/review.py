"""Review of extracted chapters: estimates, warnings, and the document that a review leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

REVIEW = "array<struct<title:string,text:string,include:boolean>>"


def review_entries(blocks: DataFrame) -> DataFrame:
    """One row a chapter: title and its blocks' texts joined by blank lines."""
    ordered = F.array_sort(F.collect_list(F.struct("block_idx", "text")))
    return blocks.groupBy("book_id", "chapter_idx").agg(F.min("chapter_title").alias("title"), F.array_join(F.transform(ordered, lambda b: b["text"]), "\n\n").alias("text"))


def review_json(entries: DataFrame) -> DataFrame:
    """The review of each book as JSON, all chapters included."""
    item = F.struct("chapter_idx", F.struct("title", "text", F.lit(True).alias("include")).alias("entry"))
    return entries.groupBy("book_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["entry"])).alias("review"))


def document_from_review(reviews: DataFrame) -> DataFrame:
    """doc_blocks of reviews (book_id, review): included chapters with text, cut at blank lines."""
    entries = reviews.select("book_id", F.posexplode(F.from_json("review", REVIEW)).alias("chapter_idx", "e"))
    kept = entries.where(F.coalesce("e.include", F.lit(True)) & (F.length(T.strip(F.coalesce("e.text", F.lit("")))) > 0))
    parts = F.filter(F.transform(F.split("e.text", "\n\n", -1), T.strip), lambda p: F.length(p) > 0)
    return kept.select("book_id", "chapter_idx", F.col("e.title").alias("chapter_title"), F.posexplode(parts).alias("block_idx", "text")).withColumn("kind", F.lit("paragraph"))


def estimates(chars: DataFrame, by: list[str], realtime: float) -> DataFrame:
    """chars, minutes of speech and minutes of synthesis for rows (n_chars, include) grouped by `by`."""
    total = F.coalesce(F.sum(F.when(F.coalesce("include", F.lit(True)), F.col("n_chars"))), F.lit(0))
    found = chars.groupBy(*by).agg(total.alias("chars"))
    minutes = F.col("chars") / T.CHARS_PER_SECOND / 60
    return found.withColumn("speech_minutes", F.bround(minutes, 1)).withColumn("synth_minutes", F.bround(minutes / realtime, 1)).withColumn("disk_bytes", T.wav_bytes(F.col("chars")))
