"""Speech chunks: sentences packed to a limit, with pauses.

Splitting and packing are higher-order functions over a paragraph's own text: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LIMIT = 800
INSIDE, BETWEEN, AFTER_CHAPTER = 0.25, 0.7, 1.5


def sentences(c: Column) -> Column:
    """The sentences of a paragraph: cut after a terminal mark and white space."""
    parts = F.transform(F.split(c, "(?<=[.!?…])(?U)[\\s\\x1c-\\x1f]+", -1), T.strip)
    return F.filter(parts, lambda s: F.length(s) > 0)


def pack(pieces: Column, limit: int) -> Column:
    """Pieces joined by spaces into lines of at most limit, where the pieces allow it."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc: Column, piece: Column) -> Column:
        joined = F.when(F.length(acc["cur"]) > 0, F.concat(acc["cur"], F.lit(" "), piece)).otherwise(piece)
        full = (F.length(acc["cur"]) > 0) & (F.length(joined) > limit)
        return F.struct(F.when(full, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]).alias("out"), F.when(full, piece).otherwise(joined).alias("cur"))

    return F.aggregate(pieces, start, step, lambda acc: F.when(F.length(acc["cur"]) > 0, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]))


def _hard_cut(s: Column, limit: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(s) - 1) / limit), F.lit(0)).cast("int"))
    return F.transform(starts, lambda i: F.substring(s, i * limit + 1, F.lit(limit)))


def split_long(s: Column, limit: int) -> Column:
    """A sentence cut to the limit: at semicolons, else commas, else spaces, else anywhere.

    What is still too long after one separator has none of it left, so it goes on to the next.
    """

    def at(s: Column, separator: str, mark: str, following) -> Column:
        parts = F.split(s, separator, -1)
        marked = F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit(mark))).otherwise(p))
        packed = F.flatten(F.transform(pack(marked, limit), lambda line: F.when(F.length(line) <= limit, F.array(line)).otherwise(following(line))))
        return F.when(F.length(s) <= limit, F.array(s)).when(F.contains(s, F.lit(separator)), packed).otherwise(following(s))

    hard = lambda s: _hard_cut(s, limit)
    space = lambda s: at(s, " ", "", hard)
    comma = lambda s: at(s, ", ", ",", space)
    return at(s, "; ", ";", comma)


def packed_sentences(said: Column, n_chars: Column, limit: int = LIMIT) -> Column:
    """The sentences of a paragraph of n_chars as lines of at most limit characters, none broken without need."""
    long = F.exists(said, lambda s: F.length(s) > limit)
    pieces = F.when(long, F.flatten(F.transform(said, lambda s: split_long(s, limit)))).otherwise(said)
    whole = F.filter(F.array(F.array_join(said, " ")), lambda s: F.length(s) > 0)
    return F.when(n_chars <= limit, whole).otherwise(pack(pieces, limit))


def sample_chunk(text: Column, least: int = 200, limit: int = 600) -> Column:
    """The first chunk of the first line of text that is long enough for a sample; null if none is."""
    paragraph = F.get(F.filter(F.split(text, "\n", -1), lambda x: F.length(x) >= least), F.lit(0))
    return F.get(F.filter(packed_sentences(sentences(paragraph), F.length(paragraph), limit), T.is_speakable), F.lit(0))


def announced(blocks: DataFrame) -> DataFrame:
    """(book_id, chapter_idx, block_idx, text) of doc_blocks (with chapter_title and kind), each chapter's title in
    front at block_idx -1, unless its first block is that heading."""
    first = F.min_by(F.struct("kind", "text"), "block_idx")
    chapters = blocks.groupBy("book_id", "chapter_idx").agg(F.min("chapter_title").alias("text"), first.alias("_first"))
    missing = chapters.where((F.length("text") > 0) & ~((F.col("_first.kind") == "heading") & (F.col("_first.text") == F.col("text"))))
    titles = missing.select("book_id", "chapter_idx", F.lit(-1).alias("block_idx"), "text")
    return blocks.select("book_id", "chapter_idx", "block_idx", "text").unionByName(titles)


def chunks(texts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Chunks of texts (book_id, chapter_idx, block_idx, text): piece_idx, text and pause_after.

    Texts that name their chapter (chapter_title, kind) have titles announced first. Pauses are set before pieces
    without letters or digits fall out; texts without any are no paragraphs.
    """
    if {"chapter_title", "kind"} <= set(texts.columns):
        texts = announced(texts)
    spoken = texts.where(T.is_speakable(F.col("text")))
    last = F.lead("block_idx").over(Window.partitionBy("book_id", "chapter_idx").orderBy("block_idx")).isNull()
    said = spoken.select("book_id", "chapter_idx", "block_idx", last.alias("_last"), F.length("text").alias("_chars"), sentences(F.col("text")).alias("_said"))
    cut = said.withColumn("_pieces", packed_sentences(F.col("_said"), F.col("_chars"), limit))
    rows = cut.select("book_id", "chapter_idx", "block_idx", "_last", F.size("_pieces").alias("_n"), F.posexplode("_pieces").alias("piece_idx", "text"))
    pause = F.when(F.col("piece_idx") < F.col("_n") - 1, INSIDE).when(F.col("_last"), AFTER_CHAPTER).otherwise(BETWEEN)
    return rows.withColumn("pause_after", pause).where(T.is_speakable(F.col("text"))).drop("_last", "_n")
