"""Synthesis accounting: voices, the content-addressed cache, engines, timelines and file plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Default voices and the voices of engines.
DEFAULT_VOICES = [("ru", "female", "kseniya"), ("ru", "male", "eugene"), ("en", "female", "af_nova"), ("en", "male", "am_michael")]
GENDERS = {"aidar": "male", "baya": "female", "kseniya": "female", "eugene": "male", "xenia": "female"}
ENGINES = [("silero", "v5_5_ru", 24_000, 32.0, 900), ("silero", "v5_ru", 24_000, 32.0, 900), ("silero", "v5_cis_base", 24_000, 32.0, 700), ("kokoro", "mlx-community/Kokoro-82M-bf16", 24_000, 5.8, 800), ("fake", "1", 24_000, 60.0, 800)]
LANGUAGE_ENGINES = {"ru": "silero", "en": "kokoro"}
ATTEMPTS, REPORT_CHARS = 3, 200


def default_voices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_VOICES, "language string, gender string, voice string")


def engines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENGINES, "engine string, version string, sample_rate int, realtime double, max_chars int")


def engine_of(requests: DataFrame) -> DataFrame:
    """requests (language) with the engine that speaks it, its newest version and limits; null where none does."""
    spark = requests.sparkSession
    speakers = spark.createDataFrame(list(LANGUAGE_ENGINES.items()), "language string, engine string")
    first = engines(spark).withColumn("_k", F.monotonically_increasing_id()).groupBy("engine").agg(F.min_by(F.struct("version", "sample_rate", "realtime", "max_chars"), "_k").alias("_e"))
    return requests.join(F.broadcast(speakers.join(first, "engine").select("language", "engine", "_e.*")), "language", "left")


def missing_items(wanted: Column, present: Column) -> Column:
    """What of an array of wanted tools or columns is not there, in order."""
    return F.array_sort(F.array_except(wanted, present))


def labelled_voices(voices: DataFrame) -> DataFrame:
    """voices (language, engine, voice_idx, id) with label: language and a running number in it, as en_01."""
    number = F.row_number().over(Window.partitionBy("language").orderBy("engine", "voice_idx"))
    return voices.withColumn("label", F.concat(F.col("language"), F.lit("_"), F.when(number < 100, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))))


def trial_plan(voices: DataFrame, texts: DataFrame) -> DataFrame:
    """Every labelled voice with every sample text (language, text) of its language: the work list of a comparison."""
    return labelled_voices(voices).join(texts, "language").select("label", "language", "engine", "id", "text")


def progress_of(chunks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """chunks with done (1 to total, in order) and total of their job."""
    return chunks.withColumn("done", F.row_number().over(Window.partitionBy(key).orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(key)))


def destination(explicit: Column, default: Column) -> Column:
    """Where a finished book is copied to: the explicit folder, else a default that is not blank, else nowhere (null)."""
    return F.coalesce(explicit, F.nullif(T.strip(default), F.lit("")))


def write_report(report: DataFrame, folder: str) -> None:
    """A report as JSON lines, nulls included; nothing is written for an empty one."""
    if not report.isEmpty():
        report.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def voice_gender(voice: Column, engine: Column) -> Column:
    """By table; one engine writes the gender into the second letter of its ids; else unknown."""
    table = F.create_map(*(F.lit(x) for pair in GENDERS.items() for x in pair))
    letter = F.substring(voice, 2, 1)
    by_letter = F.when(letter == "f", "female").when(letter == "m", "male")
    return F.coalesce(F.when(engine == "kokoro", by_letter).otherwise(table[voice]), F.lit("unknown"))


def voice_language_code(voice: Column) -> Column:
    """The code of a voice id's first letter; null where it says no language."""
    return F.when(F.substring(voice, 1, 1).isin("a", "b"), F.substring(voice, 1, 1))


def with_default_voice(requests: DataFrame) -> DataFrame:
    """requests (language, gender) with the default voice; null where none is known."""
    return requests.join(F.broadcast(default_voices(requests.sparkSession)), ["language", "gender"], "left")


def pick_voice(jobs: DataFrame, voices: DataFrame) -> DataFrame:
    """jobs (engine, language, gender, voice) with chosen: the asked voice if the engine has it, else the
    default of language and gender, else the engine's first voice of that gender, else its first."""
    ordered = F.array_sort(F.collect_list(F.struct("voice_idx", "id", "gender")))
    have = voices.groupBy("engine").agg(ordered.alias("_all"))
    named = jobs.join(F.broadcast(default_voices(jobs.sparkSession).withColumnRenamed("voice", "_default")), ["language", "gender"], "left").join(have, "engine", "left")
    ids = F.transform("_all", lambda v: v["id"])
    same = F.filter("_all", lambda v: v["gender"] == F.col("gender"))
    known = lambda c: F.when(F.array_contains(ids, c), c)
    first = lambda a: F.get(a, F.lit(0))["id"]
    return named.withColumn("chosen", F.coalesce(known(F.col("voice")), known(F.col("_default")), first(same), first(F.col("_all")))).drop("_default", "_all")


def with_keys(chunks: DataFrame, voice: str, engine: str, version: str) -> DataFrame:
    return chunks.withColumn("key", T.cache_key(F.col("text"), F.lit(voice), F.lit(engine), F.lit(version)))


def misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct chunks that the cache lacks: the work list. A second run over the results is empty."""
    return keyed.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def cache_report(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """chunks, distinct, hits and misses; a repeated chunk hits what its first occurrence stores."""
    known = cache.select("key").distinct().withColumn("_hit", F.lit(True))
    each = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(known, "key", "left")
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count(F.lit(1)).alias("distinct_chunks"), F.count(F.when(F.col("_hit").isNull(), 1)).alias("misses")).withColumn("hits", F.col("chunks") - F.col("misses"))


class StubEngine:
    """Speaks at a fixed rate and makes no sound: duration only."""

    name, version, sample_rate, realtime, max_chars = "fake", "1", T.ENGINE_RATE, 60.0, 800

    def seconds(self, text: str) -> float:
        return (self.sample_rate * len(text) // T.CHARS_PER_SECOND) / self.sample_rate

    @staticmethod
    def seconds_column(text: Column) -> Column:
        """The same for a column: an engine that has this can't fail and stays in the JVM."""
        return T.speech_seconds(F.length(text))


def synthesize(work: DataFrame, make_engine: Callable[[], object] = StubEngine) -> DataFrame:
    """work (key, text) with seconds and status ('done' or 'failed').

    An engine that can speak columns does. Others are made once in each task; a chunk is tried ATTEMPTS times; then silence of the length that
    its text would take stands for it.
    """

    if "seconds_column" in getattr(make_engine, "__dict__", ()):
        return work.select("key", "text", make_engine.seconds_column(F.col("text")).alias("seconds"), F.lit("done").alias("status"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = None
        for batch in batches:
            engine = engine or make_engine()
            rows = []
            for key, text in zip(batch["key"], batch["text"]):
                status, seconds = "failed", round(len(text) / T.CHARS_PER_SECOND * T.ENGINE_RATE) / T.ENGINE_RATE
                for _ in range(ATTEMPTS):
                    try:
                        seconds, status = engine.seconds(text), "done"
                        break
                    except Exception:  # noqa: BLE001 - an engine may fail with anything
                        continue
                rows.append((key, text, seconds, status))
            yield pd.DataFrame(rows, columns=["key", "text", "seconds", "status"])

    return work.select("key", "text").mapInPandas(run, "key string, text string, seconds double, status string")


def failure_report(done: DataFrame) -> DataFrame:
    """One row with the count and the beginnings of failed chunks; none if nothing failed."""
    bad = done.where("status = 'failed'").agg(F.count(F.lit(1)).alias("failed"), F.array_sort(F.collect_list(F.substring("text", 1, REPORT_CHARS))).alias("chunks"))
    return bad.where("failed > 0")


def chapter_seconds(chunks: DataFrame) -> DataFrame:
    """Seconds of each chapter: its chunks, spoken by the stub engine, and their pauses."""
    return chunks.groupBy("book_id", "chapter_idx").agg(F.sum(T.speech_seconds(F.length("text")) + F.col("pause_after")).alias("seconds"), F.count(F.lit(1)).alias("n_chunks"))


def timeline(chapters: DataFrame) -> DataFrame:
    """chapters (book_id, chapter_idx, seconds) with start_ms and end_ms; each starts where the last ended."""
    w = Window.partitionBy("book_id").orderBy("chapter_idx").rowsBetween(Window.unboundedPreceding, 0)
    ms = F.bround(F.col("seconds") * 1000, 0).cast("long")
    return chapters.withColumn("end_ms", F.sum(ms).over(w)).withColumn("start_ms", F.col("end_ms") - ms)


def chapter_metadata(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """The metadata text of each book (book_id, title, author), from chapters with title and times."""
    entry = F.concat_ws("\n", F.lit("[CHAPTER]"), F.lit("TIMEBASE=1/1000"), F.concat(F.lit("START="), F.col("start_ms").cast("string")), F.concat(F.lit("END="), F.col("end_ms").cast("string")), F.concat(F.lit("title="), T.escape_metadata(F.col("title"))))
    entries = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_idx", entry.alias("text")))).alias("_all"))
    found = books.join(entries, "book_id")
    artist = F.when(F.length("author") > 0, F.concat(F.lit("artist="), T.escape_metadata(F.col("author"))))
    lines = F.concat_ws("\n", F.lit(";FFMETADATA1"), F.concat(F.lit("title="), T.escape_metadata(F.col("title"))), artist, F.lit("genre=Audiobook"), F.array_join(F.transform("_all", lambda x: x["text"]), "\n"))
    return found.select("book_id", F.concat(lines, F.lit("\n")).alias("metadata"))


def file_plan(chapters: DataFrame) -> DataFrame:
    """A numbered file name for each chapter."""
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_idx"))
    padded = F.when(number < 100, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))
    return chapters.withColumn("number", number).withColumn("file_name", F.concat(padded, F.lit(" "), T.safe_filename(F.col("title")), F.lit(".mp3")))


def joined_parts(parts: DataFrame, stored: DataFrame) -> DataFrame:
    """Per book: seconds of its parts (book_id, part_idx, key), how many are missing, and the first five."""
    known = stored.select("key", "seconds").dropDuplicates(["key"])
    found = parts.join(known, "key", "left")
    lost = F.array_sort(F.collect_list(F.when(F.col("seconds").isNull(), F.struct("part_idx", "key"))))
    return found.groupBy("book_id").agg(F.sum("seconds").alias("seconds"), F.count(F.when(F.col("seconds").isNull(), 1)).alias("missing"), F.transform(F.slice(lost, 1, 5), lambda x: x["key"]).alias("first_missing"))
