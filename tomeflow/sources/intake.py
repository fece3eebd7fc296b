"""Books as they come in: validation columns, names that don't clash, and a stream of arriving files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What a request may ask for.
FORMATS, LANGUAGES, GENDERS = (".epub", ".fb2", ".pdf"), ("en", "ru"), ("female", "male")
#: The only format that has pages, and the longest stem of a stored name.
PAGED, STEM = ".pdf", 60


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, "(?<=[^/])(\\.[^./]*)$", 1))


def stem_of(name: Column) -> Column:
    return F.regexp_extract(name, "^(?:.*/)?([^/]+?)(\\.[^./]*)?$", 1)


def request_problem(name: Column, language: Column, gender: Column, pages: Column) -> Column:
    """Why a request is refused: format, language, gender, pages of a book that has none, a bad range; else null."""
    suffix, asked = suffix_of(name), F.length(T.strip(F.coalesce(pages, F.lit("")))) > 0
    refused = lambda what, value: F.concat(F.lit(f"{what} "), F.coalesce(value, F.lit("")), F.lit(" is not supported"))
    return (
        F.when(~F.coalesce(suffix.isin(*FORMATS), F.lit(False)), F.concat(refused("format", suffix), F.lit(f", known are: {', '.join(FORMATS)}")))
        .when(~F.coalesce(language.isin(*LANGUAGES), F.lit(False)), refused("language", language))
        .when(~F.coalesce(gender.isin(*GENDERS), F.lit(False)), refused("gender", gender))
        .when(asked & (suffix != PAGED), F.concat(suffix, F.lit(" has no pages, pick chapters after parsing")))
        .when(asked & T.page_range(pages).isNull(), F.concat(F.lit("bad page range: "), pages))
    )


def validated(requests: DataFrame) -> DataFrame:
    """requests (name, language, gender, pages) with problem."""
    return requests.withColumn("problem", request_problem(*(F.col(c) for c in ("name", "language", "gender", "pages"))))


def stored_names(requests: DataFrame, order: str) -> DataFrame:
    """requests (name) with stored_name: the stem, cut, and the suffix; repeats of it are numbered in order."""
    stem, suffix = F.substring(stem_of(F.col("name")), 1, STEM), suffix_of(F.col("name"))
    found = requests.withColumn("_stem", stem).withColumn("_suffix", suffix)
    k = F.row_number().over(Window.partitionBy("_stem", "_suffix").orderBy(order)) - 1
    name = F.concat("_stem", F.when(k > 0, F.concat(F.lit("-"), k.cast("string"))).otherwise(""), "_suffix")
    return found.withColumn("stored_name", name).drop("_stem", "_suffix")


def arriving(spark: SparkSession, folder: str, language: str = "ru", gender: str = "female") -> DataFrame:
    """A stream of the files that arrive in folder: path, name, length, content and problem (null: to be read)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    named = files.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    return named.select("path", "name", "length", "content", request_problem(F.col("name"), F.lit(language), F.lit(gender), F.lit("")).alias("problem"))
