"""A training corpus from documents: classified, deduplicated, decontaminated, encoded.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with the columns of documents;
the last gives the encoding of what is left. Stages are written as Parquet and read again in between.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tomeflow.llm import bpe, decontaminate, line_dedup, minhash, quality
from tomeflow.llm._common import drop_stored, stored_at, table


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject; see quality.kept_documents for nulls, ties and names."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one exactly or nearly; see line_dedup.without_repeated_lines."""
    return line_dedup.without_repeated_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; see minhash.first_of_each_group."""
    return minhash.first_of_each_group(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate; see decontaminate.decontaminated."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them; see bpe.round_trip."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", classified),
    ("line_dedup", lines_once),
    ("near_dedup", one_of_each),
    ("decontaminate", unseen),
    ("bpe", encoded),
]
#: Co-training, signatures and merges can't be put in SQL; tests/llm/test_pipeline.py holds each stage against its rule.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of sf_dir; a stage's table goes when the next one stands."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored_at(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            drop_stored(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
