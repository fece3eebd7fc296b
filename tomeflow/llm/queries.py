"""The registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, line_dedup, media, minhash, quality, sharding, substring_dedup, token_counts, token_store
from ._common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = token_store.write_store(docs, _tokenizer("word_bpe_49k.json"))
    return token_store.read_back(spark, at)


def op2_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("digest")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_size(table(spark, sf_dir, "documents"), 16)


def op5_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_features(table(spark, sf_dir, "documents"))


def op6_bag_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("digest")


def op7_unit_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("digest")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.stored_index(table(spark, sf_dir, "documents"))
    return decontaminate.contamination(decontaminate.phrase_matches(index, table(spark, sf_dir, "benchmark")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents")).drop("digest")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_co_training": op2_co_training,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_lpt_shards": op4_lpt_shards,
    "op5_iso_media": op5_iso_media,
    "op6_bag_min_hash": op6_bag_min_hash,
    "op7_unit_hashing": op7_unit_hashing,
    "op8_decontaminate": op8_decontaminate,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
}
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL: dict[str, str] = {
    "op8_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 12], ' ') AS x, len(w[i : i + 12]) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes)),
found AS (SELECT doc_id, p, n, item_id FROM places JOIN windows USING (x, n)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
