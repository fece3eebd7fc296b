"""Helpers that the training-data operators share: shared storage, Arrow maps, numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see.

    Where the setting is missing, a local master gets a temporary folder; a cluster gets an error,
    since its executors would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/tomeflow-shared"
    return f"{found.rstrip('/')}/tomeflow"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends at files that outlive executors."""
    return stored_at(df, name, **options)[0]


def stored_at(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """As stored(), with the path. The shuffle files of the job go when it ends: what it made is on disk."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Shelf:
    """Stored tables that only the block of a with statement needs; they are deleted when it ends."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._at = spark, {}

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *error: object) -> None:
        self.drop(*list(self._at))

    def put(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df, self._at[name] = stored_at(df, name, **options)
        return df

    def drop(self, *names: str) -> None:
        for name in names:
            drop_stored(self._spark, self._at.pop(name))


def text_digest(text: str | Column = "text") -> Column:
    """The md5 of a text, 16 bytes; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def renamed(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its columns called c0, c1 ..., so that no helper column can clash with one, and the way back."""
    names = docs.columns
    return docs.toDF(*(f"c{i}" for i in range(len(names)))), lambda df: df.select(*(F.col(f"c{i}").alias(x) for i, x in enumerate(names)))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that come sorted by keys, in tables that no group of equal keys (numbers) crosses the edge of."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held and any(batch[k][0] != held[-1][k][-1] for k in keys):
            edges = np.concatenate([[0], edges])
        if len(edges):
            held.append(batch.slice(0, edges[-1]))
            yield pa.Table.from_batches(held)
            held = [batch.slice(edges[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def batch_of(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, types.get(k)) for k, x in columns.items()],
        names=list(columns),
    )


def numbered(df: DataFrame, keys: list[str], spread: Column, name: str, buckets: int, order: list[Column]) -> DataFrame:
    """df with a gapless number from 0 within keys, without gathering a key in one task.

    The rows of a key are dealt to `buckets` by the value of `spread` (a function of the row alone, so
    recomputed tasks agree), numbered inside each bucket, and shifted by the counts of the buckets before.
    Only the table of counts, of at most keys x buckets rows, is scanned in order.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    by = [*keys, "_bucket"]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("_inside", inside).join(starts, by).withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_bucket", "_inside", "_start")


def bucket_count(rows: int, each: int = 20_000) -> int:
    """Buckets that hold about `each` rows, whatever the size of the table."""
    return max(16, -(-rows // each))
