"""Queries over the job log, batch and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import minutes_left
from ..operators import jobs as J
from ..sources.storage import shared_folder
from ..streaming import progress as P
from .text_queries import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# Which job state each event of the test table stands for.
STATE_OF = {"signup": "uploaded", "view": "extracting", "click": "queued", "purchase": "done", "error": "failed"}
_STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE_OF.items()) + " END"


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return add


def _log(events: DataFrame) -> DataFrame:
    state = F.create_map(*(F.lit(x) for pair in STATE_OF.items() for x in pair))[F.col("event_type")]
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("event_seq"), state.alias("state"), F.col("ts").alias("created_at"), "value")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def progress_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.changes(table(spark, sf_dir, "events"), "user_id", ["event_id"], F.col("event_type")).select("user_id", "event_id", "event_type")


def _read_to_end(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives until its input is read, from files in the shared folder; its checkpoint is there too."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, f"{name}-{uuid.uuid4().hex}")
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "events")
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


@query(ORACLE_SQL["progress_changes"].replace("user_id, event_id, event_type FROM (", "user_id AS job_id, event_id AS event_seq, event_type AS payload FROM (", 1))
def progress_changes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream of the table's files, run until it is read."""
    events = _event_stream(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("event_seq"), F.col("event_type").alias("payload"))
    return _read_to_end(P.changed_progress(events, silence_ms=None), "progress")


@query("""SELECT job_id, event_seq, payload FROM (SELECT user_id AS job_id, event_id AS event_seq, event_type AS payload, lag(event_type) OVER w AS before,
  coalesce(count(*) FILTER (event_type IN ('purchase', 'error')) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE payload IS DISTINCT FROM before AND over = 0""")
def progress_until_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of progress up to the first final state of each job."""
    events = _event_stream(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("event_seq"), F.col("event_type").alias("payload"))
    return _read_to_end(P.changed_progress(events, silence_ms=None, is_final=lambda p: p in ("purchase", "error")), "until-final")


_FOLDED = f"""SELECT job_id, seqs, states, list_reduce(list_transform(states, lambda s: [s]), lambda a, b: a || [CASE WHEN a[-1] = 'done' AND b[1] NOT IN ('done', 'failed') THEN a[-1] ELSE b[1] END]) AS now
  FROM (SELECT user_id AS job_id, list(event_id ORDER BY event_id) AS seqs, list({_STATE_SQL} ORDER BY event_id) AS states FROM events GROUP BY user_id)"""


@query(f"""SELECT job_id, event_seq, state, current, k = 1 OR NOT (before = 'done' AND state NOT IN ('done', 'failed')) AS accepted FROM (SELECT job_id, unnest(seqs) AS event_seq, unnest(states) AS state, unnest(now) AS current,
  unnest([NULL] || now[1:len(now) - 1]) AS before, unnest(range(1, len(now) + 1)) AS k FROM ({_FOLDED}))""")
def guarded_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of state over a stream, refused ones marked."""
    log = _log(_event_stream(spark, sf_dir)).select("job_id", "event_seq", "state")
    return _read_to_end(P.guarded_states(log, grace_ms=None), "states")


@query(f"""SELECT user_id AS job_id, max(event_id) + 0 AS last_seq, count(*) + 2 AS n_events, CASE WHEN user_id % 2 = 0 THEN 'cancelled' ELSE 'failed' END AS state, CASE WHEN user_id % 2 = 0 THEN '' ELSE 'no voice' END AS error, 'book ' || user_id AS title FROM events GROUP BY user_id""")
def requested_job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests appended to the log, and the rows that they leave."""
    log = _log(table(spark, sf_dir, "events"))
    jobs = log.groupBy("job_id").agg(F.max("event_seq").alias("last_seq"), F.count(F.lit(1)).alias("n_log"))
    none = F.lit(None).cast("string")
    titled = jobs.select("job_id", F.lit(1).alias("request_seq"), F.lit("title").alias("kind"), none.alias("state"), F.concat(F.lit("book "), F.col("job_id").cast("string")).alias("title"), none.alias("error"))
    even = F.col("job_id") % 2 == 0
    ended = jobs.select("job_id", F.lit(2).alias("request_seq"), F.when(even, "cancel").otherwise("fail").alias("kind"), none.alias("state"), none.alias("title"), F.lit("no voice").alias("error"))
    added = J.requested_events(log, titled.unionByName(ended))
    everything = log.select("job_id", "event_seq", F.lit("set_state").alias("kind"), "state", none.alias("error")).unionByName(added, allowMissingColumns=True)
    counts = everything.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_events"))
    return J.job_rows(everything).join(counts, "job_id").select("job_id", (F.col("event_seq") - 2).alias("last_seq"), "n_events", "state", "error", "title")


@query(f"""SELECT user_id AS job_id, max(event_id) AS event_seq, max_by({_STATE_SQL}, event_id) AS state, count(*) AS n_events FROM events GROUP BY user_id""")
def job_state_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.snapshot(_log(table(spark, sf_dir, "events"))).select("job_id", "event_seq", "state", "n_events")


@query(f"""SELECT job_id, event_seq, state, before, NOT (coalesce(before IN ('done', 'cancelled'), false) AND state NOT IN ('done', 'failed', 'cancelled')) AND NOT (state = 'cancelled' AND coalesce(before IN ('done', 'failed', 'cancelled'), false)) AS legal
  FROM (SELECT user_id AS job_id, event_id AS event_seq, {_STATE_SQL} AS state, lag({_STATE_SQL}) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)""")
def job_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.moves(_log(table(spark, sf_dir, "events"))).select("job_id", "event_seq", "state", "before", "legal")


@query(f"SELECT user_id AS job_id, event_id AS event_seq, {_STATE_SQL} AS state FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.recent(_log(table(spark, sf_dir, "events"))).select("job_id", "event_seq", "state")


@query("SELECT user_id AS job_id, event_id AS event_seq FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 1")
def next_queued_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.next_queued(_log(table(spark, sf_dir, "events"))).select("job_id", "event_seq")


@query("SELECT event_id, CASE WHEN user_id % 10 > 0 THEN value * 10 / (user_id % 10) - value END AS seconds_left FROM events")
def time_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", minutes_left(F.col("value"), F.col("user_id") % 10, F.lit(10)).alias("seconds_left"))
