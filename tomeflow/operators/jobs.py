"""The job table as a log of events: snapshots, legal moves, and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("uploaded", "extracting", "ready_for_review", "queued", "synthesizing", "done", "failed", "cancelled")
FINAL = ("done", "failed", "cancelled")
IRREVERSIBLE = ("done", "cancelled")


def legal_move(before: Column, after: Column) -> Column:
    """What may follow a state: nothing leads out of done or cancelled but to a final state, and only an
    unfinished job can be cancelled."""
    stuck = F.coalesce(before.isin(*IRREVERSIBLE), F.lit(False)) & ~after.isin(*FINAL)
    late = (after == "cancelled") & F.coalesce(before.isin(*FINAL), F.lit(False))
    return after.isin(*STATES) & ~stuck & ~late


def moves(log: DataFrame) -> DataFrame:
    """log (job_id, event_seq, state) with the state before and whether the move is legal."""
    before = F.lag("state").over(Window.partitionBy("job_id").orderBy("event_seq"))
    return log.withColumn("before", before).withColumn("legal", legal_move(F.col("before"), F.col("state")))


def snapshot(log: DataFrame) -> DataFrame:
    """The last event of each job: one aggregation, no sort."""
    fields = [c for c in log.columns if c != "job_id"]
    return log.groupBy("job_id").agg(F.max_by(F.struct(*fields), "event_seq").alias("_last"), F.count(F.lit(1)).alias("n_events")).select("job_id", "_last.*", "n_events")


def recent(jobs: DataFrame, limit: int = 50) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("event_seq")).limit(limit)


def next_queued(jobs: DataFrame) -> DataFrame:
    return jobs.where("state = 'queued'").orderBy("created_at", "event_seq").limit(1)


def changes(events: DataFrame, key: str, order: list[str], payload: Column) -> DataFrame:
    """The events whose payload differs from the one before of the same key."""
    before = F.lag("_payload").over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("_payload", payload).withColumn("_before", before).where(~F.col("_payload").eqNullSafe(F.col("_before"))).drop("_payload", "_before")


#: What each kind of request writes into the job's row, beside its own fields; null leaves a field as it was.
REQUEST_STATES = {"create": "uploaded", "fail": "failed", "finish": "done", "cancel": "cancelled"}
FIELDS = ("state", "title", "stage", "done", "total", "error", "result", "review", "options")


def requested_events(log: DataFrame, requests: DataFrame) -> DataFrame:
    """The events that requests (job_id, request_seq, kind and fields of FIELDS) append to a log (job_id, event_seq, state).

    kind: create, set_state, progress, title, fail, finish, cancel, review, options, delete. Numbers go on where the
    job's log ends. A move of state takes the old error away. Whether a move is legal is for moves() to say.
    """
    ends = log.groupBy("job_id").agg(F.max("event_seq").alias("_last"))
    by_kind = F.create_map(*(F.lit(x) for pair in REQUEST_STATES.items() for x in pair))
    state = F.coalesce(by_kind[F.col("kind")], F.when(F.col("kind") == "set_state", F.col("state")))
    has = set(requests.columns)
    fields = {c: F.col(c) if c in has else F.lit(None).cast("string") for c in FIELDS if c != "state"}
    fields["error"] = F.when(F.col("kind") == "fail", fields["error"]).when(state.isNotNull(), F.lit(""))
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("request_seq"))
    numbered = requests.join(ends, "job_id", "left").withColumn("event_seq", F.coalesce("_last", F.lit(0)).cast("long") + number)
    return numbered.select("job_id", "event_seq", "kind", state.alias("state"), *(v.alias(k) for k, v in fields.items()))


def job_rows(events: DataFrame) -> DataFrame:
    """The row of each job that requested_events leave: the last value of each field; deleted jobs are gone."""
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("event_seq"))).alias(c) for c in events.columns if c in FIELDS]
    found = events.groupBy("job_id").agg(*last, F.max("event_seq").alias("event_seq"), F.max_by("kind", "event_seq").alias("_kind"))
    return found.where("_kind <> 'delete'").drop("_kind")
