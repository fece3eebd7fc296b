"""Progress and job state as streams.

State is one small value a job (the last payload, or the last state). Jobs that fall silent are forgotten after
a while, finished ones after a grace period, so state does not grow with the jobs that ever were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import FINAL, IRREVERSIBLE, STATES

SILENCE_MS = 300_000


def changed_progress(events: DataFrame, silence_ms: int | None = SILENCE_MS, is_final: Callable[[str], bool] = lambda payload: False) -> DataFrame:
    """events (job_id, event_seq, payload): those that differ from the job's last payload, up to a final one.

    A job silent for silence_ms is forgotten; None keeps all, for streams that are read to an end.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.exists
        last, over = state.get if known else (None, False)
        rows = pd.concat(list(batches)).sort_values("event_seq")
        out = []
        for seq, payload in zip(rows["event_seq"], rows["payload"]):
            if not over and (not known or payload != last):
                out.append((key[0], seq, payload))
                over = payload is not None and is_final(payload)
            last, known = payload, True
        state.update((last, over))
        if silence_ms is not None:
            state.setTimeoutDuration(silence_ms)
        yield pd.DataFrame(out, columns=["job_id", "event_seq", "payload"])

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id long, event_seq long, payload string", "last string, over boolean", "append", _timeout(silence_ms))


def _timeout(after_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if after_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _legal(before: str | None, after: str) -> bool:
    if after not in STATES or (before in IRREVERSIBLE and after not in FINAL):
        return False
    return not (after == "cancelled" and before in FINAL)


def guarded_states(events: DataFrame, grace_ms: int | None = SILENCE_MS, silence_ms: int | None = None) -> DataFrame:
    """events (job_id, event_seq, state) with accepted; a refused move leaves the job where it was.

    A job in a final state is forgotten grace_ms after its last event, any other silence_ms after it (None: never).
    An event that comes later still finds no job, as the first event of one does. A stream that is to end when its
    input is read needs None for both, since one that waits for time to pass never ends.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("event_seq")
        out = []
        for seq, wanted in zip(rows["event_seq"], rows["state"]):
            accepted = _legal(now, wanted)
            now = wanted if accepted else now
            out.append((key[0], seq, wanted, accepted, now))
        if now is not None:
            state.update((now,))
            after = grace_ms if now in FINAL else silence_ms
            if after is not None:
                state.setTimeoutDuration(after)
        yield pd.DataFrame(out, columns=["job_id", "event_seq", "state", "accepted", "current"])

    timeout = _timeout(grace_ms if silence_ms is None else silence_ms)
    return events.groupBy("job_id").applyInPandasWithState(run, "job_id long, event_seq long, state string, accepted boolean, current string", "state string", "append", timeout)


class ProgressHook(StreamingQueryListener):
    """Tells hook(stage, done) the rows that a query has read so far; add it with spark.streams.addListener."""

    def __init__(self, hook: Callable[[str, int], None]) -> None:
        self._hook, self._done = hook, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802 - Spark's names
        self._done[event.id] = 0
        self._hook(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._done[p.id] = self._done.get(p.id, 0) + p.numInputRows
        self._hook(p.name or str(p.id), self._done[p.id])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._done.pop(event.id, None)


def resumable(work: DataFrame, cache_path: str, step: Callable[[DataFrame], DataFrame], checkpoint: str, cancelled: Callable[[], DataFrame] | None = None):
    """A query that runs `step` over chunks (key, text) that the cache at cache_path lacks, and stores them.

    cancelled gives the jobs (job_id) that are cancelled by now; each batch leaves out their chunks, which then need
    a job_id. A batch that is run again finds what it stored the first time, so each key is paid for once.
    """

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if cancelled is not None:
            batch = batch.join(cancelled().select("job_id").distinct(), "job_id", "left_anti")
        known = spark.read.schema("key string, text string, seconds double, status string").option("ignoreMissingFiles", "true")
        try:
            cache = known.parquet(cache_path)
            todo = batch.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
        except Exception as e:  # noqa: BLE001 - only the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            todo = batch.dropDuplicates(["key"])
        step(todo).where("status = 'done'").write.mode("append").parquet(cache_path)

    return work.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
