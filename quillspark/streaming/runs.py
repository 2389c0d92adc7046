"""Runs of sources as keyed state: the latest run, when a source was first and last seen, and a timer that calls it stale."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Times are microseconds since 1970, so that no time zone comes between a state and its rows.
STATE = "id long, status string, fetched_us long, first_us long, runs long"
OUT = f"source_id string, {STATE}, stale boolean"
#: The state store that keeps such state; a session that runs the stream is made with it.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestRun(StatefulProcessor):
    """One source: its latest run by id, and a timer ``after_ms`` behind the latest time that a run was fetched at."""

    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", STATE)

    def _row(self, key, state, stale: bool) -> Row:
        return Row(source_id=key[0], id=state[0], status=state[1], fetched_us=state[2], first_us=state[3], runs=state[4], stale=stale)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state = self.latest.get() if self.latest.exists() else None
        for r in rows:
            newer = state is None or r["id"] > state[0]
            first = r["fetched_us"] if state is None else min(state[3], r["fetched_us"])
            last = r["fetched_us"] if newer else state[2]
            state = (r["id"] if newer else state[0], r["status"] if newer else state[1], last, first, (state[4] if state else 0) + 1)
        self.latest.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = state[2] // 1000 + self.after_ms
        gone = due <= timerValues.getCurrentWatermarkInMs()
        if not gone:
            self.handle.registerTimer(due)
        yield self._row(key, state, gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.latest.exists():
            yield self._row(key, self.latest.get(), True)

    def close(self) -> None:
        pass


def latest_runs_stream(runs: DataFrame, *, stale_after_hours: int = 48, late: str = "1 hour") -> DataFrame:
    """Updates of each source in a stream of runs (source_id, id, status, fetched_at): a row when it has new runs, one when it goes stale.

    Later rows of a source replace earlier ones. A source is stale once the watermark, ``late`` behind the latest run of
    all, is ``stale_after_hours`` past its own latest run. Sessions need the state store ``PROVIDER``.
    """
    timed = runs.select("source_id", "id", "status", "fetched_at", F.unix_micros("fetched_at").alias("fetched_us")).withWatermark("fetched_at", late)
    kept = timed.groupBy("source_id").transformWithState(LatestRun(stale_after_hours * 3_600_000), OUT, "Update", "EventTime")
    return kept.select("source_id", "id", "status", F.timestamp_micros("fetched_us").alias("fetched_at"), F.timestamp_micros("first_us").alias("first_seen"), "runs", "stale")


def latest_runs_state(runs: DataFrame, watermark: Column, *, stale_after_hours: int = 48) -> DataFrame:
    """The same of a whole table of runs, as of a watermark: the state that the stream ends with."""
    best = F.max_by(F.struct("status", "fetched_at"), "id")
    one = runs.groupBy("source_id").agg(F.max("id").alias("id"), best.alias("b"), F.min("fetched_at").alias("first_seen"), F.count("*").alias("runs"))
    stale = F.col("b.fetched_at") + F.make_dt_interval(hours=F.lit(stale_after_hours)) <= watermark
    return one.select("source_id", "id", F.col("b.status"), F.col("b.fetched_at"), "first_seen", "runs", stale.alias("stale"))
