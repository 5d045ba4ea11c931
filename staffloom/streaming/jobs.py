"""Jobs that follow a stream, and their batch twins."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from staffloom.functions import text as x

FINISHED = ["succeeded", "failed"]


def latest_decision(decisions: DataFrame) -> DataFrame:
    """The last accepted or declined decision per token; other values are left out. Works on streams (complete or update mode)."""
    value = F.lower(x.strip(F.col("decision")))
    known = decisions.where(value.isin("accepted", "declined")).withColumn("_d", value)
    return known.groupBy("token").agg(F.max_by("_d", F.struct("decided_at", "seq")).alias("decision"), F.max("decided_at").alias("decided_at"))


def job_status(events: DataFrame) -> DataFrame:
    """Batch: the state of each job after its events in order; what follows the first end is ignored, the first start kept."""
    at = F.struct("ts", "seq")
    end = F.min(F.when(F.col("status").isin(FINISHED), at))
    ends = events.groupBy("job_id").agg(end.alias("_end"))
    seen = events.join(ends, "job_id").where(F.col("_end").isNull() | (F.struct("ts", "seq") <= F.col("_end")))
    return seen.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"), F.min(F.when(F.col("status").isin(FINISHED), F.col("ts"))).alias("finished_at"))


class JobState(StatefulProcessor):
    """The state of one job: its status, first start and end. What follows the end is left out.

    State goes by timers in event time: ``keep`` after a job's end, so that late events of a finished job meet its state until then, and ``idle`` after the
    last event of a job that never ended, which is told as ``expired``. Later events are behind the watermark or begin a job anew.
    """

    def __init__(self, keep: timedelta, idle: timedelta):
        self.keep, self.idle = (int(t.total_seconds() * 1000) for t in (keep, idle))

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, started_at string, finished_at string, until long")

    def row(self, key, status, started, finished) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "status": [status], "started_at": [started], "finished_at": [finished]}, dtype=object)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  Spark's names
        status, started, finished, until = self.state.get() if self.state.exists() else (None, None, None, None)
        told, latest = False, 0
        for row in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            if status in FINISHED:
                break
            status, told, latest = row.status, True, int(row.ts.timestamp() * 1000)
            if status == "running" and started is None:
                started = str(row.ts)
            if status in FINISHED:
                finished = str(row.ts)
        if told:
            if until is not None:
                self.handle.deleteTimer(until)
            until = max(latest + (self.keep if status in FINISHED else self.idle), timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(until)
            self.state.update((status, started, finished, until))
            yield self.row(key, status, started, finished)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        status, started, finished, _ = self.state.get()
        self.state.clear()
        if status not in FINISHED:
            yield self.row(key, "expired", started, finished)

    def close(self) -> None:
        pass


def stream_job_status(events: DataFrame, keep: timedelta = timedelta(days=7), idle: timedelta = timedelta(days=30), late: str = "1 hour") -> DataFrame:
    """Stream: the same by state per job; emits a job's state whenever it changes. events: job_id, seq, ts, status.

    State is bounded by the jobs of the last ``keep`` (finished ones) or ``idle`` (others); events that come more than ``late`` behind the newest are left out.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = events.select("job_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "status").withWatermark("ts", late)
    return timed.groupBy("job_id").transformWithStateInPandas(JobState(keep, idle), "job_id long, status string, started_at string, finished_at string", "Update", "EventTime")


def follow(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a stream over what is there now, a batch at a time. ``apply`` gets the batch and its number; a batch that is run again has
    the same number, so a writer that replaces what stands under that number writes once.
    """
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_resume_intake(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """New resumes are parsed as they come; bad rows go to ``errors``, good ones to ``parsed``, each batch under its number."""

    def apply(batch: DataFrame, number: int) -> None:
        rows = parse(batch).persist()
        try:
            rows.where("error IS NULL").write.mode("overwrite").parquet(f"{out}/parsed/batch={number}")
            rows.where("error IS NOT NULL").write.mode("overwrite").parquet(f"{out}/errors/batch={number}")
        finally:
            rows.unpersist()

    return follow(stream, apply, checkpoint)
