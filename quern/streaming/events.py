"""Per-session state over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.streaming.ingest import drops, run_once


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drops(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def last_seen(stream: DataFrame) -> DataFrame:
    """Last user-like and assistant-like time of each session: two maxima are all the state there is."""
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    return stream.groupBy("session_id").agg(at("click").alias("last_user"), at("purchase").alias("last_assistant"))


def stream_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run_once(last_seen(event_stream(spark, sf_dir)), "last-seen", "complete")
    return made.select("session_id", F.col("last_user").cast("timestamp_ntz").alias("last_user"), F.col("last_assistant").cast("timestamp_ntz").alias("last_assistant"))


def first_over(stream: DataFrame, least: float, late: str = "1 day", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """A row when a session first reaches the threshold, and no other one for as long as it lives.

    State is a flag a session that has reached it. It goes when the watermark (late behind the newest ts) passes the
    session's last event by idle_ms; a session that comes back after that is a new one. Events behind the watermark are
    not looked at.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        told, last = (True, state.get[0]) if state.exists else (False, 0)
        for pdf in batches:
            if len(pdf):
                last = max(last, int(pdf["ts"].astype("datetime64[us]").astype("int64").max()) // 1000)
            if not told and (pdf["value"] >= least).any():
                told = True
                yield pd.DataFrame({"session_id": [key[0]]})
        if told:
            state.update((last,))
            state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))

    stamped = stream.where("ts is not null").withWatermark("ts", late)
    return stamped.groupBy("session_id").applyInPandasWithState(step, "session_id string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_first_over(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    return run_once(first_over(event_stream(spark, sf_dir), least), "threshold")


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: event counts by tumbling window, late events dropped behind the watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def timed_release(stream: DataFrame, claims: DataFrame, minutes: int = 60) -> DataFrame:
    """Freezes joined to the claims of their sessions, with the time from which they may be acted on."""
    active = claims.where(F.col("status") == "in_progress").select("session_id", "task_id")
    return stream.where("event_type = 'error'").join(active, "session_id").withColumn("ready_at", F.col("ts") + F.expr(f"interval {minutes} minutes"))
