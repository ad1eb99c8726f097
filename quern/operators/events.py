"""Session events in batch form: elapsed time, thresholds, claims and the resume decision."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.config import DEFAULTS, Settings
from quern.functions.text import is_limit, reset_time


def elapsed(events: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Seconds since the session's last event of each kind before a row; kinds: column name by event type."""
    before = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = {name: F.last(F.when(F.col("event_type") == kind, F.col("ts")), ignorenulls=True).over(before) for kind, name in kinds.items()}
    return events.withColumns({n: (F.unix_timestamp("ts") - F.unix_timestamp(c)).cast("long") for n, c in last.items()})


def first_over(events: DataFrame, value: str, least: float) -> DataFrame:
    """The first time a session's value reaches `least`: once a session, whatever comes later."""
    return events.where(F.col(value) >= least).groupBy("session_id").agg(F.min("ts").alias("ts"))


def claimed(freezes: DataFrame, claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """Freezes of sessions that a task in progress claims and the ledger has not handled."""
    active = claims.where(F.col("status") == "in_progress").select("session_id", "task_id")
    return freezes.join(active, "session_id").join(ledger.select("session_id", "ts"), ["session_id", "ts"], "left_anti")


def resume_tick(freezes: DataFrame, claims: DataFrame, ledger: DataFrame, now: dt.datetime, s: Settings = DEFAULTS) -> DataFrame:
    """The newest actionable freeze, at most one: limit-shaped, claimed, not handled, not stale and past its reset."""
    ready = F.coalesce(reset_time(F.col("message"), F.col("ts")), F.col("ts") + F.expr(f"interval {s.resume_delay_minutes} minutes"))
    fresh = claimed(freezes.where(F.col("session_id") != "").where(is_limit(F.col("code"), F.col("message"))), claims, ledger)
    at = F.lit(now)
    return fresh.where(F.col("ts").isNotNull() & (F.col("ts") >= at - F.expr(f"interval {s.resume_age_days} days"))).withColumn("ready_at", ready).where(F.col("ready_at") <= at).orderBy(F.desc("ts"), "session_id").limit(1)
