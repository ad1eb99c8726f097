"""State transitions as column updates: notes (confirm, suspect, invalidate) and tasks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confirm(notes: DataFrame, target: Column, today: dt.date) -> DataFrame:
    """Sets last_confirmed and clears suspicion; all other columns stay."""
    put = lambda c, v: F.when(target, v).otherwise(F.col(c)).alias(c)
    new = {"last_confirmed": F.lit(today.isoformat()), "suspected_at": F.lit(None).cast("string"), "suspect_reason": F.lit(None).cast("string")}
    return notes.select(*[put(c, new[c]) if c in new else F.col(c) for c in notes.columns])


def suspect(notes: DataFrame, target: Column, now: dt.datetime, reason: str | None) -> tuple[DataFrame, DataFrame]:
    """Marks live notes; invalidated ones are refused and come back as the second table."""
    dead = F.coalesce(F.col("invalidated_at") != "", F.lit(False))
    hit = target & ~dead
    new = {"suspected_at": F.lit(now.isoformat()), "suspect_reason": F.lit(reason).cast("string")}
    return notes.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in notes.columns]), notes.where(target & dead)


def invalidate(notes: DataFrame, target: Column, now: dt.datetime, at: str | None = None, reason: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Invalidates live notes, with the reason appended to the body; those that are already come back."""
    dead = F.coalesce(F.col("invalidated_at") != "", F.lit(False))
    hit = target & ~dead
    new = {"invalidated_at": F.lit(at or now.isoformat()), "updated": F.lit(now.date().isoformat())}
    if reason and "body" in notes.columns:
        new["body"] = F.concat(F.col("body"), F.lit(f"\n\nInvalidated: {reason}\n"))
    return notes.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in notes.columns]), notes.where(target & dead)


def task_transition(tasks: DataFrame, target: Column, verb: str, now: dt.datetime, session: str = "", reason: str = "") -> DataFrame:
    """start claims for a session, done clears the claim, block appends its reason to the body."""
    state = {"start": "in_progress", "done": "done", "block": "blocked"}[verb]
    new = {"status": F.lit(state), "updated": F.lit(now.isoformat())}
    if verb != "block":
        new["session_id"] = F.lit(session if verb == "start" else "")
    elif reason:
        new["body"] = F.concat(F.coalesce("body", F.lit("")), F.lit(f"\n\nBlocked: {reason}\n"))
    return tasks.select(*[F.when(target, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in tasks.columns])


def task_list(tasks: DataFrame, most: int = 10) -> DataFrame:
    """Blocked tasks first, then by creation and id, the first `most`."""
    return tasks.where("status <> 'done'").orderBy(F.when(F.col("status") == "blocked", 0).otherwise(1), F.coalesce("created", F.lit("")), "id").limit(most)


def cascade_delete(files: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return files.join(gone.select("file_path"), "file_path", "left_anti"), chunks.join(gone.select("file_path"), "file_path", "left_anti")
