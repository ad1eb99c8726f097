"""Candidate recall: probes over both tiers, near-duplicates against memory, scope, batches, groups and order."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quern.config import DEFAULTS, Settings
from quern.functions.globs import excluded
from quern.functions.vectors import TINY
from quern.store import numbered, staged


def keep_best(hits: DataFrame, keys: list[str], most: int, path_col: str | None = None, patterns: list[str] | None = None) -> DataFrame:
    """One row a key of hits (keys, score, query_idx, tier_rank, rank): the best score, of equals the earliest probe.

    Excluded paths go first; they have used up their places in the probes' top-k all the same.
    """
    if path_col and patterns:
        hits = hits.where(~excluded(F.col(path_col), patterns))
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "query_idx", "tier_rank", "rank")
    return hits.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n").orderBy(F.desc("score"), "query_idx", "tier_rank", "rank", *keys).limit(most)


#: Candidates that one pass over the corpus compares; more are taken in several passes.
BLOCK = 4096


def nearest(candidates: DataFrame, corpus: DataFrame, cand_id: str, corpus_id: str) -> DataFrame:
    """cand_id, nearest (corpus id) and similarity of each candidate: its best cosine over the corpus, ties by id.

    Candidates are a stated query set. They go to the tasks in blocks of BLOCK rows, so that what is sent has a bound
    however many there are; a task multiplies its rows' matrix by the block's and keeps its best per candidate, so one
    row a candidate and task is shuffled.
    """
    spark = candidates.sparkSession
    kinds = [candidates.schema[cand_id], corpus.schema[corpus_id]]
    many = candidates.count()
    shape = T.StructType().add("i", T.IntegerType()).add("nearest", kinds[1].dataType).add("similarity", T.DoubleType())
    blocks = max(1, -(-many // (BLOCK // 2)))  # dealt by hash: half of BLOCK each, so that none is likely to be over it
    out = None
    for b in range(blocks):
        mine = candidates if blocks == 1 else candidates.where(F.pmod(F.xxhash64(cand_id), F.lit(blocks)) == b)
        rows = mine.select(cand_id, "embedding").collect()
        if not rows:
            continue
        q = np.array([r["embedding"] for r in rows], dtype=np.float64)
        q /= np.sqrt((q * q).sum(1))[:, None] + TINY

        def best(batches: Iterator[pa.RecordBatch], q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            top, owner = np.full(len(q), -np.inf), np.zeros(len(q), dtype=object)
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    ids = part.column(0).to_pylist()
                    v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                    v /= np.sqrt((v * v).sum(1))[:, None] + TINY
                    order = np.array(sorted(range(len(ids)), key=ids.__getitem__))
                    score = np.round(q @ v[order].T, 6)
                    at = score.argmax(1)  # of equals the least id of the batch
                    value = score[np.arange(len(q)), at]
                    for i in np.flatnonzero(value >= top).tolist():
                        mine_ = ids[order[at[i]]]
                        if value[i] > top[i] or mine_ < owner[i]:
                            top[i], owner[i] = value[i], mine_
            have = np.flatnonzero(np.isfinite(top))
            yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array([owner[i] for i in have.tolist()], type=kind), pa.array(top[have])], names=["i", "nearest", "similarity"])

        kind = to_arrow_type(kinds[1].dataType)
        scored = corpus.select(corpus_id, "embedding").mapInArrow(best, shape)
        kept = scored.groupBy("i").agg(F.max("similarity").alias("similarity"), F.min_by("nearest", F.struct(-F.col("similarity"), "nearest")).alias("nearest"))
        named = spark.createDataFrame([(i, r[cand_id]) for i, r in enumerate(rows)], T.StructType().add("i", T.IntegerType()).add(kinds[0]))
        part = kept.join(named, "i").select(cand_id, "nearest", "similarity")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], T.StructType().add(kinds[0]).add("nearest", kinds[1].dataType).add("similarity", T.DoubleType()))


def split_captured(candidates: DataFrame, corpus: DataFrame, cand_id: str, corpus_id: str, least: float) -> DataFrame:
    """nearest() with captured: similar enough to something that is known; without a corpus everything is new."""
    near = nearest(candidates, corpus, cand_id, corpus_id)
    return candidates.select(cand_id).join(near, cand_id, "left").withColumn("captured", F.coalesce(F.col("similarity") >= least, F.lit(False)))


def first_conflict(chunks: DataFrame, corpus: DataFrame, least: float) -> DataFrame:
    """For captures: the first chunk (chunk_no) of a note (note_id) that is as near as `least` to a known one."""
    near = nearest(chunks.withColumn("c", F.struct("note_id", "chunk_no")), corpus, "c", "corpus_id").where(F.col("similarity") >= least)
    return near.groupBy(F.col("c.note_id").alias("note_id")).agg(F.min("c.chunk_no").alias("chunk_no"), F.min_by(F.struct("nearest", "similarity"), "c.chunk_no").alias("hit"))


def refined(score: Column, role: Column, length: Column, s: Settings = DEFAULTS) -> Column:
    """score times the role's weight times a penalty for length beyond the floor."""
    over = F.greatest(length - s.length_floor, F.lit(0))
    return score * F.when(role == "user", s.user_weight).otherwise(1.0) * (1 - F.least(F.lit(s.length_penalty), s.length_penalty * over / s.length_scale))


def rerank(cands: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """cands in order of their refined score, with their positions."""
    scored = cands.withColumn("refined", F.round(refined(F.col("score"), F.col("role"), F.length("content"), s), 6))
    return numbered(scored, [F.desc("refined"), F.desc("score"), F.col("session_id"), F.col("message_uuid")], "position")


def apply_scope(df: DataFrame, slugs: list[str], now: dt.datetime, s: Settings = DEFAULTS, most: int | None = None) -> DataFrame:
    """Rows of the named projects (all if none) and the last days; then of the newest sessions among those.

    Rows (slug, session_id, ts) whose time is null pass the day filter and count as oldest for their session.
    """
    kept = df.where(F.col("slug").isin(*slugs)) if slugs else df
    kept = kept.where(F.coalesce("ts", F.lit(now)) >= F.lit(now - dt.timedelta(days=s.scope_days)))
    newest = kept.groupBy("session_id").agg(F.max("ts").alias("newest")).orderBy(F.desc_nulls_last("newest"), "session_id").limit(most or s.scope_sessions)
    return kept.join(newest.select("session_id"), "session_id", "left_semi")


def batches(df: DataFrame) -> DataFrame:
    """slug and n (rows) of every project's batch; its sessions are the rows of batch_sessions()."""
    return df.groupBy("slug").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("n_sessions"))


def batch_sessions(df: DataFrame) -> DataFrame:
    """slug and session_id: which sessions a project's batch holds."""
    return df.select("slug", "session_id").distinct()


def open_batches(plan: DataFrame, completed: DataFrame) -> DataFrame:
    return plan.join(completed, "slug", "left_anti")


def top_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """All rows: the first n are active, the others deferred."""
    return numbered(df, list(order), "position").withColumn("status", F.when(F.col("position") <= n, "active").otherwise("deferred"))


def by_layer(df: DataFrame, *order: Column | str) -> DataFrame:
    """Group order, most ambient layer first, and rank inside of each group."""
    place = F.coalesce(*[F.when(F.col("layer") == x, F.lit(i)) for i, x in enumerate(("always", "when", "topic", "knowledge"))], F.lit(4))
    placed = staged(df.withColumn("layer_order", place), "placed")  # the sort reads its input twice, which may be costly to make
    return numbered(placed, list(order), "rank", by="layer")
