"""Vector search, temporal ranking and the layered search over both tiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quern.config import DEFAULTS, Settings
from quern.functions.dates import first_filled, to_date
from quern.functions.vectors import TINY, cosine_to


def cosine_topk(df: DataFrame, query: list[float], k: int, id_col: str, vector_col: str = "embedding", digits: int | None = 6) -> DataFrame:
    """The k rows nearest to a query; ties by id. A top-k per task is merged, nothing is shuffled."""
    score = cosine_to(F.col(vector_col), query)
    return df.withColumn("cosine_score", F.round(score, digits) if digits is not None else score).orderBy(F.desc("cosine_score"), id_col).limit(k)


def probes_topk(df: DataFrame, probes: DataFrame, k: int, id_col: str, vector_col: str = "embedding", metric: str = "cosine") -> DataFrame:
    """The k nearest rows of every probe (probe, query), by cosine or by the negative distance (l2).

    Probes are few by contract and go to every task, which multiplies its rows' matrix by theirs and keeps k rows a
    probe. Ids are long or string; scores are rounded to six digits and ties go by id.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError("metric is cosine or l2")
    asked = probes.select("probe", "query").collect()
    kind = df.schema[id_col].dataType
    shape = T.StructType().add("i", T.IntegerType()).add(id_col, kind).add("cosine_score", T.DoubleType())
    if not asked:
        return df.sparkSession.createDataFrame([], T.StructType().add(probes.schema["probe"]).add(df.schema[id_col]).add("cosine_score", T.DoubleType()).add("rank", T.IntegerType()))
    q = np.array([r.query for r in asked], dtype=np.float64)
    long = np.sqrt((q * q).sum(axis=1))
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked]
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                piece = batch.slice(lo, 2048)
                ids = piece.column(0).to_pylist()
                v = piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                if metric == "cosine":
                    scores = (q @ v.T) / ((np.sqrt((v * v).sum(axis=1)) + TINY)[None, :] * (long + TINY)[:, None])
                else:
                    scores = -np.sqrt(np.stack([((v - x) ** 2).sum(axis=1) for x in q]))
                scores = np.round(scores, 6)
                least = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(q), -np.inf)
                for i, floor in enumerate(least.tolist()):
                    mine = [(-s, ids[j]) for j, s in ((j, float(scores[i, j])) for j in np.flatnonzero(scores[i] >= floor).tolist())]
                    best[i] = sorted(best[i] + mine)[:k]
        rows = [(i, x, -s) for i, found in enumerate(best) for s, x in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], arrow), pa.array([r[2] + 0.0 for r in rows], pa.float64())], names=["i", id_col, "cosine_score"])

    there = df.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    named = F.broadcast(df.sparkSession.createDataFrame([(i, r.probe) for i, r in enumerate(asked)], T.StructType().add("i", T.IntegerType()).add(probes.schema["probe"])))
    rank = Window.partitionBy("i").orderBy(F.desc("cosine_score"), id_col)
    return there.mapInArrow(run, shape).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).join(named, "i").select("probe", id_col, "cosine_score", "rank")


def layer_of(path: Column, home: str) -> Column:
    """First segment below home; null outside of it and for files that lie in it directly."""
    rest = F.substring(path, len(home.rstrip("/")) + 2, 1 << 30)
    return F.when(path.startswith(home.rstrip("/") + "/") & rest.contains("/"), F.split(rest, "/")[0])


def temporal_rank(hits: DataFrame, settings: Settings = DEFAULTS, home: str = "/m", exclude_invalidated: bool = True, include_invalidated: bool = False) -> DataFrame:
    """Drops facts that are not valid yet and, unless asked for, invalidated ones; adds the recency boost and orders.

    hits: file_path, cosine_score, created, updated, valid_from, invalidated_at. Exempt layers get the full boost.
    """
    today = F.lit(settings.today)
    valid = to_date(first_filled(F.col("valid_from"), F.col("created")))
    dead = first_filled(F.col("invalidated_at")).isNotNull()
    dated = to_date(first_filled(F.col("updated"), F.col("created")))
    age = F.greatest(F.datediff(today, dated), F.lit(0))
    boost = F.when(layer_of(F.col("file_path"), home).isin(*settings.exempt_layers), F.lit(settings.recency_weight)).when(dated.isNotNull(), settings.recency_weight * F.exp(-age / F.lit(max(settings.recency_days, 1.0)))).otherwise(0.0)
    live = hits.where(valid.isNull() | (valid <= today))
    if exclude_invalidated and not include_invalidated:
        live = live.where(~dead)
    return live.withColumn("final_score", F.col("cosine_score") + boost - F.when(dead, settings.invalidated_penalty).otherwise(0.0))


def search_memory(chunks: DataFrame, query: list[float], settings: Settings = DEFAULTS, home: str = "/m", exact: bool = False, include_invalidated: bool = False) -> DataFrame:
    """Memory tier: nearest chunks, then temporal policy, then the first k.

    The policy sees the over-fetched nearest rows only, as the contract of this search says; exact=True applies it
    before the cut. Either way only a top-k leaves a task.
    """
    order = (F.desc("final_score"), "chunk_id")
    if exact:
        return temporal_rank(chunks.withColumn("cosine_score", cosine_to(F.col("embedding"), query)), settings, home, True, include_invalidated).orderBy(*order).limit(settings.k)
    near = cosine_topk(chunks, query, settings.overfetch, "chunk_id")
    return temporal_rank(near, settings, home, True, include_invalidated).withColumn("final_score", F.round("final_score", 6)).orderBy(*order).limit(settings.k)


def merge_hits(fts: DataFrame, vec: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Both tiers' hits, one row a key: the best score, of equals the keyword hit; then the first k by score."""
    both = fts.withColumn("tier", F.lit("fts")).unionByName(vec.withColumn("tier", F.lit("vec")))
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.when(F.col("tier") == "fts", 0).otherwise(1), "rank")
    return both.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n").orderBy(F.desc("score"), *keys).limit(k)


def promotion(memory: DataFrame, filtered: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: whether a question that memory cannot answer, and sessions can, should become a memory."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = n(memory, "n_memory").join(F.broadcast(n(filtered, "n_filtered"))).join(F.broadcast(n(sessions, "n_sessions")))
    return counts.withColumn("promote", (F.col("n_memory") == 0) & (F.col("n_filtered") == 0) & (F.col("n_sessions") > 0))
