"""An inverted-file vector index: rows in lists around centroids, found by probing a few lists or, exactly, by bounds.

Centroids are fitted by k-means on a bounded sample (SAMPLE rows, those of the least hash of their id); every row is
assigned to its nearest one. Rows are range-partitioned and sorted by list, so that a search reads the lists that it
probes. Queries are a stated set and go to the tasks in blocks; a task multiplies the rows of a list with the queries
that probe it and keeps k rows a query. The exact way probes first, which gives every query a k-th score, and then reads
those further lists alone whose centroid's distance less the list's radius could still beat it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions.vectors import TINY
from quern.store import staged

#: Rows that centroids are fitted on, rounds of k-means, lists at most, queries of a block.
SAMPLE, ROUNDS, MOST_LISTS, BLOCK = 8192, 10, 1024, 4096
#: How many lists a search probes follows from the sample: so many of its rows ask for so many neighbours, of which this share must be found.
TRIED, NEIGHBOURS, RECALL = 256, 10, 0.95
LAYOUT = {"parquet.page.row.count.limit": "1024", "parquet.block.size": str(16 << 20)}
#: Scores are compared as they are reported, to six digits.
DIGITS, SLACK = 6, 2e-6


def matrix(column: pa.Array) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return v.reshape(len(column), -1) if len(column) else v.reshape(0, 1)


def units(v: np.ndarray) -> np.ndarray:
    return v / (np.sqrt((v * v).sum(axis=1)) + TINY)[:, None]


def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a to the rows of b."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0))


def fit(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids by k-means from evenly chosen rows; one that loses all rows takes the row that is farthest off."""
    centers = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)].copy()
    for _ in range(ROUNDS):
        away = far(sample, centers)
        near = away.argmin(axis=1)
        many = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        centers[many > 0] = sums[many > 0] / many[many > 0, None]
        lost = np.flatnonzero(many == 0)
        centers[lost] = sample[np.argsort(-away.min(axis=1), kind="stable")[: len(lost)]]
    return centers


def enough(sample: np.ndarray, centers: np.ndarray) -> int:
    """Lists to probe so that rows of the sample find RECALL of their neighbours in it."""
    if not len(centers):
        return 1
    home = far(sample, centers).argmin(axis=1)
    asked = sample[np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int)]
    near = np.argsort(far(asked, sample), axis=1, kind="stable")[:, :NEIGHBOURS]
    rank = np.argsort(np.argsort(far(asked, centers), axis=1, kind="stable"), axis=1)  # of every list, by distance
    needed = np.sort(np.take_along_axis(rank, home[near], axis=1).ravel()) + 1
    return int(needed[int(np.ceil(RECALL * len(needed))) - 1])


class VectorIndex:
    """rows (id, vector, list), the lists' centroids and radii, and how many are probed; cosine: by angle, else by distance."""

    def __init__(self, rows: DataFrame, id_col: str, vector_col: str, centers: np.ndarray, radius: np.ndarray, cosine: bool, probes: int):
        self.rows, self.id_col, self.vector_col, self.centers, self.radius, self.cosine, self.probes = rows, id_col, vector_col, centers, radius, cosine, probes

    @classmethod
    def build(cls, df: DataFrame, id_col: str, vector_col: str = "embedding", lists: int | None = None, cosine: bool = True) -> VectorIndex:
        """Rows without a vector are left out. lists: by default the root of the number of rows, MOST_LISTS at most."""
        there = df.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
        many = there.count()
        sample = np.array([r[0] for r in there.orderBy(F.xxhash64(id_col), id_col).select(vector_col).limit(SAMPLE).collect()], dtype=np.float64).reshape(min(many, SAMPLE), -1 if many else 1)
        sample = units(sample) if cosine else sample
        centers = fit(sample, lists or max(1, min(MOST_LISTS, round(many**0.5)))) if many else sample
        shape = T.StructType().add(df.schema[id_col]).add(df.schema[vector_col]).add("list", T.IntegerType()).add("away", T.DoubleType())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    piece = batch.slice(lo, 2048)
                    v = matrix(piece.column(1))
                    away = far(units(v) if cosine else v, centers)
                    at = away.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(at, pa.int32()), pa.array(away[np.arange(len(at)), at])], names=[id_col, vector_col, "list", "away"])

        dealt = there.mapInArrow(run, shape)
        rows = staged(dealt.repartitionByRange("list", F.xxhash64(id_col)).sortWithinPartitions("list"), "lists", layout=LAYOUT)  # a hot list is split too
        radius = np.zeros(len(centers))
        for r in rows.groupBy("list").agg(F.max("away").alias("radius")).collect():  # a row a list
            radius[r["list"]] = r.radius
        return cls(rows.drop("away"), id_col, vector_col, centers, radius, cosine, enough(sample, centers))

    def _found(self, q: np.ndarray, asks: np.ndarray, k: int) -> DataFrame:
        """i (the query's place), id and score of the k best rows a task has for each query in the lists that it asks (queries x lists)."""
        some = np.flatnonzero(asks.any(axis=0))
        kind = self.rows.schema[self.id_col].dataType
        arrow, cosine, id_col = to_arrow_type(kind), self.cosine, self.id_col
        of_list = {int(c): np.flatnonzero(asks[:, c]) for c in some}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple]] = {}
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    piece = batch.slice(lo, 2048)
                    ids, v, lists = piece.column(0).to_pylist(), matrix(piece.column(1)), piece.column(2).to_numpy()
                    v = units(v) if cosine else v
                    for c in np.unique(lists).tolist():
                        mine, who = np.flatnonzero(lists == c), of_list.get(c, ())
                        if not len(who):
                            continue
                        scores = np.round(q[who] @ v[mine].T if cosine else -far(q[who], v[mine]), DIGITS) + 0.0
                        least = np.partition(scores, -k, axis=1)[:, -k] if len(mine) > k else np.full(len(who), -np.inf)
                        for row, i in enumerate(who.tolist()):
                            new = [(-float(scores[row, j]), ids[mine[j]]) for j in np.flatnonzero(scores[row] >= least[row]).tolist()]
                            best[i] = sorted(best.get(i, []) + new)[:k]
            out = [(i, x, -s) for i, found in best.items() for s, x in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], arrow), pa.array([r[2] + 0.0 for r in out], pa.float64())], names=["i", id_col, "score"])

        shape = T.StructType().add("i", T.IntegerType()).add(self.id_col, kind).add("score", T.DoubleType())
        rows = self.rows if len(some) == len(self.centers) else self.rows.where(F.col("list").isin(some.tolist()))
        return rows.select(self.id_col, self.vector_col, "list").mapInArrow(run, shape)

    def _first(self, found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("i").orderBy(F.desc("score"), self.id_col)
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """probe, id, score and rank of the k best rows of every query (probe, query), ties by id.

        score is the cosine, or the negative distance, to six digits. Approximate searches read the `probes` nearest
        lists of a query, by default as many as the sample needed for RECALL; exact ones find what a scan of all rows
        finds. Queries are taken in blocks.
        """
        probes = probes or self.probes
        spark = queries.sparkSession
        kinds = [queries.schema["probe"], self.rows.schema[self.id_col]]
        out = spark.createDataFrame([], T.StructType().add(kinds[0]).add(kinds[1]).add("score", T.DoubleType()).add("rank", T.IntegerType()))
        blocks = max(1, -(-queries.count() // (BLOCK // 2))) if len(self.centers) else 0
        for b in range(blocks):
            asked = queries.where(F.pmod(F.xxhash64("probe"), F.lit(blocks)) == b).select("probe", "query").collect()
            if not asked:
                continue
            q = np.array([r.query for r in asked], dtype=np.float64)
            q = units(q) if self.cosine else q
            away = far(q, self.centers)
            asks = np.zeros(away.shape, dtype=bool)
            np.put_along_axis(asks, np.argsort(away, axis=1, kind="stable")[:, : min(probes, away.shape[1])], True, axis=1)
            found = self._found(q, asks, k)
            if exact:
                found = staged(self._first(found, k).select("i", self.id_col, "score"), "probed")
                worst = {r.i: r.score for r in found.groupBy("i").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k).collect()}  # a row a query of the block
                least = np.array([worst.get(i, -np.inf) for i in range(len(q))])
                near = np.maximum(away - self.radius[None, :] - SLACK, 0.0)
                top = 1 - near * near / 2 if self.cosine else -near
                rest = ~asks & (top >= least[:, None] - SLACK)
                if rest.any():
                    found = found.unionByName(self._found(q, rest, k))
            named = F.broadcast(spark.createDataFrame([(i, r.probe) for i, r in enumerate(asked)], T.StructType().add("i", T.IntegerType()).add(kinds[0])))
            out = out.unionByName(self._first(found, k).join(named, "i").select("probe", self.id_col, "score", "rank"))
        return out
