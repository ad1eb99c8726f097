"""Toxicity by a factorization machine over hashed terms.

Terms are lower-case runs of letters and digits and their beginnings, hashed into 2**BITS buckets. A document's score is a bias, a weight
for each of its buckets and the inner products of all pairs of their factors, through the logistic function. The
machine learns from a bounded sample of labelled documents, over the buckets that tell the classes apart.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, keep, map_texts, read_table, staged

BITS = 22
#: Labelled documents of each class that the machine learns from, at most: those with the least hashes of their ids.
TRAIN_ROWS = 6000
#: Documents of the sample that a bucket must be in for the machine to know it, and its least G (chance: 1 in 10,000). All
#: that pass are known: some 1,900 on 0.1 GB, a bounded number as the sample is bounded.
LEAST_DOCS, LEAST_G = 4, 15.1
#: Lengths of the beginnings that count as terms of their own.
STEMS = (4, 5, 6)
FACTORS = 8
#: Bytes of known words that a Python worker keeps, each with ENTRY more for itself; words of over KEPT bytes are not kept.
CACHE_BYTES, ENTRY, KEPT = 96 << 20, 200, 256
TERM = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def buckets_of(word: bytes) -> tuple[int, ...]:
    """A word's terms and the beginnings that longer ones share with their inflected and compound forms."""
    terms = [x for t in TERM.findall(word.decode().lower()) for x in (t, *(f"{t[:n]}-" for n in STEMS if len(t) > n))]
    return tuple(zlib.crc32(t.encode()) & (1 << BITS) - 1 for t in terms)


def document_buckets(text: bytes | None) -> list[int]:
    """Distinct buckets of a whole text, sorted."""
    return sorted({b for w in set((text or b"").split()) for b in buckets_of(w)})


@dataclass
class Machine:
    """Bias, weights and factors over the known buckets (sorted)."""

    known: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    index: dict[int, int] = field(default_factory=dict)
    cache: dict[bytes, tuple[int, ...]] = field(default_factory=dict)
    held: int = 0  # bytes of the cache

    def raw(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the logistic function of documents given as places of known buckets, one after the other."""
        linear, sums, squares = segment(self.weight[flat], starts), segment(self.factor[flat], starts), segment(self.factor[flat] ** 2, starts)
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(-1)

    def score_texts(self, texts: list[bytes | None]) -> np.ndarray:
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        words = [set((t or b"").split()) for t in texts]
        if new := set().union(*words).difference(self.cache):
            if not self.index:
                self.index.update((int(b), i) for i, b in enumerate(self.known))
            for w in new:
                if len(w) <= KEPT:
                    self.cache[w] = at = tuple(self.index[b] for b in buckets_of(w) if b in self.index)
                    self.held += len(w) + 8 * len(at) + ENTRY

        def get(w: bytes) -> tuple[int, ...]:
            return self.cache[w] if len(w) <= KEPT else tuple(self.index[b] for b in buckets_of(w) if b in self.index)

        found = [sorted(set().union(*map(get, w))) for w in words]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        raw = self.raw(np.array([i for x in found for i in x], dtype=np.int64), np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def segment(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs that begin at starts; a run may be empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.r_[starts[1:], len(values)].astype(np.int64)
    return total[ends] - total[starts]


def fit(docs: list[np.ndarray], y: np.ndarray, known: np.ndarray, steps: int = 4000, batch: int = 64, rate: float = 0.15, ridge: float = 2e-4, seed: int = 7) -> Machine:
    """Stochastic gradient descent with per-parameter steps on the logistic loss; classes weigh the same."""
    rng = np.random.default_rng(seed)
    n = len(known)
    m = Machine(known, 0.0, np.zeros(n), rng.normal(0, 0.02, (n, FACTORS)))
    seen_b, seen_w, seen_v = 1e-2, np.full(n, 1e-2), np.full((n, FACTORS), 1e-2)
    share = float(y.mean())
    weights = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    sizes = np.array([len(d) for d in docs])
    for _ in range(max(12, -(-steps * batch // max(1, len(docs))))):
        for part in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
            flat = np.concatenate([docs[i] for i in part])
            size = sizes[part]
            starts = np.cumsum(size) - size
            sums = segment(m.factor[flat], starts)
            raw = m.bias + segment(m.weight[flat], starts) + 0.5 * (sums**2 - segment(m.factor[flat] ** 2, starts)).sum(-1)
            slope = weights[part] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
            each = np.repeat(slope, size)
            ids, back = np.unique(flat, return_inverse=True)
            gw = np.bincount(back, each, minlength=len(ids)) + ridge * m.weight[ids]
            inner = each[:, None] * (np.repeat(sums, size, axis=0) - m.factor[flat])
            gv = np.stack([np.bincount(back, inner[:, k], minlength=len(ids)) for k in range(FACTORS)], 1) + ridge * m.factor[ids]
            seen_b += slope.sum() ** 2
            m.bias -= rate * slope.sum() / np.sqrt(seen_b)
            seen_w[ids] += gw**2
            m.weight[ids] -= rate * gw / np.sqrt(seen_w[ids])
            seen_v[ids] += gv**2
            m.factor[ids] -= 0.3 * rate * gv / np.sqrt(seen_v[ids])
    return m


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine | None:
    """A machine from labels (doc_id, toxic), of several labels of a document the largest; None without both classes.

    docs is a DataFrame of keep(). Buckets are counted by class on the executors; the driver gets those that pass the tests and
    the sample's documents, reduced to these.
    """
    spark = docs.sparkSession
    by = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    by = staged(by.join(docs.select("doc_id"), "doc_id", "left_semi"), "labelled")  # labels without a document do not use up the sample
    chosen = [(r.doc_id, r.y) for k in (0, 1) for r in by.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    if len({y for _, y in chosen}) < 2:
        return None
    ids = spark.createDataFrame(chosen, "doc_id long, y int")
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("buckets", pa.list_(pa.int32()))])

    def terms(ids_: list[int], texts: list[bytes | None], ys: list[int]) -> dict:
        return {"doc_id": ids_, "y": ys, "buckets": [document_buckets(t) for t in texts]}

    sample = staged(map_texts(docs.join(F.broadcast(ids), "doc_id"), terms, schema, "doc_id long, y int, buckets array<int>", ["y"]), "sample")
    n0, n1 = (sample.where(F.col("y") == k).count() for k in (0, 1))
    if not n0 or not n1:
        return None
    a, b = F.col("a"), F.col("b")
    counts = sample.select("y", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum(F.col("y")).cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b")).where(a + b >= LEAST_DOCS)
    share = (a + b) / float(n0 + n1)
    likelihood = sum((x * F.log((x + 1e-9) / (n * share)) + (n - x) * F.log((n - x + 1e-9) / (n * (1 - share) + 1e-9)) for x, n in ((a, float(n1)), (b, float(n0)))), F.lit(0.0))
    best = counts.select("bucket", F.round(2 * likelihood, 6).alias("g")).where(F.col("g") >= LEAST_G).collect()  # of the bounded sample
    known = np.array(sorted(r.bucket for r in best), dtype=np.int64)
    wanted = spark.createDataFrame([(int(x),) for x in known], "bucket int")
    reduced = sample.select("doc_id", "y", F.explode_outer("buckets").alias("bucket")).join(F.broadcast(wanted.withColumn("in", F.lit(True))), "bucket", "left").groupBy("doc_id", "y").agg(F.sort_array(F.collect_set(F.when(F.col("in"), F.col("bucket")))).alias("buckets"))
    got = sorted((r.doc_id, r.y, r.buckets) for r in reduced.collect())
    return fit([np.searchsorted(known, x) for _, _, x in got], np.array([y for _, y, _ in got], dtype=float), known)


def score(df: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row, in one pass without a shuffle.

    Null and empty texts get the score of no terms, below one half unless toxic texts are empty too; without a machine
    all scores are 0. Repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    shipped = df.sparkSession.sparkContext.broadcast(machine)  # bounded by the sample: FACTORS + 2 numbers a known bucket

    def run(ids: list[int], texts: list[bytes | None]) -> dict:
        s = shipped.value.score_texts(texts) if shipped.value is not None else np.zeros(len(ids))
        return {"doc_id": ids, "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return map_texts(keep(df, id_col, text_col), run, schema, "doc_id long, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    machine = learn(keep(docs, "doc_id", "text"), labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    return score(docs, machine).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
