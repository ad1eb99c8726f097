"""The inverted-file index: the exact way equals a scan, the approximate one finds nine in ten."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import vector_index
from quern.operators.vector_index import VectorIndex

KIND = "id long, embedding array<double>"


def plain(rows, queries, k, cosine):
    v, q = np.array([r[1] for r in rows]), np.array([x for _, x in queries])
    if cosine:
        score = (q / (np.linalg.norm(q, axis=1)[:, None] + 1e-12)) @ (v / (np.linalg.norm(v, axis=1)[:, None] + 1e-12)).T
    else:
        score = -np.linalg.norm(q[:, None, :] - v[None, :, :], axis=2)
    score = np.round(score, 6) + 0.0
    out = {}
    for i, (p, _) in enumerate(queries):
        best = sorted(range(len(rows)), key=lambda j: (-score[i, j], rows[j][0]))[:k]
        out[p] = [(rows[j][0], round(float(score[i, j]), 5)) for j in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.probe, []).append((r.id, round(r.score, 5)))
    return out


@pytest.mark.parametrize("cosine", [True, False])
def test_exact_search_equals_a_scan(spark, monkeypatch, cosine):
    monkeypatch.setattr(vector_index, "BLOCK", 20)  # several blocks of queries
    rng = np.random.default_rng(3)
    v = rng.normal(size=(12, 8))[rng.integers(0, 12, 700)] + 0.3 * rng.normal(size=(700, 8))
    v[::3] = v[0]  # a third of the rows are one vector: one list is hot, scores tie
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    queries = [(i, v[i].tolist()) for i in range(1, 60, 2)] + [(1000, [0.0] * 8)]
    df = spark.createDataFrame([*rows, (9999, None)], KIND)
    index = VectorIndex.build(df, "id", lists=20, cosine=cosine)
    asked = spark.createDataFrame(queries, "probe long, query array<double>")
    assert found(index.search(asked, 5, probes=2, exact=True)) == plain(rows, queries, 5, cosine)
    assert index.rows.count() == 700


def test_nine_in_ten_are_found_in_few_lists(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = [tuple(r) for r in e.collect()]
    queries = [r for r in rows if r[0] % 100 == 0]
    index = VectorIndex.build(e, "id")
    got = found(index.search(e.where("id % 100 = 0").select(F.col("id").alias("probe"), F.col("embedding").alias("query")), 10))
    want = plain(rows, queries, 10, True)
    assert len(index.centers) == 45 > index.probes and sum(len({i for i, _ in got[p]} & {i for i, _ in want[p]}) for p in want) >= 0.9 * 10 * len(want)


def test_index_of_nothing(spark):
    empty = spark.createDataFrame([], KIND)
    index = VectorIndex.build(empty, "id")
    assert index.search(spark.createDataFrame([(1, [0.5])], "probe long, query array<double>"), 3, exact=True).collect() == []
    one = VectorIndex.build(spark.createDataFrame([(1, [0.0, 1.0])], KIND), "id")
    assert one.search(spark.createDataFrame([], "probe long, query array<double>"), 3).collect() == []
    assert [tuple(r) for r in one.search(spark.createDataFrame([(7, [0.0, 2.0])], "probe long, query array<double>"), 3, exact=True).collect()] == [(7, 1, 1.0, 1)]
