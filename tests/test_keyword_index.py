"""The stored keyword index: equal to the scan, reads what it needs, stays right when it grows and shrinks."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import fts, keyword_index
from quern.store import staged


def rows(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    made = [(i, " ".join(rng.choice(words[: rng.choice([3, 20, 300])]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return [*made, (n, None), (n + 1, "rare-one w0"), (n + 2, "w0 " * 50)]


def scanned(df, phrases):
    return {r.id: r.score for r in fts.bm25(df, "id", F.coalesce("text", F.lit("")), phrases).withColumn("score", F.round("score", 6)).collect()}


@pytest.fixture(scope="module")
def index(spark):
    keyword_index.BUCKET, before = 50, keyword_index.BUCKET
    df = spark.createDataFrame(rows(900), "id long, text string")
    blocks, stats, totals = keyword_index.build(df, "id", F.col("text"))
    blocks = staged(blocks, "blocks", layout=keyword_index.LAYOUT)
    yield df, blocks, staged(stats, "stats"), staged(totals, "totals")
    keyword_index.BUCKET = before


@pytest.mark.parametrize("query", ["w0", "w1 w2", "w0 w0 w5", "rare", "rare-one", "w0-w1", "w0-w1 w2", "w250", "w250 w251", "nothing", "w0 nothing", ""])
@pytest.mark.parametrize("first", [1, 16])
def test_index_equals_scan(spark, monkeypatch, index, query, first):
    monkeypatch.setattr(keyword_index, "FIRST", first)
    df, blocks, _, totals = index
    phrases = fts.query_phrases(query)
    want = scanned(df, phrases) if phrases else {}
    assert {r.id: r.score for r in keyword_index.topk(blocks, totals, phrases, None).collect()} == pytest.approx(want, abs=2e-6)
    top = [(r.id, r.score) for r in keyword_index.topk(blocks, totals, phrases, 7).collect()]
    assert top == [(i, pytest.approx(s, abs=2e-6)) for i, s in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:7]]


def scan_rows(df):
    """Rows that the file scans of a collected DataFrame put out."""
    found = []

    def walk(node):
        metrics = node.metrics()
        if node.nodeName().startswith("Scan parquet"):
            found.append(metrics.get("numOutputRows").get().value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(found)


def test_a_rare_term_reads_few_rows(spark, index):
    _, blocks, _, _ = index
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        every, rare = blocks.select("term", "n"), keyword_index.hits(blocks, {"rare", "one"})
        assert len(rare.collect()) == 2 and len(every.collect()) > 3000
        assert 0 < scan_rows(rare) < scan_rows(every) / 10
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_buckets_under_the_threshold_are_not_evaluated(spark, monkeypatch, index):
    _, blocks, _, totals = index
    monkeypatch.setattr(keyword_index, "FIRST", 2)
    seen, real = [], keyword_index.entries_of
    monkeypatch.setattr(keyword_index, "entries_of", lambda b: seen.append(b.select("bucket").distinct().count()) or real(b))
    keyword_index.topk(blocks, totals, [["w7"]], 3).collect()
    assert sum(seen) < blocks.where("term = 'w7'").select("bucket").distinct().count() * 0.7


def test_index_of_parts_and_without_rows(spark, index):
    df, blocks, stats, totals = index
    more = spark.createDataFrame([(5000, "w0 w1 w0"), (5001, "w2")], "id long, text string")
    b, s, t = keyword_index.build(more, "id", F.col("text"))
    both, sums, every = blocks.unionByName(b), totals.unionByName(t), df.unionByName(more)
    assert {r.id: r.score for r in keyword_index.topk(both, sums, [["w0"]], None).collect()} == pytest.approx(scanned(every, [["w0"]]), abs=2e-6)
    gone = spark.createDataFrame([(i,) for i in range(0, 900, 2)], "id long")
    left = stats.unionByName(s).join(gone, "id", "left_anti").agg(F.count("*").alias("docs"), F.sum("dl").alias("tokens"))
    got = keyword_index.topk(keyword_index.without(both, gone), left, [["w0"], ["w1"]], None)
    assert {r.id: r.score for r in got.collect()} == pytest.approx(scanned(every.join(gone, "id", "left_anti"), [["w0"], ["w1"]]), abs=2e-6)
    b, _, t = keyword_index.build(more.limit(0), "id", F.col("text"))
    assert keyword_index.topk(b, t, [["w0"]], 5).collect() == [] and t.first().docs == 0


def test_many_probes_in_one_scan(spark, index):
    df, blocks, _, totals = index
    probes = {i: fts.query_phrases(q) for i, q in enumerate(["w0", "w1 w2", "w0-w1", "nothing", "w0 w0 w3", ""])}
    n = totals.first()
    got = keyword_index.probe_scores(keyword_index.hits(blocks, {t for x in probes.values() for p in x for t in p}), probes, n.docs, n.tokens / n.docs)
    by = {}
    for r in got.collect():
        by.setdefault(r.probe, {})[r.id] = r.score
    for i, phrases in probes.items():
        assert by.get(i, {}) == pytest.approx(scanned(df, phrases) if phrases else {}, abs=2e-6)
