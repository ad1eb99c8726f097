"""Vector codes and hard negatives: SQL, brute force, odd rows."""

import math

import numpy as np
import pytest

from quern.llm import hard_negatives, registry, vector_codes
from tests.compare import differences

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<double>, label int, code string, error long, id long, score long, vec string, v int"


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_same_rows_as_sql(spark, name):
    assert not differences(spark, registry.queries()[name], registry.oracles()[name], SF)[:3]


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, 3, "y", 4) for i, v, label in rows], KIND)


def plain_nearest(x, book):
    far = [sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
    return far.index(min(far)), min(far)


def test_partial_distances_give_the_nearest_entry():
    rng = np.random.default_rng(1)
    for trial in range(40):
        n, k, w = rng.integers(1, 60), rng.integers(1, 65), rng.integers(1, 9)
        top = 2 if trial % 3 == 0 else 300  # small numbers tie often
        x, book = rng.integers(-top, top, (n, w)), rng.integers(-top, top, (k, w))
        entry, away = vector_codes.nearest(x, book)
        assert list(zip(entry.tolist(), away.tolist(), strict=True)) == [plain_nearest(r, book) for r in x]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    whole = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(whole[0][1]) // parts
    whole = [r for r in whole if len(r[1]) == w * parts]
    books = [[r[1][p * w : (p + 1) * w] for r in whole[:entries]] for p in range(parts)]
    near = lambda: [[plain_nearest(r[1][p * w : (p + 1) * w], books[p]) for p in range(parts)] for r in whole]
    for _ in range(rounds):
        held = near()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [r[1][p * w : (p + 1) * w] for r, h in zip(whole, held, strict=True) if h[p][0] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    held = near()
    return sorted((r[0] is None, r[0], "".join(f"{h[p][0]:02x}" for p in range(parts)), sum(x[1] for x in h), r[2]) for r, h in zip(whole, held, strict=True))


def odd_vectors(n=150, d=32, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(scale=0.2, size=d).round(2).tolist(), int(i) % 4 if i % 11 else None) for i in rng.permutation(n) - 20]
    rows += [(7, None, 1), (8, [], 1), (9, [0.1] * (d - 1) + [None], 1), (10, [0.1] * (d - 1) + [float("nan")], 1), (11, [float("-inf")] * d, 2), (12, [0.5] * (d // 2), 1), (13, [0.5] * (d + 1), 1)]
    rows += [rows[0], rows[0], (None, [0.25] * d, 2), (None, None, None), (500, [-0.001] * d, None), (501, [1e9] + [0.0] * (d - 1), 3)]
    return rows


def test_codes_equal_a_plain_quantiser(spark):
    rows = odd_vectors()
    clipped = [(i, v and [x if x is None or not math.isfinite(x) else min(x, (1 << 26) / 256) for x in v], label) for i, v, label in rows]
    want = plain_codes(clipped)
    got = vector_codes.code_report(table(spark, rows)).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.code, r.error) for r in got) == [r[:4] for r in want]
    total = {label: sum(r[3] for r in want if r[4] == label) for label in {r[4] for r in want}}
    assert sorted(r.label_error for r in got) == sorted(total[r[4]] for r in want) and len({r.codebooks_sha256 for r in got}) == 1


def test_codes_of_few_or_no_rows(spark):
    few = vector_codes.code_report(table(spark, odd_vectors(3)[:3])).collect()
    assert len(few) == 3 and all(r.error == 0 for r in few)
    assert vector_codes.code_report(table(spark, [])).collect() == [] == vector_codes.code_report(table(spark, [(1, None, 1)])).collect()
    assert vector_codes.code_report(table(spark, [])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_decoded_codes_have_the_stated_error(spark):
    made, books = vector_codes.compress(spark.read.parquet(f"{SF}/embeddings.parquet"))
    held = {r.vec_id: r for r in made.collect()}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()[:50]:
        x = np.floor(np.array(r.embedding, dtype=np.float64) * 256).astype(np.int64)
        code = np.frombuffer(bytes.fromhex(held[r.vec_id].code), dtype=np.uint8)[None, :].astype(np.int64)
        assert ((vector_codes.decode(code, books)[0] - x) ** 2).sum() == held[r.vec_id].error


def plain_negatives(rows, k=5):
    live = [(i, (None if label is None else (label + 1) % 10 if i is not None and i % 7 == 0 else label), [max(min(math.floor(256 * x), 1 << 26), -(1 << 26)) for x in v]) for i, v, label in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    if not live:
        return []
    d = len(min(live, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[2])
    live = [r for r in live if len(r[2]) == d]
    out = []
    for i, label, q in sorted({(i, label, tuple(v)) for i, label, v in live if i is not None and i % 100 == 0}):
        by = sorted(((sum(a * b for a, b in zip(q, v, strict=True)), j, lab) for j, lab, v in live), key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        for ps, j, _ in [r for r in by if r[2] == label and r[1] != i][:k]:
            fit = [r for r in by if r[2] != label and 80 * ps <= 100 * r[0] <= 100 * ps][:k]
            out += [(i, j, n + 1, r[1], ps, r[0]) for n, r in enumerate(fit)]
    return sorted(out, key=repr)


def hard_rows(n, d, seed, flat=False):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(8, d))
    rows = []
    for i in range(n):
        v = middle[rng.integers(8)] * 0.2 + rng.normal(scale=0.05, size=d) + 0.15
        rows.append((i * 10, np.full(d, 0.25).tolist() if flat and i % 3 == 0 else v.round(2).tolist(), int(rng.integers(4)) if i % 3 else 1))
    return rows


@pytest.mark.parametrize("block,bucket", [(4096, 64), (60, 4), (25, 1)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 100)
    rows = hard_rows(300, 16, block, flat=True)  # a third of the rows are one vector: scores tie, ids decide
    rows += [rows[0], rows[10], (0, [0.3] * 16, 1), (None, [0.3] * 16, 1), (None, [0.2] * 16, 2), (-100, [0.1] * 16, 2), (3, None, 1), (4, [0.1] * 15 + [None], 1), (5, [float("inf")] * 16, 1), (6, [0.1] * 16, None), (900_000, [0.1] * 3, 1), (700, [3e7] * 16, 2), (800, [-0.2] * 16, 3)]
    got = [tuple(r) for r in hard_negatives.mine(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == plain_negatives(rows) and len(got) > 300


def test_negatives_of_few_or_no_rows(spark):
    assert hard_negatives.mine(table(spark, [])).collect() == []
    assert hard_negatives.mine(table(spark, [(100, [0.1, 0.2], 1)])).collect() == []
    two = hard_negatives.mine(table(spark, [(100, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 2)])).collect()
    assert [tuple(r) for r in two] == [(100, 1, 1, 2, 32768, 32768)]
    assert hard_negatives.mine(table(spark, [(100, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [0.0, 0.0], 2)])).count() == 1
