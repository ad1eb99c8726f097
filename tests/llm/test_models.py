"""Quality rules, toxicity, language ID and mixing: brute force, held-out accuracy, odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import language_id, mixing, quality, toxicity
from quern.llm.common import keep
from tests.llm.edge import PROSE, empty, labels, odd

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_base_rules_and_verdicts(spark):
    from quern.llm.registry import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries()["op8_quality_rules"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, *rest = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[3] > 50 * n) and not (r.kept and r.base_failed)
    seen = [r for r in rows if r.doc_id in marks and not r.base_failed]
    assert np.mean([r.kept == bool(marks[r.doc_id]) for r in seen]) > 0.97


def test_trees_agree_with_a_plain_walk_and_keep_their_signs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=3000) > 0).astype(float)
    trees = quality.fit(x, y, np.array([1, -1, 1, 0]), trees=30)

    def walk(row):
        total = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        return 1 / (1 + np.exp(-total))

    got = trees.score(x[:200])
    assert np.allclose(got, [walk(r) for r in x[:200]]) and np.mean((got > 0.5) == y[:200]) > 0.8
    grid = np.linspace(-4, 4, 81)
    for j, sign in ((0, 1), (1, -1), (2, 1)):
        for base in x[:40]:
            line = np.repeat(base[None], len(grid), 0)
            line[:, j] = grid
            assert (sign * np.diff(trees.score(line)) >= -1e-12).all()


def test_quality_of_odd_rows(spark):
    rows = quality.judge(odd(spark), None).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 19 and by[3].base_failed and by[3].n_words == 0 and by[1].kept and by[15].n_dup_lines == 1
    assert quality.judge(empty(spark), None).count() == 0 and quality.learn(keep(empty(spark), "doc_id", "text"), labels(spark)) is None
    assert quality.learn(keep(odd(spark), "doc_id", "text"), labels(spark, [(1, 1, 0), (2, None, None), (None, 0, 0)])) is None
    kept = quality.keep_good(odd(spark), labels(spark))
    assert kept.columns == odd(spark).columns and {r.doc_id for r in kept.collect()} >= {1, 2} and quality.keep_good(empty(spark), labels(spark)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    from quern.llm.registry import queries

    marks = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = queries()["op3_toxicity"](spark, "/root/testdata/sf0.1").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) > 0.98
    assert np.mean([r.predicted for r in held if marks[r.doc_id]]) > 0.85


def test_pairs_are_learnt():
    """Only two terms together are toxic: weights alone cannot tell, factors can."""
    rng = np.random.default_rng(0)
    docs, y = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        docs.append(np.array(sorted({int(x) for x in rng.integers(2, 12, 3)} | ({0} if a else set()) | ({1} if b else set()))))
        y.append(float(a == b))
    m = toxicity.fit(docs, np.array(y), np.arange(12))
    flat, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    assert np.mean((m.raw(flat, np.cumsum(sizes) - sizes) > 0) == np.array(y)) > 0.97


def test_toxicity_of_odd_rows(spark):
    assert toxicity.learn(keep(odd(spark), "doc_id", "text"), labels(spark)) is None and toxicity.score(empty(spark), None).count() == 0
    many = spark.createDataFrame([(i, PROSE + (" vile" if i % 2 else " kind"), None) for i in range(100)], "doc_id long, text string, lang string")
    m = toxicity.learn(keep(many, "doc_id", "text"), labels(spark, [(i, 1, i % 2) for i in range(100)] + [(3, 1, None), (None, 1, 1)]))
    assert all(r.predicted == r.doc_id % 2 for r in toxicity.score(many, m).collect())
    rows = {r.doc_id: r for r in toxicity.score(odd(spark), m).collect()}
    assert rows[3].score == rows[4].score < 0.99 and len(toxicity.score(odd(spark), m).collect()) == 19


def test_language_on_held_out_rows(spark):
    from quern.llm.registry import queries

    real = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op10_language_id"](spark, SF).collect()
    assert len(rows) == len(real) and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == real[r.doc_id] for r in rows if r.held_out]) > 0.98


def test_kneser_ney_is_a_distribution():
    m = language_id.fit({"x": {"abba": 3, "baab": 1, "ab": 2}, "y": {"zz": 1}})
    for context in ("", "a", "ab", "abb", "zzz"):
        words = [context + c for c in "abz"]
        cost, _ = m.costs([*words, context]) if context else m.costs(words)
        flat, place = language_id.codes_of(words)
        hashes = language_id.grams(flat, place, language_id.ORDER)
        total = 0.0
        for c in [ord("a"), ord("b"), ord("z"), 1]:
            f = np.r_[np.uint64(1), np.frombuffer(context.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64), np.uint64(c)].astype(np.uint64)
            pl = np.arange(len(f))
            h = language_id.grams(f, pl, language_id.ORDER)
            p = 1.0 / m.alphabet
            for n in range(1, language_id.ORDER + 1):
                if pl[-1] >= max(1, n - 1):
                    ctx = h[n - 1][-2:-1] if n > 1 else h[0][-1:]
                    p = language_id.look(m.shares[n - 1], h[n][-1:], 0.0)[0, 0] + language_id.look(m.weights[n - 1], ctx, 1.0)[0, 0] * p
            total += p
        assert 0.7 < total <= 1 + 1e-9  # the rest is left for characters that were not seen
        assert (cost >= 0).all()


def test_language_of_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = language_id.identify(odd(spark), None).collect()
    assert len(rows) == 19 and {r.lang_pred for r in rows} == {"und"}
    m = language_id.learn(odd(spark).select("doc_id", "text", "lang"), F.lit(True))
    by = {r.doc_id: r for r in language_id.identify(odd(spark), m).collect()}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == by[10].lang_pred == "und" and by[3].score == 0 and by[1].lang_pred == "en" and by[7].lang_pred != "und"
    assert language_id.learn(empty(spark).select("doc_id", "text", "lang"), F.lit(True)) is None and language_id.identify(empty(spark), m).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, target = share * sum(sizes.values()), set(), {}
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = [s for s in names if s not in full]
        level = left / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if w[s] * level > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in full else w[s] * level for s in names}
        full |= set(over)


def check_mix(rows, sizes):
    want = brute_targets(sizes)
    got = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and 0 <= r.taken <= 2 * r.size
        got[r.source] += r.taken
    return want, got


def test_mix(spark):
    from quern.llm.registry import queries

    texts = [(r.source, len(WORD.findall(r.text or ""))) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()]
    sizes = Counter()
    for s, n in texts:
        sizes[s] += n
    q = queries()["op6_mixing"]
    rows = q(spark, "/root/testdata/sf0.1").collect()
    want, got = check_mix(rows, sizes)
    largest = max(n for _, n in texts)
    assert len(rows) == len(texts) and all(abs(got[s] - want[s]) <= largest for s in want)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, q(spark, "/root/testdata/sf0.1").repartition(7).collect()))


def test_mix_of_odd_rows(spark):
    rows = mixing.mix_report(odd(spark)).collect()
    sizes = Counter()
    for r in odd(spark).collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    check_mix(rows, sizes)
    assert len(rows) == 19 and mixing.mix_report(empty(spark)).count() == 0
    out = mixing.apply_mix(odd(spark))
    by = Counter(r.doc_id for r in out.collect())
    assert out.columns == odd(spark).columns and by == {k: v for k, v in Counter({r.doc_id: sum(x.copies for x in rows if x.doc_id == r.doc_id) for r in rows}).items() if v}
    assert mixing.apply_mix(empty(spark)).count() == 0


def test_long_ids_beside_a_null_one(spark):
    ids = [(1 << 60) + 2 * i + 1 for i in range(200)] + [None]
    df = spark.createDataFrame([(i, "one two three " * (1 + k % 5), "s") for k, i in enumerate(ids)], "doc_id long, text string, source string")
    rows = mixing.mix_report(df).collect()
    assert Counter(r.doc_id for r in rows) == Counter(ids)
    assert Counter(r.doc_id for r in mixing.apply_mix(df).collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_flight_keeps_totals():
    import random

    rng = np.random.default_rng(4)
    sizes, chances = rng.integers(0, 5000, 4000).astype(float).tolist(), rng.uniform(0, 1, 4000).tolist()
    p = mixing.fly(sizes, chances, random.Random(1), False)
    assert sum(0 < x < 1 for x in p) <= 2
    assert abs(np.dot(sizes, p) - np.dot(sizes, chances)) < 1e-3 and abs(sum(p) - sum(chances)) < 1e-6
    done = mixing.fly(sizes, chances, random.Random(1), True)
    assert set(done) <= {0.0, 1.0} and abs(np.dot(sizes, done) - np.dot(sizes, chances)) <= 5000
    mean = np.mean([mixing.fly([3.0, 5.0, 7.0, 9.0, 4.0], [0.3] * 5, random.Random(i), True) for i in range(4000)], axis=0)
    assert np.allclose(mean, 0.3, atol=0.04)


@pytest.mark.parametrize("counts", [{"b": 10, "a": 100, None: 3}, {"é": 5, "z": 5, "Z": 5, "a": 1000}, {"s": 0, "t": 7}])
def test_targets(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute_targets(counts)
    assert all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in want)


def test_machine_equals_a_plain_pair_sum():
    from quern.llm.toxicity import Machine

    rng = np.random.default_rng(8)
    m = Machine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    docs = [[0, 3, 5], [], [8], list(range(9)), [1, 2]]
    flat, sizes = np.array([i for d in docs for i in d]), np.array(list(map(len, docs)))
    plain = [0.3 + sum(m.weight[i] for i in d) + sum(float(m.factor[i] @ m.factor[j]) for a, i in enumerate(d) for j in d[a + 1 :]) for d in docs]
    assert np.allclose(m.raw(flat, np.cumsum(sizes) - sizes), plain)


def plain_kneser_ney(words, order, letters):
    """Cost of a word by plain dictionaries of strings, as the docstring of language_id.fit() has it."""
    marked = {f"\1{w}\1": n for w, n in words.items()}
    models = []
    for n in range(1, order + 1):
        times, before = Counter(), defaultdict(set)
        for w, k in marked.items():
            for p in range(max(1, n - 1), len(w)):
                times[w[p - n + 1 : p + 1]] += k
                if n < order and p >= n:
                    before[w[p - n + 1 : p + 1]].add(w[p - n])
        amount = {g: len(before[g]) if g in before else k for g, k in times.items()}
        n1, n2 = sum(v == 1 for v in amount.values()), sum(v == 2 for v in amount.values())
        off = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
        total, kinds = Counter(), Counter()
        for g, v in amount.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        models.append((amount, off, total, kinds))

    def cost(word):
        w, out = f"\1{word}\1", 0.0
        for p in range(1, len(w)):
            prob = 1 / (len(letters) + 1)
            for n, (amount, off, total, kinds) in enumerate(models, 1):
                if p < n - 1:
                    continue
                g = w[p - n + 1 : p + 1]
                if total[g[:-1]]:
                    prob = max(amount.get(g, 0) - off, 0) / total[g[:-1]] * (g in amount) + off * kinds[g[:-1]] / total[g[:-1]] * prob
            out -= np.log(prob)
        return out

    return cost


def test_costs_equal_plain_kneser_ney():
    from quern.llm.language_id import ORDER, fit

    counts = {"en": {"the": 40, "then": 9, "other": 5, "there": 7, "a": 20, "than": 1}, "de": {"der": 30, "oder": 8, "andere": 3, "die": 25, "das": 20, "ändern": 1}}
    models = fit(counts)
    letters = set("".join(w for x in counts.values() for w in x)) | {"\1"}
    words = ["the", "other", "oder", "xyz", "an", "t", "theretofore", "ändere"]
    got, _ = models.costs(words)
    for k, lang in enumerate(models.langs):
        plain = plain_kneser_ney(counts[lang], ORDER, letters)
        assert np.allclose(got[:, k], [plain(w) for w in words])
