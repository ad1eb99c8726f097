"""Jaccard join, line dedup and suffix dedup against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm.common import components
from quern.llm.jaccard_join import keep_one, shingle_sets, similar
from quern.llm.line_dedup import drop_lines, line_report
from quern.llm.suffix_dedup import COVER, PERIOD, dedup, repeats
from tests.llm.edge import PROSE, empty, odd

SF = "/root/testdata/sf0.001"


class Sets:
    def __init__(self, xs):
        self.up = {x: x for x in xs}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute_groups(rows, k, num, den):
    sets, found = {}, Sets(i for i, _ in rows)
    for i, t in rows:
        w = bytes(t or "", "utf-8").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                found.join(i, j)
    return {i: (len(sets[i]), found.find(i)) for i in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.integers(len(words))] = f"new{rng.integers(10**6)}"
    return " ".join(words)


def near_copies(spark):
    """Chains and groups of copies with few to many edits, of short and long texts, around a shared passage."""
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for base in range(12):
        words = [f"w{rng.integers(900)}" for _ in range(int(rng.integers(3, 400)))]
        if base % 2:
            words = words[: len(words) // 2] + PROSE.split() + words[len(words) // 2 :]
        for n in (0, 0, 1, 1, 2, 3, 5, 8, 13):
            rows.append((i, edited(rng, words, n)))
            i += 7
    rows += [(10_000 + j, "tiny text") for j in range(5)] + [(10_010, "a b c d e f"), (10_011, "a b c d e f g"), (10_012, "A B C D E F G")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80), (3, 70)])
def test_join_is_exact(spark, k, num):
    df, rows = near_copies(spark)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar(df, k, num, 100).collect()} == brute_groups(rows, k, num, 100)


def test_op4_is_exact(spark):
    from quern.llm.registry import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries()["op4_jaccard_join"](spark, SF).collect()} == brute_groups(rows, 4, 85, 100)


def test_join_of_odd_rows(spark):
    rows = similar(odd(spark), 4, 85, 100).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 19 and by[2].component_id == 1 and by[3].n_shingles == 0 and by[5].component_id == 5 and by[12].component_id == by[13].component_id == 11 and by[9].component_id == 8
    assert similar(empty(spark)).count() == 0 == keep_one(empty(spark)).count()
    kept = keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and {2, 12, 13}.isdisjoint({r.doc_id for r in kept.collect()})


def test_tiles_agree(spark, monkeypatch):
    from quern.llm import jaccard_join

    df, rows = near_copies(spark)
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar(df, 4, 85, 100).collect()} == brute_groups(rows, 4, 85, 100)


def near_group(spark, size=240):
    """One large group of near copies of one text, with so many edits that links and non-links mix."""
    rng = np.random.default_rng(11)
    words = [f"w{rng.integers(5000)}" for _ in range(400)]
    rows = [(i, edited(rng, words, int(rng.integers(0, 9)))) for i in range(size)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("tile", [2048, 16])
def test_group_of_near_copies_is_exact_and_makes_few_pairs(spark, monkeypatch, tile):
    from quern.llm import jaccard_join

    df, rows = near_group(spark)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    made, real = [], jaccard_join.verify
    monkeypatch.setattr(jaccard_join, "verify", lambda pairs, *a: made.append(pairs.count()) or real(pairs, *a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar(df, 4, 90, 100).collect()}
    assert got == brute_groups(rows, 4, 90, 100) and 10 < len({c for _, c in got.values()}) < 230
    assert max(made) < 240 * 239 / 8


def test_a_passage_that_all_documents_share_is_no_key(spark, monkeypatch):
    """Keys and pairs grow with the documents that are alike, not with a common passage; links stay exact."""
    from quern.llm import jaccard_join

    rng = np.random.default_rng(3)
    shared = " ".join(f"foot{i}" for i in range(40))
    fresh = lambda: [f"w{x}" for x in rng.integers(0, 1 << 30, 40)]
    texts = [fresh() for _ in range(1200)]
    texts += [[*t[:20], "x", *t[21:]] for t in texts[:30]]
    rows = [(i, f"{' '.join(t)} {shared}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = jaccard_join.rarest(jaccard_join.keys(df, 4, 85, 100))
    assert keyed.groupBy("key").count().agg({"count": "max"}).first()[0] < 20
    got = {r.doc_id: r.component_id for r in similar(df, 4, 85, 100).collect()}
    assert got == {i: i - 1200 if i >= 1200 else i for i in range(1230)}


@pytest.mark.parametrize("start", [[0], [0, 20, 40], [0, 59]])
def test_forests_cover_what_hamming_leaves(start):
    from quern.llm.jaccard_join import bit_sketch, candidates, forests, linked

    rng = np.random.default_rng(2)
    base = rng.integers(1, 1 << 62, 3000, dtype=np.uint64)
    sets = [np.unique(np.r_[base[: (size := int(rng.choice([150, 900, 2900])))][rng.random(size) > 0.04], rng.integers(1, 1 << 62, size // 28, dtype=np.uint64)]) for _ in range(60)]
    label, n = np.arange(60) % 50, np.array(list(map(len, sets)))
    i, j, far = candidates(np.array(start), label, n, np.zeros(60, dtype=np.int32), np.ones(60, dtype=bool), list(map(bit_sketch, sets)), 85, 100)
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if not any(a < s <= b for s in start) and label[a] != label[b] and linked(sets[a], sets[b], 85, 100)}
    assert want <= found and len(found) < 3 * len(want) and len(want) > 20
    trial = forests(label, i, j, far, 1)
    assert len(trial) < 50 and len(forests(label, i, j, far, 1 << 20)) == len(i)
    reach = Sets(range(50))
    for t in trial:
        reach.join(label[i[t]], label[j[t]])
    assert all(reach.find(label[a]) == reach.find(label[b]) for a, b in found)


def test_one_row_of_each_group_stays(spark):
    """Rows that share an id: repeated ones leave one, an unlinked text stays, of linked ones one stays."""
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(1, PROSE), (1, PROSE), (2, PROSE), (3, other), (2, "nothing like the rest at all, a text of its own"), (5, PROSE.replace("fox", "cat")), (1, PROSE + "more"), (None, PROSE), (None, None), (7, ""), (7, "")]
    kept = [tuple(r) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(i == 1 for i, _ in kept) == 1 and (2, rows[4][1]) in kept and (2, PROSE) not in kept and (3, other) in kept and all(i != 5 for i, _ in kept)
    assert sum(i is None for i, _ in kept) == 2 and kept.count((7, "")) == 2


def test_shingles_of_few_words():
    a, b, c, d = shingle_sets([b"a b c", b"A  B\nC", b"a b", None], 4)
    assert a.tolist() == b.tolist() and len(c) == 1 and c.tolist() != a.tolist() and len(d) == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)]
    want = Sets({x for p in pairs for x in p})
    for a, b in pairs:
        want.join(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: want.find(x) for x in want.up if x in got} and {x for p in pairs if p[0] != p[1] for x in p} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_of_odd_rows(spark):
    rows = line_report(odd(spark)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 19 and by[1].n_removed == 0 and by[2].n_removed == by[2].n_lines == 1 and by[3].n_lines == 0 and by[5].n_removed == 0 and by[15].removed == [1] and by[12].n_removed == 1
    assert line_report(empty(spark)).count() == 0
    kept = drop_lines(odd(spark))
    texts = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert kept.columns == odd(spark).columns and texts[15] == ("line one of two\nline two", 24) and 2 not in texts and texts[3][0] is None


def test_lines_of_rows_without_ids(spark):
    """They stand before all others; repeated ones lose the same lines."""
    df = spark.createDataFrame([(None, "alpha beta gamma delta\nsecond line of it"), (4, "alpha beta gamma delta\nits own line here"), (None, "x\nits own line here"), (4, "its own line here")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_lines, tuple(r.removed)) for r in line_report(df).collect())
    assert got == [(0, 2, ()), (0, 2, ()), (4, 1, (0,)), (4, 2, (0, 1))]
    assert {r.text for r in drop_lines(df).collect()} == {"alpha beta gamma delta\nsecond line of it", "x\nits own line here"}


@pytest.mark.parametrize("pairs", [800, 3000])
def test_lines_of_few_words_in_many_combinations(spark, pairs):
    """Pairs of lines that differ in one of twenty words, among thousands that share every word with others."""
    rng = np.random.default_rng(pairs)
    words = [["".join(rng.choice(list("abcdefghij"), 10)) for _ in range(3)] for _ in range(20)]
    lines = []
    for _ in range(pairs):
        at, k = rng.integers(0, 3, 20), int(rng.integers(20))
        lines += [" ".join(w[v] for w, v in zip(words, at, strict=True)), " ".join(w[(v + (i == k)) % 3] for i, (w, v) in enumerate(zip(words, at, strict=True)))]
    sets = whole_sets(lines)
    should = {2 * p + 1 for p in range(pairs) if 100 * len(sets[2 * p] & sets[2 * p + 1]) >= 80 * len(sets[2 * p] | sets[2 * p + 1])}
    assert len(should) > pairs // 4 and len(gone(spark, lines) & should) >= 0.98 * len(should)


def whole_sets(lines):
    return [{x[i : i + 12] for i in range(max(1, len(x) - 11))} for x in lines]


def lines_that_go(lines):
    """By brute force over the shingles of all positions: every line that a similar one, or a chain of them, precedes."""
    sets, want = whole_sets(lines), Sets(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                want.join(i, j)
    return {i for i in range(len(lines)) if want.find(i) != i}


def gone(spark, lines, **more):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {r.doc_id for r in line_report(df, **more).where("n_removed > 0").collect()}


def word(rng):
    return "".join(rng.choice(list("abcdefghinorst"), int(rng.integers(2, 9))))


def families(rng):
    lines = []
    for _ in range(60):
        words = [word(rng) for _ in range(40)]
        lines += [" ".join(words), edited(rng, words, 1), edited(rng, words, 2), edited(rng, words, 30)]
    return lines


def at_the_threshold(rng):
    """Lines of all lengths with one to a few edits, around the similarity that counts."""
    lines = []
    for _ in range(100):
        words = [word(rng) for _ in range(int(rng.integers(12, 80)))]
        lines += [" ".join(words), edited(rng, words, max(1, round(len(words) * rng.uniform(0.02, 0.06))))]
    return lines


def template(rng):
    """Families of similar lines whose bands are made of words that all families share."""
    common, lines = [word(rng) for _ in range(52)], []
    for _ in range(60):
        words = common + [word(rng) for _ in range(14)]
        lines += [" ".join(words), edited(rng, words, 1), edited(rng, words, 2)]
    return lines


def hot_band(rng):
    """One large group of near copies in which similar and other pairs mix."""
    words = [word(rng) for _ in range(60)]
    return [edited(rng, words, int(rng.integers(0, 7))) for _ in range(150)]


def without_blanks(rng):
    """URLs, base64 and Chinese lines with equal beginnings, and near copies of them."""
    run = lambda letters, n: "".join(rng.choice(list(letters), n))
    lines = ["https://www." + run("abcdefghij0123456789/", 150) for _ in range(20)]
    lines += ["data:image/png;base64," + run("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/", 400) for _ in range(20)]
    lines += ["今日はよい天気ですからね、" + run("山川田中日本語文字列東西南北", 150) for _ in range(20)]
    return lines + [x[:-1] for x in lines[::4]] + ["x" + x for x in lines[1::4]] + [x[: len(x) // 2] + "々" + x[len(x) // 2 :] for x in lines[2::4]]


@pytest.mark.parametrize("made", [families, at_the_threshold, template, hot_band, without_blanks])
def test_similar_lines(spark, made):
    """Recall against brute force over whole sets, and no line lost that has no similar one before it; all with exact."""
    lines = made(np.random.default_rng(9))
    should = lines_that_go(lines)
    found = gone(spark, lines)
    print(made.__name__, len(lines), len(should), len(found & should), len(found - should))
    assert found <= should and len(found) >= 0.95 * len(should) and len(should) > 30
    if made in (hot_band, template):
        assert gone(spark, lines, exact=True) == should


def test_lines_of_documents(spark):
    """All lines of a table: what goes equals brute force over whole sets, by place, but for few that are missed."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text)
    places = [(i, k, x) for i, t in rows for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    lines, where, want = list(dict.fromkeys(x for _, _, x in places)), defaultdict(list), None
    sets, want = whole_sets(lines), Sets(range(len(lines)))
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                want.join(i, j)
    number, seen, should = {x: i for i, x in enumerate(lines)}, set(), set()
    for i, k, x in places:  # in order of place: the first of each component stays
        c = want.find(number[x])
        if c in seen:
            should.add((i, k))
        seen.add(c)
    found = {(r.doc_id, k) for r in line_report(spark.read.parquet(f"{SF}/documents.parquet")).collect() for k in r.removed}
    assert found <= should and len(found) >= 0.97 * len(should) and len(should) > 50


@pytest.mark.parametrize("many", [2048, 8])
def test_all_lines_of_a_large_band_meet(spark, monkeypatch, many):
    """Every two lines of a band that are similar are joined, whichever lines the band's ends are and however many it has."""
    from quern.llm import line_dedup

    monkeypatch.setattr(line_dedup, "MANY", many)
    rng = np.random.default_rng(21)
    base = [word(rng) for _ in range(60)]
    lines = [edited(rng, base, int(rng.integers(4, 9))) for _ in range(160)]
    lines += [edited(rng, x.split(" "), 1) for x in lines[::4]]
    sets = whole_sets(lines)
    df = spark.createDataFrame([(100 + i, x) for i, x in enumerate(lines)], "lid long, line string")
    live = df.selectExpr("7L as key", "lid", "100L as least", "299L as largest")
    labels = {r.lid: r.label for r in line_dedup.met(live, df, 80, 100).collect()}
    want = Sets(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                want.join(i, j)
    assert {i: want.find(i) + 100 for i in range(len(lines))} == {i: labels.get(100 + i, 100 + i) for i in range(len(lines))}
    assert len({want.find(i) for i in range(len(lines))}) > 50 and sum(want.find(i) != i for i in range(len(lines))) > 30


def near_copies(rng, many=400):
    """Lines of one base with one to three edits, similar where both have no more than about four; the first has three."""
    base = [word(rng) for _ in range(120)]
    return [edited(rng, base, k) for k in [3, *rng.choice([1, 2, 3], many - 1, p=[0.1, 0.3, 0.6]).tolist()]]


def counted(monkeypatch):
    """Collects how many candidate pairs the rounds put out."""
    from quern.llm import line_dedup

    made, real = [], line_dedup.staged

    def staged(df, name="stage", *more, **named):
        out = real(df, name, *more, **named)
        if name == "candidates":
            made.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "staged", staged)
    return made


@pytest.mark.parametrize("many", [2048, 100])
def test_a_band_of_near_copies_does_not_put_out_all_its_pairs(spark, monkeypatch, many):
    """Many of its pairs are similar; few are looked at, and all of them are joined nevertheless."""
    from quern.llm import line_dedup

    monkeypatch.setattr(line_dedup, "MANY", many)
    lines = near_copies(np.random.default_rng(23))
    should, made = lines_that_go(lines), counted(monkeypatch)
    df = spark.createDataFrame([(100 + i, x) for i, x in enumerate(lines)], "lid long, line string")
    labels = {r.lid: r.label for r in line_dedup.met(df.selectExpr("7L as key", "lid", "100L as least", "499L as largest"), df, 80, 100).collect()}
    assert {i for i in range(len(lines)) if labels.get(100 + i, 100 + i) != 100 + i} == should and len(should) > 300
    assert 0 < sum(made) < 20 * len(lines)


def test_signatures_are_the_least_hashes_and_nothing_is_sorted(spark):
    """The least distinct ones in order, of lines of few, repeated and no words between blanks too; no array is sorted for them."""
    from quern.llm import line_dedup

    rng = np.random.default_rng(24)
    lines = [" ".join(word(rng) for _ in range(n)) for n in range(1, 40)] + ["a a a a a a", "a b a b a b a b", " ", "  x ", "b" * 40, "日本語" * 9]
    df = line_dedup.signed(spark.createDataFrame([(x,) for x in lines], "line string"))
    rows = df.withColumn("all", line_dedup.chosen(F.col("line"))).withColumn("bands", line_dedup.bands(F.col("signature"))).collect()
    for r in rows:
        least = sorted(set(r["all"]))[: line_dedup.BOTTOM]
        assert list(r.signature) == least + [None] * (line_dedup.BOTTOM - len(least))
        assert sum(x is not None for x in r.bands) == max(1, len(least) * (len(least) - 1) // 2)
    assert {len(set(r["all"])) for r in rows} >= {1, 2, 3, 4, 20}
    assert "sort" not in df._jdf.queryExecution().executedPlan().toString()


def test_long_words_with_one_edit_are_joined(spark):
    """One letter of a line of few long words touches many of its runs of words, but few of its whole set."""
    rng = np.random.default_rng(22)
    letters = lambda n: "".join(rng.choice(list("abcdefghinorst"), n))
    lines = []
    for _ in range(150):
        words = [letters(9) for _ in range(16)]
        lines += [" ".join(words), " ".join([*words[:8], words[8][:4] + "Z" + words[8][5:], *words[9:]])]
    should = lines_that_go(lines)
    assert len(should) == 150 and len(gone(spark, lines) & should) >= 0.9 * len(should)


def test_equal_beginnings_do_not_make_lines_similar(spark):
    pairs = ["https://www.example.com/recipes/soup", "https://www.othersite.org/legal/terms-of-2024", "今日はよい天気ですからね、山へ行きましょう", "今日はよい天気ですからね、家で本を読みます", "short", "shorter"]
    assert gone(spark, pairs) == set() == gone(spark, pairs, exact=True)


def brute_repeats(rows, size=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        mask = bytearray(len(data))
        for p in range(len(data) - size + 1):
            w = data[p : p + size]
            if w in seen:
                mask[p : p + size] = b"\1" * size
            seen.add(w)
        kept = bytes(b for b, m in zip(data, mask, strict=True) if not m)
        out[i] = (len(data), sum(mask), sum(1 for k in range(len(mask)) if mask[k] and (not k or not mask[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_op9_is_exact(spark):
    from quern.llm.registry import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries()["op9_suffix_dedup"](spark, SF).collect()}
    assert got == brute_repeats(rows)


def test_repeats_of_odd_texts(spark):
    rows = [(1, "ab" * 400), (2, "zab" + "ab" * 100), (3, None), (4, ""), (5, "q" * 99), (6, "q" * 100), (7, "xx" + "q" * 100), (8, "é" * 300 + "日本" * 90), (9, PROSE * 3), (10, "intro " + PROSE + " outro"), (11, PROSE[20:150] + "." + PROSE[:120]), (12, PROSE * 3), (13, "abc" * 300), (14, "bca" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = dedup(df, with_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute_repeats(rows)
    assert dedup(empty(spark)).count() == 0 and dedup(odd(spark)).count() == 19


def crowded(n):
    """One passage in n distinct contexts, some of which repeat strings that lie across its edges."""
    rng = np.random.default_rng(4)
    letters = lambda k: "".join(rng.choice(list("abcdefghij klmnop"), k))
    ends = [letters(60) for _ in range(12)]
    return [(i, letters(40) + ends[i % 7] * (i % 3 == 0) + PROSE[:60] + ends[i % 12] * (i % 5 == 0) + letters(50)) for i in range(n)]


@pytest.mark.parametrize("most", [2000, 20, 1])
def test_buckets_of_many_contexts(spark, monkeypatch, most):
    from quern.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    rows = crowded(300)
    out = dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_repeats(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == want and sum(w[1] > 0 for w in want.values()) > 40


def test_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    owner, inside = repeats([], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    assert len(owner) == 0 == len(inside)
