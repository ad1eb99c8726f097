"""License scans: plain matching statistics, plain phrase counts, odd rows."""

import random
import re

import pytest

from quern.llm import license_scan as L
from quern.llm.registry import queries
from tests.llm.edge import empty, odd

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    words = words_of(text)
    places = [(i, label) for phrase, label in L.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_base_of_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op12_license_scan"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.score == 1.0) or not r.base_labels
    named = {r.doc_id: r.labels.split(",") for r in rows}
    for line, label in (("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0")):
        held = [i for i, t in texts.items() if line in (t or "")]
        assert held and all(label in named[i] for i in held) and not [i for i in set(texts) - set(held) if label in named[i]]


def plain_statistics(texts, words):
    held = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    return [max((n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in held), default=0) for i in range(len(words))]


def test_matching_statistics_equal_plain_ones():
    rng = random.Random(5)
    for _ in range(60):
        texts = [[rng.choice("abcd") for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 5))]
        auto = L.Automaton(tuple(("t", " ".join(t)) for t in texts[:-1]), ((" ".join(texts[-1]), "p"),), 2)
        words = [rng.choice("abcde") for _ in range(40)]
        ids = [auto.vocabulary.get(w.encode(), -1) for w in words]
        seen = list(auto.stream(ids))
        assert [n for _, n in seen] == plain_statistics(texts, words)
        said = [i - len(texts[-1]) + 1 for i, (s, n) in enumerate(seen) for _, size in auto.said[s] if n >= size]
        assert said == [i for i in range(len(words)) if words[i : i + len(texts[-1])] == texts[-1]]


def plain_matches(told, words, least):
    out = set()
    for t, of in enumerate(told):
        for i in range(len(words)):
            for p in range(len(of)):
                n = 0
                while i + n < len(words) and p + n < len(of) and words[i + n] == of[p + n]:
                    n += 1
                if n >= least and (i == 0 or p == 0 or words[i - 1] != of[p - 1]):
                    out.add((t, i, p, n))
    return out


@pytest.mark.parametrize("piece", [1 << 20, 16])
def test_matches_equal_plain_ones(monkeypatch, piece):
    monkeypatch.setattr(L, "PIECE", piece)
    rng = random.Random(7)
    pool = ["public", "licensexa", "licensexb", "the", "é", "of"]  # two share their first eight bytes and length
    for _ in range(80):
        told = [[rng.choice(pool) for _ in range(rng.randint(2, 10))] for _ in range(3)]
        said = [rng.choice(pool) for _ in range(rng.randint(1, 3))]
        auto = L.Automaton(tuple(("t", " ".join(t)) for t in told), ((" ".join(said), "p"),), 3)
        words = [rng.choice([*pool, "licensexc", "other"]) for _ in range(60)]
        total, phrases, matches = L.scan(auto, rng.choice([" ", "\n", ", "]).join(words).upper().replace("É", "é").encode())
        assert total == 60 and sorted(p for p, _ in phrases) == [i for i in range(60) if words[i : i + len(said)] == said]
        assert {(t, *m) for t, found in matches.items() for m in found} == plain_matches(told, words, 3)


def test_chains_cover_an_edited_notice(spark):
    mit = next(t for label, t in L.TEMPLATES if label == "mit" and len(t) > 200)
    edited = mit.replace("free of charge", "at no cost").replace("publish, ", "")
    other = "The cat sat on the mat. The software is here, and the rights of any person are in the following."
    df = spark.createDataFrame([(1, f"intro words {edited} more words"), (2, mit.lower().replace(" ", "\n") + " x " + mit), (3, other), (4, mit[: len(mit) // 3])], "doc_id long, text string")
    rows = {(r.doc_id, r.first_word): r for r in L.license_spans(df).collect() if r.label == "mit"}
    n = len(words_of(mit))
    assert sorted(rows) == [(1, 2), (2, 0), (2, n + 1)]
    assert rows[1, 2].last_word == 1 + len(words_of(edited)) and 0.9 < rows[1, 2].covered / rows[1, 2].of < 1
    assert (rows[2, 0].covered, rows[2, 0].last_word) == (n, n - 1)
    told = {r.doc_id: r for r in L.license_report(df).collect()}
    assert told[1].labels == "mit" and told[3].labels == "" and told[3].score < 0.3 and 0.2 < told[4].score < 0.5 and told[4].labels == ""


def test_odd_rows(spark):
    df = odd(spark)
    got = sorted((tuple(r) for r in L.license_report(df).collect()), key=repr)
    want = sorted(((r.doc_id, *plain_base(r.text)) for r in df.collect()), key=repr)
    assert [g[:6] for g in got] == want
    assert L.license_report(empty(spark)).collect() == [] == L.license_spans(empty(spark)).collect()


def test_a_long_text_of_notices_is_read_whole():
    auto = L.automaton(L.TEMPLATES, L.PHRASES, L.LEAST_MATCH)
    line = "All rights reserved. Licensed under CC BY-NC 4.0. " + "filler " * 30
    data = (line * 8000).encode() + b"x" * 3_000_000
    total, phrases, matches = L.scan(auto, data)
    assert total == 8000 * 40 + 1 and len(phrases) == 16000 and phrases[-1][0] > 319_000
    assert len([s for s in L.spans(auto, matches) if auto.labels[s[0]] == "cc-by-nc-4.0" and s[3] == s[4]]) == 8000
