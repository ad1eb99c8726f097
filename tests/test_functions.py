"""Functions: chunks, globs, text rules, dates, vectors, stems."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quern.functions import dates, text, vectors
from quern.functions.chunks import chunk
from quern.functions.globs import excluded, load_patterns
from quern.operators.fts import porter, query_phrases


def one(spark, col, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col.alias("y")).first().y


def test_chunks_follow_headings_and_paragraphs():
    assert chunk("", 100) == [] == chunk(" \n\n", 100)
    body = "intro\n\n# One\ntext a\n\n## Two\n\ntext b"
    assert [(c["heading"], c["line_start"], c["line_end"]) for c in chunk(body, 1000)] == [(None, 1, 2), ("One", 3, 5), ("Two", 6, 8)]
    long = "# H\n\n" + "\n\n".join("p" * 40 for _ in range(6))
    parts = chunk(long, 100)
    assert len(parts) == 3 and all(c["heading"] == "H" for c in parts) and parts[0]["text"].startswith("# H\n\npppp")
    assert len(chunk("x" * 500, 100)) == 1
    assert [c["heading"] for c in chunk("```\n# not code aware\n```", 100)] == [None, "not code aware"]
    assert [len(c["text"].encode()) for c in chunk("é" * 60 + "\n\n" + "é" * 60, 130)] == [120, 120]


@pytest.mark.parametrize(("path", "patterns", "hit"), [("/a/secret-x/b", ["secret-x"], True), ("/a/b", ["*"], True), ("/a/b.md", ["*.txt"], False), ("/a/1.md", ["/a/[12].md"], True), ("/a/3.md", ["/a/[!12].md"], True), ("/a/b", [], False), ("/a.b", ["/a?b"], True), ("/axb", ["/a.b"], False)])
def test_globs(spark, path, patterns, hit):
    assert one(spark, excluded(F.col("x"), patterns), path) is hit


def test_patterns_of_an_ignore_file():
    assert load_patterns("# no\n\n  a*  \nb\n") == ["a*", "b"]


@pytest.mark.parametrize(("line", "layer"), [("when deploying wait", "when"), ("Whenever x", "when"), ("the repo lives in /x", "topic"), ("Always lint", "always"), ("don't push", "always"), ("use token=abc123", "knowledge"), ("use sk-abcdefgh12345", "knowledge"), ("plain fact", "knowledge"), ("usefulness", "knowledge")])
def test_layers(spark, line, layer):
    assert one(spark, text.layer_guess(F.col("x")), line) == layer


@pytest.mark.parametrize(("line", "note"), [("- remember: rotate logs.", "rotate logs"), ("NOTE check it", "check it"), ("decision: keep", "keep"), ("avoid globals", "globals"), ("I told you to wait..", "to wait"), ("nothing here", None)])
def test_notes(spark, line, note):
    assert one(spark, text.note_line(F.col("x")), line) == note


@pytest.mark.parametrize(("days", "age"), [(-3, "today"), (0, "today"), (1, "1 day ago"), (6, "6 days ago"), (7, "1 week ago"), (29, "4 weeks ago"), (30, "1 month ago"), (364, "12 months ago"), (800, "2 years ago")])
def test_ages(spark, days, age):
    assert one(spark, text.relative_age(F.col("x")), days, "int") == age


@pytest.mark.parametrize(("message", "want"), [("resets 3:45pm", "2026-06-01T15:45:00"), ("resets 9:00am", "2026-06-02T09:00:00"), ("resets Mon 12:00am", "2026-06-08T00:00:00"), ("Resets Wed 1:05 pm", "2026-06-03T13:05:00"), ("resets 25:00", None), ("nothing", None)])
def test_reset_times(spark, message, want):
    got = one(spark, text.reset_time(F.col("x"), F.lit(dt.datetime(2026, 6, 1, 12)).cast("timestamp_ntz")), message)
    assert got == (dt.datetime.fromisoformat(want) if want else None)


def test_slugs_names_and_commands(spark):
    assert one(spark, text.slug(F.col("x")), "/home/u/My App_2/") == "my-app-2" and one(spark, text.slug(F.col("x"))) == "unknown" == one(spark, text.slug(F.col("x")), "/…/")
    assert one(spark, text.suggested_name(F.col("x")), "  Keep it. Small") == "Keep it" and one(spark, text.suggested_name(F.col("x")), "a" * 80) == "a" * 70 + "…" and one(spark, text.suggested_name(F.col("x")), "...") == "untitled"
    assert one(spark, text.one_line(F.col("x")), "a\r\n\nb\n") == "a ↵ b"
    assert "<edit before running>" in one(spark, text.capture_command(F.col("x")), "rm $(x)") and '"Use it"' in one(spark, text.capture_command(F.col("x")), "Use it")
    assert one(spark, text.active_commands(F.col("x")), "- [ ] a\n  capture: `c1`\n## Deferred\n  capture: `c2`") == ["c1"]
    assert tuple(one(spark, text.version(F.col("x")), "v1.10.3")) == (1, 10, 3) and one(spark, text.version(F.col("x")), "1.2") is None
    assert one(spark, text.is_limit(F.col("x"), F.lit("")), "rate_limit") and one(spark, text.is_limit(F.col("x"), F.lit("")), "Rate_Limit") and not one(spark, text.is_limit(F.col("x"), F.lit("off limits")), "invalid_request") and one(spark, text.is_limit(F.lit(None), F.col("x")), "You reached your usage limit")


def test_dates(spark):
    assert one(spark, dates.to_date(F.col("x")), "2026-01-02T10:00") == dt.date(2026, 1, 2) and one(spark, dates.to_date(F.col("x")), "junk") is None
    assert one(spark, dates.iso_unix(F.col("x")), "2026-01-01T00:00:00.500Z") == 1767225600 and one(spark, dates.iso_unix(F.col("x")), "x") is None
    assert one(spark, dates.to_date(dates.first_filled(F.col("x"), F.lit("2026-01-01"))), "") == dt.date(2026, 1, 1) and one(spark, dates.to_date(dates.first_filled(F.col("x"), F.lit("2026-01-01"))), "bad") is None
    assert one(spark, dates.normalised(F.col("x"), False), "2026-01-02 03:04:05") == "2026-01-02T03:04:05" and one(spark, dates.iso_z(F.col("x")), 0, "long") == "1970-01-01T00:00:00Z"


def test_embedder_matches_its_driver_form(spark):
    rows = [(1, "the cat the dog"), (2, ""), (3, None), (4, "Été  été")]
    got = {r.id: r.embedding for r in vectors.embedder("hashing", 64).embed(spark.createDataFrame(rows, "id int, t string"), "id", F.col("t")).collect()}
    for i, t in rows:
        want = vectors.embed_query(t or "", 64)
        assert len(got[i]) == 64 and all(abs(a - b) < 1e-12 for a, b in zip(got[i], want, strict=True)) and abs(math.fsum(x * x for x in got[i]) - 1) < 1e-9
    assert got[2][0] == 1.0
    with pytest.raises(ValueError):
        vectors.embedder("other")


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("triplicate", "triplic"), ("hopeful", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("deploy", "deploi"), ("deployments", "deploy")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_query_phrases():
    assert query_phrases("slack-daemon don't !! x") == [["slack", "daemon"], ["don", "t"], ["x"]] and query_phrases("?! --") == []


def test_limits_are_known_by_their_codes(spark):
    rows = [("rate_limit", ""), ("billing_error", ""), ("usage_limit", ""), ("overloaded", ""), ("invalid_request", ""), (None, "You've reached your usage limit"), (None, "limit of lines"), ("x", "the limit resets 3:00"), (None, None), ("account_billing_error_2", None), ("Rate_Limit", "")]
    got = [r.x for r in spark.createDataFrame(rows, "code string, message string").select(text.is_limit(F.col("code"), F.col("message")).alias("x")).collect()]
    assert got == [True, True, True, False, False, True, False, True, False, True, True]


def test_rules_read_all_of_unicode(spark):
    """Blanks and letters beyond ASCII: as the patterns mean them, not as a plain Java pattern has them."""
    rows = ["use tabs here", "  Décision: garder. ", "- REMEMBER:　rotate ", "note:  wide ", "étoken is abc", "Token is abc", "schlüsselpassword = x1", "DON’T", "prefer ünits"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string")
    got = {r.i: (r.note, r.secret, r.layer) for r in df.select("i", text.note_line(F.col("t")).alias("note"), text.has_secret(F.col("t")).alias("secret"), text.layer_guess(F.col("t")).alias("layer")).collect()}
    assert got[0][0] == "tabs here" and got[2][0] == "rotate" and got[3][0] == "wide" and got[8][0] == "ünits"
    assert not got[4][1] and got[5][1] and got[6][1] and got[0][2] == "always"


def test_tables_and_queries_split_text_alike(spark):
    rows = ["a b c", "a　b\x1cc\x85d", "ä ß É", "x", "", None, "   ", "a a a b" * 40]
    df = spark.createDataFrame([(f"k{i}", x) for i, x in enumerate(rows)], "id string, t string")
    got = {r.id: r.embedding for r in vectors.embed(df, "id", F.col("t"), 64).collect()}
    for i, x in enumerate(rows):
        assert got[f"k{i}"] == pytest.approx(vectors.embed_query(x or "", 64))
    slots = {(r.id, r.slot): r.weight for r in vectors.hash_slots(df, "id", F.col("t"), 64).collect()}
    seeds, signs = vectors.token_slots("x")
    assert {s: w for (k, s), w in slots.items() if k == "k3"} == {s % 64: sum(g for q, g in zip(seeds, signs, strict=True) if q % 64 == s % 64) for s in seeds}


def test_chunks_of_tables_equal_those_of_strings(spark):
    import random

    from quern.functions.chunks import chunks

    rng = random.Random(4)
    bits = ["# One", "## Two words ", "#x", "####### seven", "#　wide", "text", "é" * 9, "", " ", "\t", "a longer line of text", "\x1c", "   # not", "# "]
    bodies = [rng.choice(["\n", "\r\n", "\n\n", " ", "\n \n"]).join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(250)]
    bodies += [None, "", "\n", "#", "# h", "# h\n\n" + "x" * 90 + "\n\n" + "y" * 90, "a\r\r\nb\x0bc\x85d"]
    for most in (30, 100):
        got = {}
        for r in chunks(spark.createDataFrame(list(enumerate(bodies)), "id long, body string"), "id", "body", most).collect():
            got.setdefault(r.id, []).append((r.chunk_no, r.heading, r.text, r.line_start, r.line_end))
        for i, b in enumerate(bodies):
            assert got.get(i, []) == [(k, *c.values()) for k, c in enumerate(chunk(b, most))], repr(b)


def test_secrets_and_places_in_any_case(spark):
    """The patterns that come first leave nothing out: letters of other scripts that equal plain ones in any case."""
    parts = ["my pa\u017f\u017fword is x", "MY PASSWORD: x", "to\u212aen = abc", "ap\u0130_key=1", "ap\u0131-KEY: 1", "acce\u017fs_key=2", "acce\u017f\u017f-\u212aey=2", "\u017fk-abcdefghij", "S\u212a-abcdefghij", "gho_abcdefgh1", "ghx_abcdefgh1", "xoxb-1234567890", "eyJabcdef1.abcdef2.x", "Bearer abcdefghijkl", "bearer abcdefghijkl", "AKIA0123456789AB", "akia0123456789ab", "aws_\u017fecret_access_key", "-----BEGIN", "-----begin", "the key of all", "the repo l\u0131ves there", "Code L\u0130VE\u017f", "the dir\nlives", "projects lives", "plain", ""]
    df = spark.createDataFrame(list(enumerate([*parts, *[f"when {x}" for x in parts], None])), "i int, t string")
    plain = F.lit(False)
    for shape in text.SECRETS:
        plain = plain | text.like(F.col("t"), shape)
    layer = F.when(plain, "knowledge").when(text.like(F.col("t"), text.WHEN), "when").when(text.like(F.col("t"), text.LOCATION), "topic").when(text.like(F.col("t"), text.ALWAYS), "always").otherwise("knowledge")
    got = df.select("t", plain.alias("p"), text.has_secret(F.col("t")).alias("s"), layer.alias("a"), text.layer_guess(F.col("t")).alias("b")).collect()
    assert [(r.t, r.p, r.a) for r in got] == [(r.t, r.s, r.b) for r in got]
    assert {r.p for r in got} == {True, False, None} and {r.a for r in got} == {"knowledge", "when", "topic"}


def test_long_texts_are_hashed_piece_by_piece(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(f"w{i * j % 97}" for j in range(2000)) if i % 3 else None) for i in range(20)], "id int, t string").coalesce(1)
    want = {tuple(r) for r in vectors.hash_slots(df, "id", F.col("t"), 64).collect()}
    monkeypatch.setattr(vectors, "PAIRS", 7)
    monkeypatch.setattr(vectors, "HELD", 10)
    assert {tuple(r) for r in vectors.hash_slots(df, "id", F.col("t"), 64).collect()} == want and want


def test_small_tables_of_few_files_are_spread(spark, tmp_path, monkeypatch):
    from quern import store

    at = str(tmp_path / "t")
    spark.range(5000).withColumn("x", F.col("id") % 7).coalesce(1).write.parquet(at)
    df = spark.read.parquet(at)
    assert "Exchange" not in store.spread(df)._jdf.queryExecution().toString()  # too small to be worth it
    monkeypatch.setattr(store, "TASK", 1 << 10)
    dealt = store.spread(df).where("x = 3").select("id")
    plan = dealt._jdf.queryExecution().toString()
    assert "RoundRobinPartitioning" in plan and "PushedFilters: [IsNotNull(x), EqualTo(x,3)]" in plan
    assert sorted(r.id for r in dealt.collect()) == list(range(3, 5000, 7))
    monkeypatch.setattr(store, "SPREAD", 1 << 10)
    assert "Exchange" not in store.spread(df)._jdf.queryExecution().toString()
