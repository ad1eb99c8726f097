"""Operators on small tables: ranking rules, ingest, reconcile, state, events."""

import datetime as dt

from pyspark.sql import functions as F

from quern.config import DEFAULTS
from quern.operators import events, fts, health, ingest, recall, reconcile, review, search, state

HIT = "chunk_id long, file_path string, cosine_score double, updated string, created string, valid_from string, invalidated_at string"


def ranked(spark, rows, **k):
    return [r.chunk_id for r in search.temporal_rank(spark.createDataFrame(rows, HIT), home="/memhome", **k).orderBy(F.desc("final_score"), "chunk_id").collect()]


def test_temporal_rules(spark):
    live, dead = (1, "/memhome/when/a.md", 0.5, "2026-05-01", None, None, None), (2, "/memhome/when/b.md", 0.9, "2026-05-30", None, None, "2026-01-01")
    assert ranked(spark, [live, dead]) == [1] and ranked(spark, [live, dead], include_invalidated=True) == [1, 2]
    assert ranked(spark, [(3, "/memhome/when/c.md", 0.9, None, "2026-01-01", "2027-01-01", None)]) == []
    assert ranked(spark, [(4, "/memhome/when/d.md", 0.9, None, "2026-01-01", "bad", None)]) == [4]
    assert ranked(spark, [(5, "/memhome/topics/old.md", 0.60, "2020-01-01", None, None, None), (6, "/memhome/topics/new.md", 0.50, "2026-06-01", None, None, None)]) == [5, 6]
    assert ranked(spark, [(7, "/memhome/when/fresh.md", 0.5, "2026-05-20", None, None, None), (8, "/memhome/always/x.md", 0.5, "2020-01-01", None, None, None)]) == [8, 7]
    boost = search.temporal_rank(spark.createDataFrame([(9, "/memhome/projects/p/always/x.md", 0.0, "2025-12-03", None, None, None), (10, "/elsewhere/x.md", 0.0, None, None, None, None)], HIT), home="/memhome").orderBy("chunk_id").collect()
    assert abs(boost[0].final_score - 0.03 / 2.718281828) < 1e-6 and boost[1].final_score == 0.0


def test_layers_of_paths(spark):
    got = spark.createDataFrame([("/m/always/a.md",), ("/m/a.md",), ("/x/always/a.md",), ("/m/projects/p/always/a.md",)], "p string").select(search.layer_of(F.col("p"), "/m/").alias("l")).collect()
    assert [r.l for r in got] == ["always", None, None, "projects"]


def test_overfetch_comes_before_the_policy(spark):
    rows = [(i, f"/m/when/{i}.md", [1.0, 0.001 * i], "2026-05-01", "2026-05-01", None, "2026-01-01" if i < 25 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "chunk_id long, file_path string, embedding array<double>, updated string, created string, valid_from string, invalidated_at string")
    assert search.search_memory(df, [1.0, 0.0]).count() == 0 and search.search_memory(df, [1.0, 0.0], exact=True).count() == DEFAULTS.k


def test_merge_prefers_keywords_on_ties(spark):
    kind = "session_id string, message_uuid string, score double, rank int"
    f, v = spark.createDataFrame([("s", "a", 1.0, 1), ("s", "b", 0.2, 2)], kind), spark.createDataFrame([("s", "a", 1.0, 1), ("s", "b", 0.9, 2), ("t", "c", 0.1, 3)], kind)
    assert [(r.message_uuid, r.tier, r.score) for r in search.merge_hits(f, v, ["session_id", "message_uuid"], 2).collect()] == [("a", "fts", 1.0), ("b", "vec", 0.9)]


def test_bm25_phrases(spark):
    docs = spark.createDataFrame([(1, "the slack-daemon is up"), (2, "daemon slack"), (3, "don't do this"), (4, "nothing")], "id int, t string")
    hit = lambda q: sorted(r.id for r in fts.bm25(docs, "id", F.col("t"), fts.query_phrases(q)).collect())
    assert hit("slack-daemon") == [1] and hit("slack daemon") == [1, 2] and hit("don't") == [3] and hit("!!") == [] and hit("absent") == []
    stemmed = fts.bm25(docs, "id", F.col("t"), fts.stem_phrases([["daemons"]]), stemmed=True)
    assert sorted(r.id for r in stemmed.collect()) == [1, 2]


LINES = [
    '{"type":"user","uuid":"u1","sessionId":"s","timestamp":"2026-01-01T00:00:00Z","cwd":"/p","message":{"role":"user","content":" hello "}}',
    "",
    '{"type":"assistant","uuid":"u2","sessionId":"s","timestamp":"2026-01-01T00:00:01.250Z","message":{"role":"assistant","content":[{"type":"text","text":" a "},{"type":"tool_use","id":"t"},{"type":"text","text":"b"}]}}',
    '{"type":"queue-operation","content":"x"}', '{"type":"user","sessionId":"s","timestamp":"2026-01-01T00:00:00Z","message":{"content":"no uuid"}}', '{"type":"user","uuid":"u3","sessionId":"s","timestamp":"bad","message":{"content":[{"type":"tool_result"}]}}', '{"type":"user","uuid":"u4","sessionId":"s","timestamp":"bad","message":{"content":"text"}}', "[1, 2]", '{"torn',
    '{"type":"user","uuid":"u5","sessionId":"s","timestamp":"2026-01-01T00:00:00","message":{"content":"[not json"}}',
]


def test_dispositions(spark):
    df = spark.createDataFrame([("/t/a.jsonl", i + 1, x) for i, x in enumerate(LINES)], "jsonl_path string, line_number int, raw string")
    got = {r.line_number: r for r in ingest.messages(df).collect()}
    assert {n: r.disposition for n, r in got.items()} == {1: "message", 3: "message", 4: "skipped", 5: "malformed", 6: "no_text", 7: "malformed", 8: "malformed", 9: "malformed", 10: "message"}
    assert (got[1].content, got[3].content, got[10].content) == ("hello", "a b", "[not json") and got[3].timestamp_unix == 1767225601 and got[1].role == "user"
    assert ingest.transcript_cwd(df).first().cwd == "/p"


def test_first_writer_and_changed_files(spark):
    kind = "session_id string, message_uuid string, jsonl_path string, line_number int, content string"
    rows = spark.createDataFrame([("s", "u", "/b", 1, "later"), ("s", "u", "/a", 9, "first"), ("s", "v", "/a", 1, "new"), ("s", "w", "/a", 2, "old")], kind)
    assert sorted(r.content for r in ingest.first_writer(rows, rows.where("message_uuid = 'w'")).collect()) == ["first", "new"]
    files = spark.createDataFrame([("a", 1, 10), ("b", 1, 11), ("c", 1, 1)], "path string, mtime_unix long, size_bytes long")
    assert sorted(r.path for r in ingest.changed_files(files, spark.createDataFrame([("a", 1, 10), ("b", 1, 10)], files.schema)).collect()) == ["b", "c"]


def test_reconcile_priority(spark):
    live = spark.createDataFrame([(p, 2, 4, bytearray(b"abcd")) for p in "123456"], "path string, mtime_unix long, size_bytes long, data binary")
    arch = spark.createDataFrame([("2", bytearray(b"zz")), ("3", bytearray(b"ab")), ("4", bytearray(b"zz")), ("5", bytearray(b"zz")), ("6", bytearray(b"abcd"))], "path string, data binary")
    man = spark.createDataFrame([("2", 2, 4, "live"), ("3", 1, 2, "backfill"), ("4", 1, 2, "backfill"), ("5", 1, 2, "live")], "path string, mtime_unix long, size_bytes long, origin string")
    got = {r.path: r for r in reconcile.archive_reconcile(live, arch, man).collect()}
    assert {p: r.action for p, r in got.items()} == {"1": "copied", "2": "skipped_unchanged", "3": "replaced_append", "4": "replaced_backfill", "5": "diverged_sidecar", "6": "replaced_append"}
    assert len(got["5"].sidecar) == 10 and got["1"].sidecar is None


def test_versions_are_swapped(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    for n in (1, 2):
        reconcile.write_version(spark.range(n), root, n)
        assert reconcile.read_current(spark, root).count() == n


def test_state(spark):
    kind = "id int, last_confirmed string, suspected_at string, suspect_reason string, invalidated_at string, updated string, body string"
    notes = spark.createDataFrame([(1, None, "x", "y", None, None, "b"), (2, None, None, None, "2027-01-01", None, "b")], kind)
    a = {r.id: r for r in state.confirm(notes, F.col("id") == 1, dt.date(2026, 6, 1)).collect()}
    assert (a[1].last_confirmed, a[1].suspected_at, a[1].suspect_reason, a[2].last_confirmed) == ("2026-06-01", None, None, None)
    done, refused = state.suspect(notes, F.lit(True), dt.datetime(2026, 6, 1), "why")
    assert [r.id for r in refused.collect()] == [2] and {r.id: r.suspect_reason for r in done.collect()} == {1: "why", 2: None}
    done, refused = state.invalidate(notes, F.lit(True), dt.datetime(2026, 6, 1), reason="gone")
    b = {r.id: r for r in done.collect()}
    assert b[1].invalidated_at == "2026-06-01T00:00:00" and b[1].body.endswith("gone\n") and b[2].invalidated_at == "2027-01-01" and refused.count() == 1
    tasks = spark.createDataFrame([("t1", "open", "", "c1", None, ""), ("t2", "blocked", "", "c2", None, ""), ("t3", "done", "", "c0", None, "")], "id string, status string, session_id string, created string, updated string, body string")
    begun = {r.id: r for r in state.task_transition(tasks, F.col("id") == "t1", "start", dt.datetime(2026, 6, 1), session="s9").collect()}
    assert (begun["t1"].status, begun["t1"].session_id, begun["t2"].status) == ("in_progress", "s9", "blocked")
    assert [r.id for r in state.task_list(tasks).collect()] == ["t2", "t1"]


def test_scope(spark):
    now = dt.datetime(2026, 6, 1)
    rows = [("a", "s1", dt.datetime(2026, 5, 31)), ("a", "s2", dt.datetime(2026, 1, 1)), ("b", "s3", None), ("a", "s4", dt.datetime(2026, 5, 30)), ("c", "s5", now)]
    df = spark.createDataFrame(rows, "slug string, session_id string, ts timestamp")
    ids = lambda **k: sorted(r.session_id for r in recall.apply_scope(df, k.pop("slugs", []), now, **k).collect())
    assert ids() == ["s1", "s3", "s4", "s5"] and ids(slugs=["a", "b"]) == ["s1", "s3", "s4"] and ids(slugs=["a", "b"], most=2) == ["s1", "s4"]


def test_refined_demotes_negative_user_scores(spark):
    row = spark.createDataFrame([(-1.0, "user", 2200), (1.0, "assistant", 100), (1.0, "user", 10_000)], "s double, r string, n int").select(recall.refined(F.col("s"), F.col("r"), F.col("n")).alias("x")).collect()
    assert [round(r.x, 6) for r in row] == [-0.75, 1.0, 0.75]


def test_capture_conflict_takes_the_first_chunk(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "corpus_id long, embedding array<double>")
    chunks = spark.createDataFrame([("n", 0, [1.0, 1.0]), ("n", 1, [0.0, 2.0]), ("n", 2, [3.0, 0.0])], "note_id string, chunk_no int, embedding array<double>")
    hit = recall.first_conflict(chunks, corpus, 0.85).first()
    assert hit.chunk_no == 1 and hit.hit.nearest == 2
    assert not recall.split_captured(chunks.withColumnRenamed("chunk_no", "cand"), corpus.limit(0), "cand", "corpus_id", 0.8).first().captured


def test_health(spark):
    empty = spark.range(0)
    rows = {r.label: r for r in health.findings({"ok": (empty, "x"), "bad": (spark.range(2), "rebuild")}).collect()}
    assert rows["ok"].status == "ok" and (rows["bad"].status, rows["bad"].detail, rows["bad"].remedy) == ("problem", 2, "rebuild")
    vec = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    health.check_dimension(vec, "v", 2)
    try:
        health.check_dimension(vec, "v", 3)
        raise AssertionError
    except ValueError:
        pass
    assert health.silent_empty(5, 0, 0) and not health.silent_empty(5, 0, 1) and health.margin(0.5, 0.4 - 1e-9)


def test_resume_tick(spark):
    ts = dt.datetime(2026, 6, 1, 10)
    kind = "session_id string, ts timestamp_ntz, event_id long, code string, message string"
    freezes = spark.createDataFrame([("s1", ts, 1, "rate_limit", ""), ("s2", ts + dt.timedelta(minutes=5), 2, "invalid_request", ""), ("s3", ts, 3, "x", "usage limit reached, resets 11:30am"), ("", ts, 4, "rate_limit", "")], kind)
    claims = spark.createDataFrame([(s, f"t{s}", "in_progress") for s in ("s1", "s2", "s3", "")], "session_id string, task_id string, status string")
    ledger = spark.createDataFrame([], "session_id string, ts timestamp_ntz")
    tick = lambda now, led=ledger: [(r.session_id, r.ready_at) for r in events.resume_tick(freezes, claims, led, now).collect()]
    assert tick(ts + dt.timedelta(minutes=30)) == [] and tick(ts + dt.timedelta(minutes=61)) == [("s1", ts + dt.timedelta(hours=1))]
    handled = spark.createDataFrame([("s1", ts)], "session_id string, ts timestamp_ntz")
    assert tick(ts + dt.timedelta(hours=2), handled) == [("s3", ts.replace(hour=11, minute=30))] and tick(ts + dt.timedelta(days=3)) == []


def test_overdue_puts_undated_first(spark):
    rows = [("/m/always/a.md", None, None, None), ("/m/always/b.md", "2025-01-01", None, None), ("/m/when/c.md", None, None, None), ("/m/knowledge/d.md", None, "2026-05-30", None)]
    got = review.overdue(spark.createDataFrame(rows, "file_path string, last_confirmed string, updated string, created string")).collect()
    assert [(r.file_path, r.age_days) for r in got] == [("/m/always/a.md", None), ("/m/always/b.md", 516)]


def test_notes_of_every_line(spark):
    text = "hello\n- remember: rotate the logs.\nnothing here\r\nNOTE: Rotate the logs\nwe talk\ndecision: keep it small.\ntodo: ."
    df = spark.createDataFrame([(1, text), (2, "use tabs"), (3, None), (4, "")], "doc_id long, text string")
    rows = sorted(tuple(r) for r in review.note_candidates(df, "doc_id", "text").collect())
    assert rows == [(1, 1, "rotate the logs"), (1, 5, "keep it small"), (2, 0, "tabs")]
