"""The engine's verbs end to end on a small store."""

import json

import pytest

from quern.api import Engine, is_safe, load_settings, scope_edit
from tests.test_sources import put

NOTE = "---\nname: {0}\ndescription: about {0}\ntype: {1}\ncreated: 2025-01-01\n{2}---\n\n{3}\n"


def line(uuid, text, session="s1", kind="user"):
    return json.dumps({"type": kind, "uuid": uuid, "sessionId": session, "timestamp": "2026-01-01T00:00:00Z", "cwd": "/home/u/app", "message": {"role": kind, "content": text}})


@pytest.fixture
def engine(spark, tmp_path):
    home = tmp_path / "home"
    put(home, "always/lint.md", NOTE.format("lint", "always", "", "always run the linter before pushing code"))
    put(home, "topics/db.md", NOTE.format("db", "topic", "invalidated_at: 2026-01-01\n", "the database lives on the old host"))
    put(home, "when/bad.md", "nothing")
    put(tmp_path, "t/a.jsonl", "\n".join([line("u1", "we always run the linter"), line("u2", "the deployment failed again"), line("u3", "x", kind="system")]))
    e = Engine(spark, f"{tmp_path}/store")
    e.build_index(str(home))
    e.ingest_transcripts(f"{tmp_path}/t")
    return e, home, tmp_path


def test_verbs(engine, spark):
    e, home, tmp = engine
    ids = lambda q, **k: [(r.tier, r.id) for r in e.search(q, **k).collect()]
    assert ("memory", "/m/always/lint.md") in ids("run the linter") and ids("run the linter", source="sessions")[0] == ("session", "u1")
    assert all("db.md" not in i for _, i in ids("database host")) and any("db.md" in i for _, i in ids("database host", include_invalidated=True))
    with pytest.raises(ValueError):
        e.search("x", source="other")
    assert {(r.path, r.reason) for r in e.coverage(str(home)).collect()} == {("/m/when/bad.md", "invalid")}
    assert {r.label: r.status for r in e.doctor(str(home)).collect()}["notes that search cannot see"] == "problem"
    put(home, "always/new.md", NOTE.format("new", "always", "", "fresh"))
    (home / "topics/db.md").unlink()
    actions = {r.path: r.action for r in e.update_index(str(home)).collect()}
    assert actions == {"/m/always/lint.md": "keep", "/m/always/new.md": "add", "/m/topics/db.md": "drop", "/m/when/bad.md": "invalid"}
    assert {r.file_path for r in e.table("chunks").select("file_path").distinct().collect()} == {"/m/always/lint.md", "/m/always/new.md"}
    put(tmp, "t/a.jsonl", "\n".join([line("u1", "changed"), line("u2", "the deployment failed again"), line("u4", "grown in place", session="s2")]))
    e.ingest_transcripts(f"{tmp}/t")
    assert {r.message_uuid: r.content for r in e.table("messages").collect()} == {"u1": "we always run the linter", "u2": "the deployment failed again", "u4": "grown in place"}
    conflict = e.near_duplicates(spark.createDataFrame([("n", "lint\nalways run the linter before pushing code"), ("m", "quite another thing")], "note_id string, body string")).collect()
    assert [r.note_id for r in conflict] == ["n"]
    found = {r.message_uuid: r for r in e.recall_candidates(("we always", "deployment")).collect()}
    assert found["u1"].slug == "app" and found["u1"].layer in ("knowledge", "always")
    assert {r.file_path for r in e.overdue().collect()} == {"/m/always/lint.md", "/m/always/new.md"}
    e.forget("s2")
    assert e.table("messages").count() == 2 == e.table("vectors").count()
    with pytest.raises(KeyError):
        e.forget("s2")
    put(tmp, "docs/Ops/notes.txt", "rotate the logs weekly")
    assert e.import_documents(f"{tmp}/docs", "p").count() == 1 == e.import_documents(f"{tmp}/docs", "p").count()
    assert e.discover_dirs(f"{tmp}/docs").first().dir == "Ops" and e.probe(("red car", "red car fast"), "blue sky high")


def test_settings_and_scopes(spark):
    s = load_settings("k: 7\nrecency_weight: 1\nunknown: 3\nexempt_layers: [always]\n")
    assert (s.k, s.recency_weight, s.exempt_layers) == (7, 1.0, ("always",)) and load_settings("").k == 5
    assert scope_edit(["b", "a"], ["c", "b"], ["a"]) == ["b", "c"]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("ok-1",), ("..",), ("a/b",), ("",), (None,)], "x string").select(is_safe(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [True, False, False, False, False]
