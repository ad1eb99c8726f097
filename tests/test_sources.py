"""File sources, sinks and streams on small trees."""

import pytest
from pyspark.sql import functions as F

from quern.operators.ingest import document_messages, messages
from quern.plans.binding import msg
from quern.sources import files, sinks
from quern.streaming.ingest import run_once, upsert_batches

NOTE = "---\nname: A\ndescription: d\ntype: {}\ntags: [x, 1]\ncreated: 2026-01-02\n---\n\nBody\n"


def put(root, rel, text):
    p = root / rel
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_notes(spark, tmp_path):
    for rel, text in {"always/a.md": NOTE.format("always"), "topics/b.md": NOTE.format("project"), "feedback/c.md": "no frontmatter", "projects/p.md": NOTE.format("topic"), "projects/s/when/d.md": "---\nname: D\ndescription: d\nmetadata:\n  type: feedback\n---\nx", "projects/s/other/e.md": NOTE.format("topic"), "tasks/t.md": NOTE.format("topic"), "MEMORY.md": "x", "always/.h/f.md": NOTE.format("topic"), "always/g.md": NOTE.format("odd"), "when/h.md": "---\nname: H\ndescription: d\ntype: when\ntags: no\n---\n"}.items():
        put(tmp_path, rel, text)
    walked = files.memory_files(spark, str(tmp_path))
    assert [r.rel for r in walked.collect()] == ["always/a.md", "always/g.md", "feedback/c.md", "projects/p.md", "projects/s/when/d.md", "topics/b.md", "when/h.md"]
    got = {r.path.rsplit("/", 1)[1]: r for r in files.notes(walked).collect()}
    assert {n: (r.ok, r.type, r.reason) for n, r in got.items()} == {"a.md": (True, "always", None), "b.md": (True, "topic", None), "c.md": (False, None, "missing frontmatter"), "p.md": (True, "topic", None), "d.md": (True, "when", None), "g.md": (False, None, "invalid type"), "h.md": (False, None, "tags is no list")}
    assert got["a.md"].tags == ["x", "1"] and got["a.md"].created == "2026-01-02" and got["a.md"].body == "Body" and got["a.md"].scope == "private"
    assert files.all_markdown(spark, str(tmp_path)).count() == 10


def test_text_trees(spark, tmp_path):
    for rel, text in {"Ops Notes/notes.txt": "hello", "Ops Notes/deep/x.md": b"\xff\xfe bad", "loose.log": "log", "blank.txt": " \n", "node_modules/a.txt": "junk", "image.png": "x", "deny/me.txt": "secret"}.items():
        put(tmp_path, rel, text)
    found = files.text_files(spark, str(tmp_path), deny=("deny/*",))
    assert sorted(r.rel for r in found.collect()) == ["Ops Notes/deep/x.md", "Ops Notes/notes.txt", "loose.log"]
    rows = {r.rel_to_source: r for r in files.sessions(found, "/in").collect()}
    assert rows["loose.log"].session == "_root" and rows["Ops Notes/deep/x.md"].rel_to_session == "deep/x.md"
    made = document_messages(files.sessions(found, "/in"), "p").collect()
    assert len({m.session_id for m in made}) == 2 and any(m.content == "notes.txt\n\nhello" for m in made) and {m.role for m in made} == {"document"}


def test_transcripts_round_trip(spark, tmp_path):
    m = msg(spark, "/root/testdata/sf0.001").where("role <> 'system'").withColumn("parent_uuid", F.lit(None).cast("string")).withColumn("timestamp_iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    sinks.write_transcripts(m, f"{tmp_path}/out")
    lines = spark.read.text(f"{tmp_path}/out", recursiveFileLookup=True).select(F.lit("p").alias("jsonl_path"), F.lit(1).alias("line_number"), F.col("value").alias("raw"))
    back = messages(lines)
    assert back.where("disposition = 'message'").count() == m.where("trim(content) <> ''").count()
    put(tmp_path, "t/a.jsonl", "{}\n\n{\"type\":\"user\"}")
    assert [(r.line_number, r.raw) for r in files.transcripts(spark, f"{tmp_path}/t").orderBy("line_number").collect()] == [(1, "{}"), (2, ""), (3, '{"type":"user"}')]


def test_journal_tasks_refs_and_legacy(spark, tmp_path):
    put(tmp_path, "j.jsonl", '{"ts":"1","payload":{"a":1}}\n{"torn\n\n{"ts":"2","payload":{}}\n')
    assert [(r.ts, r.payload) for r in files.journal(spark, f"{tmp_path}/j.jsonl").collect()] == [("1", '{"a":1}'), ("2", "{}")]
    put(tmp_path, "tasks/b.md", "---\nid: b\ntitle: B\nstatus: open\ncreated: 2026-02-01\n---\nbody")
    put(tmp_path, "tasks/a.md", "---\nid: a\ntitle: A\nstatus: blocked\nlinks: [x]\n---\n")
    put(tmp_path, "tasks/c.md", "---\nid: c\nstatus: odd\n---\n")
    assert [(r.id, r.status, r.links) for r in files.tasks(spark, f"{tmp_path}/tasks").collect()] == [("a", "blocked", ["x"]), ("b", "open", [])]
    refs = spark.createDataFrame([("abc\trefs/tags/v1.0.0",), ("abc\trefs/tags/v1.0.0^{}",), ("abc\trefs/heads/main",)], "raw string")
    assert [r.tag for r in files.tags_of_refs(refs).collect()] == ["v1.0.0"]
    put(tmp_path, "legacy/memory/feedback_foo.md", "x")
    put(tmp_path, "legacy/memory/MEMORY.md", "x")
    assert files.legacy_notes(spark, f"{tmp_path}/legacy").count() == 1
    row = spark.range(1).select(files.legacy_target(F.lit("feedback_foo.md"), F.lit("app"), files.legacy_layer(F.lit("feedback"))).alias("a"), files.legacy_layer(F.lit("reference")).alias("b"), files.legacy_layer(F.lit(None).cast("string")).alias("c")).first()
    assert tuple(row) == ("when-app-foo.md", "topic", "knowledge")


def test_renderings():
    always = sinks.promote("# Always\n", "see x", 8192)
    assert always == sinks.promote(always, "see x", 8192) and "- see x" in always and sinks.promote("# Always\n", "y" * 90, 50) == "# Always\n"


def test_review_and_index(spark):
    ranked = spark.createDataFrame([("always", 0, 1, "c1", "cmd1", "active"), ("when", 1, 1, "c2", "cmd2", "active"), ("when", 1, 2, "c3", "cmd3", "deferred")], "layer string, layer_order int, rank int, content string, command string, status string")
    out = sinks.render_review(ranked)
    assert out.index("## always") < out.index("## when") < out.index("## Deferred") < out.index("c3") and "capture: `cmd1`" in out
    index = sinks.render_index(spark.createDataFrame([("always", "a")], "key string, file string"), spark.createDataFrame([("t", "b"), ("t", "a")], "key string, file string"), spark.createDataFrame([("al", "a")], "alias string, file_path string"))
    assert "- t: a, b" in index and "- al: a" in index
    assert sinks.skip_manifest(spark.createDataFrame([("b",), ("a",)], "path string")).first() == (2, ["a", "b"])


def test_streams_resume(spark, tmp_path):
    rows = spark.createDataFrame([("s", "a", 1), ("s", "b", 1)], "session_id string, message_uuid string, n int")
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = upsert_batches(stream(), f"file://{tmp_path}/store", f"file://{tmp_path}/base").start()
        q.awaitTermination()
    spark.createDataFrame([("s", "b", 2), ("s", "c", 2)], rows.schema).write.mode("append").parquet(f"{tmp_path}/in")
    q = upsert_batches(stream(), f"file://{tmp_path}/store", f"file://{tmp_path}/base").start()
    q.awaitTermination()
    assert sorted((r.message_uuid, r.n) for r in spark.read.parquet(f"{tmp_path}/store").collect()) == [("a", 1), ("b", 1), ("c", 2)]
    assert run_once(stream(), "t").count() == 4


def test_sessions_of_one_folder_name_are_an_error(spark, tmp_path):
    rows = [("a b", "m1", None, "user", "x", None, "2026-01-01T00:00:00Z", 1), ("a/b", "m2", None, "user", "y", None, "2026-01-01T00:00:00Z", 1)]
    m = spark.createDataFrame(rows, "session_id string, message_uuid string, parent_uuid string, role string, content string, cwd string, timestamp_iso string, line_number int")
    with pytest.raises(ValueError, match="same folder"):
        sinks.write_transcripts(m, f"{tmp_path}/out")
    sinks.write_transcripts(m.where("message_uuid = 'm1'"), f"{tmp_path}/out")
    assert (tmp_path / "out/session=a-b").is_dir()


def test_transcripts_are_numbered_over_splits(spark, tmp_path):
    """Lines of a file keep their numbers however it is split; blank ones count, ends of lines of either kind."""
    lines = [f"line {i} " + "x" * (i % 50) if i % 7 else "" for i in range(2000)]
    put(tmp_path, "t/a b+c.jsonl", "\r\n".join(lines))
    put(tmp_path, "t/d.jsonl", "one\ntwo\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.transcripts(spark, f"{tmp_path}/t").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {(r.jsonl_path.rsplit("/", 1)[-1], r.line_number): r.raw for r in rows}
    names = {r.path for r in files.files(spark, f"{tmp_path}/t").select("path").collect()}
    assert {r.jsonl_path for r in rows} == names
    a = next(n for n in names if "d.jsonl" not in n).rsplit("/", 1)[-1]
    assert [got[a, i + 1] for i in range(1999)] == lines[:1999] and got["d.jsonl", 2] == "two"


def test_scope_counts_and_bursts(spark, tmp_path):
    from quern.streaming.ingest import dedupe, watch

    put(tmp_path, "s/a.txt", "x")
    put(tmp_path, "s/node_modules/b.txt", "x")
    put(tmp_path, "s/c.bin", "x")
    assert tuple(files.scope_counts(spark, f"{tmp_path}/s").first()) == (3, 1)
    changes = spark.createDataFrame([("a",), ("b",)], "path string")
    changes.repartition(2).write.parquet(f"{tmp_path}/in")
    runs = []
    q = watch(spark.readStream.schema(changes.schema).parquet(f"{tmp_path}/in"), lambda: runs.append(1), f"file://{tmp_path}/w", "100 milliseconds").start()
    q.processAllAvailable()
    q.stop()
    assert len(runs) == 1
    rows = spark.createDataFrame([("s", "a", "2026-01-01 00:00:00"), ("s", "a", "2026-01-01 00:00:05"), ("s", "b", "2026-01-01 00:00:00")], "session_id string, message_uuid string, t string").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/d")
    assert run_once(dedupe(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/d"), "t"), "within").count() == 2
