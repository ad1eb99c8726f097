"""The archive's digests and pieces, tables that are dealt by key, lookups by Bloom filters, state with an end."""

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from quern import store
from quern.api import Engine
from quern.operators import ingest, reconcile
from quern.sources import files
from tests.test_api import NOTE, line
from tests.test_keyword_index import scan_rows
from tests.test_sources import put


def counts(df):
    return {r.action: r.n for r in df.collect()}


def held(e, session=None):
    return {r.path.rsplit("/", 1)[-1]: bytes(r.data) for r in e.archived(session).collect()}


def plain_chain(data: bytes) -> str:
    told = ""
    for i in range(0, len(data), reconcile.BLOCK):
        told = hashlib.sha256(told.encode() + data[i : i + reconcile.BLOCK]).hexdigest()
    return told


def test_chain_equals_a_plain_one(spark):
    rng = __import__("random").Random(3)
    sizes = [0, 1, 65535, 65536, 65537, 131072, 200000]
    rows = [(n, up, bytearray(rng.randbytes(n))) for n in sizes for up in sizes if up <= n]
    df = spark.createDataFrame(rows, "n long, up long, data binary").withColumn("told", reconcile.chain(F.col("data"), F.col("up")))
    assert all(r.told == plain_chain(bytes(r.data)[: r.up]) for r in df.collect())
    assert spark.createDataFrame([(None,)], "data binary").select(reconcile.chain(F.col("data"), F.lit(5).cast("long")).alias("c")).count() == 1


def test_reconcile_beyond_a_block(spark):
    a, b = b"a" * 70000, b"b" * 70000
    live = spark.createDataFrame([("grown", 2, 140000, bytearray(a + b)), ("other", 2, 140000, bytearray(a + b)), ("shorter", 2, 70000, bytearray(a)), ("empty", 2, 0, bytearray())], "path string, mtime_unix long, size_bytes long, data binary")
    arch = spark.createDataFrame([("grown", bytearray(a + b[:5])), ("other", bytearray(a + b[:-1] + b"c")), ("shorter", bytearray(a + b"x")), ("empty", bytearray())], "path string, data binary")
    man = arch.select("path", F.lit(1).cast("long").alias("mtime_unix"), F.lit(1).cast("long").alias("size_bytes"), F.lit("live").alias("origin"))
    want = {"grown": "replaced_append", "other": "diverged_sidecar", "shorter": "diverged_sidecar", "empty": "replaced_append"}
    for old in (arch, reconcile.digested(arch)):
        assert {r.path: r.action for r in reconcile.archive_reconcile(live, old, man).collect()} == want


@pytest.fixture
def small(spark, tmp_path):
    for n in range(12):
        put(tmp_path, f"home/topics/n{n}.md", NOTE.format(f"n{n}", "topic", "", f"note number {n} is about subject {n}"))
    for n in range(3):
        put(tmp_path, f"t/{n}.jsonl", line(f"u{n}", f"message {n}", session=f"s{n}"))
    return Engine(spark, f"{tmp_path}/store"), tmp_path


def test_a_second_run_reads_and_writes_no_content(small, monkeypatch):
    e, top = small
    assert counts(e.archive(f"{top}/t")) == {"copied": 3}
    before, read = e.db.manifest(), []
    real = files.contents
    monkeypatch.setattr(files, "contents", lambda sp, *paths: read.append(len(paths)) or real(sp, *paths))
    assert counts(e.archive(f"{top}/t")) == {"skipped_unchanged": 3} and read == [0] and e.db.manifest() == before
    whole = (top / "t/1.jsonl").read_bytes() + b"\n" + line("u9", "more", session="s1").encode()
    (top / "t/1.jsonl").write_bytes(whole)
    assert counts(e.archive(f"{top}/t")) == {"replaced_append": 1, "skipped_unchanged": 2} and read == [0, 1]
    assert e.db.manifest()["pieces"][: len(before["pieces"])] == before["pieces"]  # the old content stays where it was
    assert held(e)["1.jsonl"] == whole and sorted(len(r.data) for r in e.table("pieces").collect())[0] < len(whole) / 1.5
    (top / "t/2.jsonl").write_text(line("u8", "written over", session="s2"))
    assert counts(e.archive(f"{top}/t")) == {"diverged_sidecar": 1, "skipped_unchanged": 2}
    assert counts(e.archive(f"{top}/t")) == {"skipped_unchanged": 3} and read == [0, 1, 1, 0]
    assert len(held(e, "s2")) == 2 and b"written over" in b"".join(held(e, "s2").values())
    os.utime(top / "t/0.jsonl", (1, 1))
    assert counts(e.archive(f"{top}/t"))["replaced_append"] == 1 and held(e)["0.jsonl"] == (top / "t/0.jsonl").read_bytes()


def test_what_cannot_be_read_is_counted(small):
    e, top = small
    (top / "t/.1.jsonl.crc").write_bytes(b"crc\0\0\0\2\0\1\2\3\4")  # a checksum that its file does not have
    assert counts(e.archive(f"{top}/t")) == {"copied": 2, "unreadable": 1}
    (top / "t/.1.jsonl.crc").unlink()
    assert counts(e.archive(f"{top}/t")) == {"copied": 1, "skipped_unchanged": 2} and len(held(e)) == 3


def test_prune_and_content_that_goes(small, spark):
    e, top = small
    assert e.prune() == 0 and counts(e.archive(f"{top}/t")) == {"copied": 3}
    assert counts(Engine(spark, e.store, exclude=["/home/u/app"]).archive(f"{top}/t")) == {"removed_excluded": 3}
    assert e.table("archive").isEmpty() and e.table("pieces").isEmpty()
    assert counts(e.archive(f"{top}/t")) == {"copied": 3} and e.prune() == 3 and held(e) == {} and counts(e.archive(f"{top}/t")) == {"copied": 3}
    e.build_index(f"{top}/home")
    told = {r.label: r.status for r in e.doctor(f"{top}/home", archive_path=f"{top}/t").collect()}
    assert told["the archive cannot be written to"] == "ok" == told["transcripts that are not archived"] and not store.writable(spark, f"{top}/t/0.jsonl/below")


def test_an_older_archive_is_taken_over(small, spark):
    e, top = small
    old = files.files(spark, f"{top}/t", "*.jsonl").select("path", F.lit("/home/u/app").alias("cwd"), F.concat(F.lit("s"), F.regexp_extract("path", r"(\d)\.jsonl", 1)).alias("session_id"), F.col("content").alias("data"), "mtime_unix", "size_bytes", F.lit("live").alias("origin"))
    e.db.commit({"archive": store.staged(old)})
    assert counts(e.archive(f"{top}/t")) == {"skipped_unchanged": 3} and held(e)["1.jsonl"] == (top / "t/1.jsonl").read_bytes()


def test_a_change_of_one_note_writes_its_bucket(small, monkeypatch):
    e, top = small
    home = f"{top}/home"
    e.build_index(home)
    before, read = e.db.manifest(), []
    real = files.files
    monkeypatch.setattr(files, "files", lambda sp, root, glob="*", only=None: read.append(only) or real(sp, root, glob, only))
    e.confirm(home, "topics/n3.md")
    after = e.db.manifest()
    for name in ("chunks", "files"):
        assert len(before[name]) > 4 and len(set(before[name]) - set(after[name])) == 1 == len(set(after[name]) - set(before[name]))
    assert read == [["topics/n3.md"]] and e.chunks_of("/m/topics/n3.md").first().last_confirmed == "2026-06-01" and e.table("chunks").count() == 12
    (top / "home/topics/n5.md").unlink()
    put(top, "home/topics/n6.md", "no frontmatter")
    put(top, "home/topics/new.md", NOTE.format("new", "topic", "", "a new note"))
    got = {r.path: r.action for r in e.update_index(home).collect() if r.action != "keep"}
    assert got == {"/m/topics/n5.md": "drop", "/m/topics/n6.md": "drop_invalid", "/m/topics/new.md": "add"}
    assert e.table("chunks").count() == 11 and e.table("files").count() == 12 and e.file("/m/topics/n6.md").first().reason
    again = e.db.manifest()
    assert set(e.update_index(home).select("action").distinct().toPandas()["action"]) <= {"keep", "invalid"}
    assert all(e.db.manifest()[n] == again[n] for n in ("chunks", "files"))
    fresh = Engine(e.spark, f"{top}/fresh")
    fresh.build_index(home)
    cols = [c for c in fresh.table("chunks").columns if c != "embedding"]
    assert sorted(map(str, fresh.table("chunks").select(cols).collect())) == sorted(map(str, e.table("chunks").select(cols).collect()))


def test_dealt_tables_empty_and_of_older_parts(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    plain = store.Store(spark, f"{tmp_path}/db")
    plain.commit({"t": rows})
    db = store.Store(spark, f"{tmp_path}/db", dealt={"t": "k"})
    one = rows.where("k = '7'")
    db.commit(patch={"t": (one.withColumn("v", F.lit(700).cast("long")), one)})  # all of the older part is dealt now
    assert {r.v for r in db.table("t").collect()} == ({*range(40)} - {7}) | {700} and len(db.manifest()["t"]) > 10
    db.commit(patch={"t": (rows.limit(0), rows)})
    assert db.table("t").count() == 0 and db.table("t").columns == ["k", "v"]
    db.commit(patch={"t": (one, one)})
    assert [r.v for r in db.table("t").collect()] == [7]
    db.commit(patch={"t": (rows.limit(0), rows.limit(0))})
    assert [r.v for r in db.table("t").collect()] == [7]


def test_a_batch_meets_the_parts_of_its_sessions(spark, tmp_path):
    def rows(sessions, n):
        return spark.createDataFrame([(s, f"{s}-{i}", "/t", i) for s in sessions for i in range(n)], "session_id string, message_uuid string, jsonl_path string, line_number int")

    db = store.Store(spark, f"{tmp_path}/db", {"messages": ingest.LAYOUT})
    for k in range(6):  # ranges of names overlap, so that only the filters tell the parts apart
        db.commit(add={"messages": rows([f"{c}-{k}" for c in "amz"], 500).coalesce(1)})
    batch = rows(["m-2", "m-9"], 600)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with ingest.by_blooms(spark):
            known = ingest.of_sessions(db.table("messages"), batch).select("session_id", "message_uuid")
            assert len(known.collect()) == 500 and scan_rows(known) == 1500
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    new = ingest.first_writer(batch, ingest.of_sessions(db.table("messages"), batch))
    assert {r.message_uuid for r in new.collect()} == {f"m-2-{i}" for i in range(500, 600)} | {f"m-9-{i}" for i in range(600)}
    many = rows([f"x{i}" for i in range(ingest.MOST_SESSIONS + 1)], 1)
    assert ingest.of_sessions(db.table("messages"), many).count() == 9000


def test_threshold_state_ends(spark, tmp_path):
    from quern.streaming.events import first_over

    kind = "session_id string, ts timestamp, value double"
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    batches = [[("a", day(0), 70.0), ("a", day(0), 80.0), ("b", day(0), 1.0)], [("a", day(1), 90.0), ("b", day(1), 60.0)], [("c", day(60), 1.0)], [("d", day(61), 1.0)], [("a", day(62), 75.0), ("c", None, 99.0)]]
    seen = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = first_over(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), 60.0)
        q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).outputMode("append").foreachBatch(lambda df, i, n=n: seen.extend((n, r.session_id) for r in df.collect())).start()
        q.awaitTermination()
    assert sorted(seen) == [(0, "a"), (1, "b"), (4, "a")]
