"""Stored state: manifests, archive, capture, states of notes, tasks, scope, bootstrap, migration, stored keyword index."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quern import store, verbs
from quern.api import Engine
from quern.operators import fts, keyword_index, recall, reconcile
from tests.test_api import NOTE, line
from tests.test_sources import put

TODAY = dt.date(2026, 6, 1)


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("engine")
    put(top, "home/always/lint.md", NOTE.format("lint", "always", "tags: [ci]\n", "always run the linter before pushing code"))
    put(top, "home/topics/db.md", NOTE.format("db", "topic", "custom: kept\n", "the database lives on the old host"))
    put(top, "t/a.jsonl", "\n".join([line("u1", "we always run the linter"), "", line("u2", "the deployment failed again")]))
    put(top, "t/b.jsonl", line("u3", "prefer the new host", session="s2").replace("/home/u/app", "/home/u/secret"))
    e = Engine(spark, f"{top}/store")
    e.build_index(f"{top}/home")
    e.ingest_transcripts(f"{top}/t")
    return e, top


def test_manifest_turns_all_tables_at_once(spark, tmp_path):
    db = store.Store(spark, f"{tmp_path}/db")
    assert db.version() == 0 and not db.has("a")
    db.commit({"a": spark.range(3), "b": spark.range(2)})

    class Broken(Exception):
        pass

    def fail():
        raise Broken

    whole = store.create
    try:
        store.create = lambda *a: fail()  # the parts are written, the manifest is not
        with pytest.raises(Broken):
            db.commit({"a": spark.range(9)}, {"b": spark.range(9)})
    finally:
        store.create = whole
    assert db.table("a").count() == 3 and db.table("b").count() == 2
    for _ in range(3):
        db.commit(add={"b": spark.range(1)}, fold_at=3)
    assert db.table("b").count() == 5 and len(db.manifest()["b"]) <= 3
    assert not store.create(spark, f"{db.root}/manifest-1.json", b"{}") and db.table("a").count() == 3
    store.replace(spark, f"{db.root}/x", b"one")
    store.replace(spark, f"{db.root}/x", b"two")
    assert store.read_small(spark, f"{db.root}/x") == "two"


def test_pointer_is_never_missing(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/v"
    with pytest.raises(FileNotFoundError):
        reconcile.read_current(spark, root)
    reconcile.write_version(spark.range(1), root, 1)
    monkeypatch.setattr(store, "create", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        reconcile.write_version(spark.range(2), root, 2)
    assert reconcile.read_current(spark, root).count() == 1
    monkeypatch.undo()
    with pytest.raises(OSError):
        reconcile.write_version(spark.range(3), root, 1)


@pytest.mark.parametrize("by", [None, "g"])
def test_numbered_equals_row_number(spark, by):
    from pyspark.sql import Window

    df = spark.range(500).select("id", (F.col("id") * 37 % 11).alias("k"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g")).repartition(5)
    over = (Window.partitionBy("g") if by else Window).orderBy(F.desc("k"), "id")
    want = {(r.id, r.n) for r in df.withColumn("n", F.row_number().over(over)).collect()}
    assert {(r.id, r.n) for r in store.numbered(df, [F.desc("k"), F.col("id")], "n", by).collect()} == want
    assert store.numbered(df.limit(0), [F.col("id")], "n", by).count() == 0


def test_nearest_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v[50] = v[20]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    cands, corpus = spark.createDataFrame([(f"c{i}", x) for i, x in rows[:25]], "cand string, embedding array<double>"), spark.createDataFrame(rows[20:], "mem long, embedding array<double>").repartition(4)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    score = np.round(u[:25] @ u[20:].T, 6)
    want = {f"c{i}": (20 + int(score[i].argmax()), round(float(score[i].max()), 6)) for i in range(25)}
    for block in (4096, 8):
        monkeypatch.setattr(recall, "BLOCK", block)
        assert {r.cand: (r.nearest, round(r.similarity, 6)) for r in recall.nearest(cands, corpus, "cand", "mem").collect()} == want
    assert recall.nearest(cands.limit(0), corpus, "cand", "mem").count() == 0 == recall.nearest(cands, corpus.limit(0), "cand", "mem").count()


def test_stored_keyword_index_scores_like_the_scan(home):
    e, _ = home
    m, text = e.table("messages"), F.col("content")
    for query in ("run the linter", "linter-before", "always-run", "deployment failed", "nothing-here", ""):
        phrases = fts.stem_phrases(fts.query_phrases(query))
        scan = {r.message_uuid: round(r.score, 9) for r in fts.bm25(m, "message_uuid", text, phrases, stemmed=True).collect()}
        stored = {r.id: r.score for r in keyword_index.topk(e.table("postings"), e.table("totals"), phrases, None).collect()}
        assert stored == pytest.approx(scan, abs=2e-6)
    before = e.table("postings").count()
    e.rebuild_fts()
    assert e.table("postings").count() == before > 0 and e.embed_missing() == 0 and e.width() == 384 and e.last_indexed().first().newest_mtime
    assert not e.suspect_index("linter") and e.file("/m/topics/db.md").count() == 1 == e.chunks_of("/m/topics/db.md").count()


def test_archive_and_forget(home, spark):
    e, top = home
    counts = lambda df: {r.action: r.n for r in df.collect()}
    assert counts(e.archive(f"{top}/t")) == {"copied": 2} and counts(e.archive(f"{top}/t")) == {"skipped_unchanged": 2}
    put(top, "t/a.jsonl", (top / "t/a.jsonl").read_text() + "\n" + line("u9", "one more line"))
    assert counts(e.archive(f"{top}/t")) == {"replaced_append": 1, "skipped_unchanged": 1}
    put(top, "t/a.jsonl", line("u7", "written over"))
    assert counts(e.archive(f"{top}/t")) == {"diverged_sidecar": 1, "skipped_unchanged": 1} and e.archive_facts().first().files == 3
    hidden = Engine(spark, e.store, exclude=["*/secret*"])
    assert counts(hidden.archive(f"{top}/t"))["removed_excluded"] == 1 and e.archive_facts().first().files == 2
    assert {r.session_id: r.n_lines for r in e.backfill().collect()} == {"s2": 1} and e.archive_facts().first().sessions == 2
    n = e.table("messages").count()
    e.forget("s2")
    assert e.table("messages").count() == n - 1 and e.table("archive").where("session_id = 's2'").isEmpty() and e.table("vectors").count() == n - 1
    with pytest.raises(KeyError):
        e.forget("s2")
    told = {r.label: r.status for r in e.doctor(f"{top}/home", archive_path=f"{top}/t").collect()}
    assert told["index made by another model or schema"] == "ok" == told["chunks that do not find themselves"] == told["messages that are not in the keyword index"]
    assert verbs.cloud_of("/home/u/Dropbox/store") == "Dropbox" and verbs.cloud_of("/home/u/store") is None and e.count_transcripts(f"{top}/t", 1) == 1


@pytest.fixture
def small(spark, tmp_path):
    put(tmp_path, "home/always/lint.md", NOTE.format("lint", "always", "", "always run the linter before pushing code"))
    put(tmp_path, "t/a.jsonl", line("u1", "we always run the linter"))
    put(tmp_path, "t/b.jsonl", line("u2", "the deployment failed again", session="s2"))
    e = Engine(spark, f"{tmp_path}/store")
    e.build_index(f"{tmp_path}/home")
    e.ingest_transcripts(f"{tmp_path}/t")
    return e, tmp_path


def test_backfill_heeds_excludes_and_goes_when_the_file_is_archived(small, spark):
    e, top = small
    hidden = Engine(spark, e.store, exclude=["/home/u/app"])
    assert hidden.backfill().count() == 0
    assert {r.session_id for r in e.backfill().collect()} == {"s1", "s2"}
    held = {r.path: r for r in e.table("archive").collect()}
    assert set(held) == {"backfill/s1.jsonl", "backfill/s2.jsonl"} and {r.cwd for r in held.values()} == {"/home/u/app"}
    assert {r.action: r.n for r in e.archive(f"{top}/t").collect()} == {"replaced_backfill": 2}
    rows = e.table("archive").collect()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in rows) == ["a.jsonl", "b.jsonl"] and {r.origin for r in rows} == {"live"}
    assert {r.action: r.n for r in e.archive(f"{top}/t").collect()} == {"skipped_unchanged": 2}
    e.backfill()
    assert hidden.archive(f"{top}/t").where("action = 'removed_excluded'").first().n == 2


def test_lost_chunks_are_found_by_their_text(small):
    e, _ = small
    assert e.lost_chunks(every=1).count() == 0
    foreign = e.table("chunks").withColumn("embedding", F.array(*[F.lit(float(i == 7)) for i in range(384)]))
    e.db.commit({"chunks": foreign})
    assert e.lost_chunks(every=1).count() == 1


def test_search_guards_the_index(small, spark):
    from quern.functions.vectors import Embedder

    class Other(Embedder):
        pass

    e, _ = small
    with pytest.raises(ValueError, match="made by Embedder"):
        Engine(spark, e.store, model=Other(384)).search("linter")
    with pytest.raises(ValueError):
        Engine(spark, e.store, model=Embedder(64)).search("linter")
    e.db.commit({"identity": store.staged(e.identity().withColumn("schema", F.lit(1))), "postings": store.staged(e.table("postings").limit(0))})
    assert e.guard() and not e.guard() and [r.id for r in e.search("linter", source="sessions").collect()][0] == "u1"


def test_unchanged_transcripts_are_not_read(small, spark, monkeypatch):
    from quern.sources import files

    e, top = small
    for i in range(40):
        put(top, f"t/old [{i}]{{x}}.jsonl", "\n".join(line(f"o{i}-{k}", f"text {k}", session=f"o{i}") for k in range(3)))
    e.ingest_transcripts(f"{top}/t")
    assert e.table("messages").count() == 122
    put(top, "t/new+1 ü.jsonl", "\n".join(["", line("n1", "a new line"), "", line("n2", "another")]))
    read, real = [], files.transcripts
    monkeypatch.setattr(files, "transcripts", lambda sp, *roots: read.append(roots) or real(sp, *roots))
    e.ingest_transcripts(f"{top}/t")
    assert [len(r) for r in read] == [1] and {r.message_uuid: r.line_number for r in e.table("messages").where("message_uuid in ('n1', 'n2')").collect()} == {"n1": 2, "n2": 4}
    e.ingest_transcripts(f"{top}/t")
    assert [len(r) for r in read] == [1, 0] and e.table("messages").count() == 124


def test_lines_are_numbered_over_splits(spark, tmp_path):
    from quern.sources import files

    for name, n in (("a", 5000), ("b", 1), ("c", 0), ("d", 3000)):
        put(tmp_path, f"t/{name}.jsonl", "\n".join(f"{name}{i} " + "x" * (i % 90) for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.transcripts(spark, f"{tmp_path}/t").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 8001 and all(r.raw.split(" ")[0] == f"{r.jsonl_path[-7]}{r.line_number - 1}" for r in rows)


def test_capture_and_states(home):
    e, top = home
    at = f"{top}/home"
    path = e.capture(at, "topic", "cache.md", "cache", "where the cache is: here", tags=["ops"])
    meta, body = verbs.split_note((top / "home/topics/cache.md").read_text())
    assert path.endswith("/topics/cache.md") and meta["type"] == "topic" and meta["description"] == "where the cache is: here" and "# cache" in body
    assert e.file("/m/topics/cache.md").count() == 1
    with pytest.raises(FileExistsError):
        e.capture(at, "topic", "cache.md", "cache", "again")
    with pytest.raises(ValueError, match="known"):
        e.capture(at, "topic", "copy.md", "cache", "where the cache is: here")
    assert e.capture(at, "topic", "copy.md", "cache", "where the cache is: here", force=True)
    for bad in ({"filename": "../x.md"}, {"layer": "other"}, {"project": "a/b"}):
        with pytest.raises(ValueError):
            e.capture(**({"home": at, "layer": "topic", "filename": "n.md", "name": "n", "description": "d"} | bad))
    e.suspect(at, "topics/db.md", "moved")
    assert e.chunks_of("/m/topics/db.md").first().suspected_at
    e.confirm(at, "topics/db.md")
    row, meta = e.chunks_of("/m/topics/db.md").first(), verbs.split_note((top / "home/topics/db.md").read_text())[0]
    assert row.last_confirmed == "2026-06-01" and row.suspected_at is None and meta["custom"] == "kept" and "suspect_reason" not in meta
    e.invalidate(at, "topics/db.md", reason="gone")
    assert e.chunks_of("/m/topics/db.md").first().invalidated_at and "Invalidated: gone" in (top / "home/topics/db.md").read_text()
    for again in (lambda: e.invalidate(at, "topics/db.md"), lambda: e.suspect(at, "topics/db.md")):
        with pytest.raises(ValueError, match="already"):
            again()


def test_tasks_are_created_once_and_changed_after_a_second_look(spark, tmp_path, monkeypatch):
    home = f"{tmp_path}/h"
    assert [verbs.add_task(spark, home, "fix", "Fix it", TODAY) for _ in range(3)] == ["fix", "fix-2", "fix-3"]
    assert verbs.move_task(spark, home, "fix", "start", TODAY, "s1")["session_id"] == "s1"
    verbs.move_task(spark, home, "fix", "block", TODAY, reason="waiting")
    assert "Blocked: waiting" in (tmp_path / "h/tasks/fix.md").read_text()
    assert verbs.move_task(spark, home, "fix-2", "done", TODAY)["session_id"] == ""
    e = Engine(spark, f"{tmp_path}/store")
    assert [r.id for r in e.tasks(home).collect()] == ["fix", "fix-3"]
    file, real, turns = tmp_path / "h/tasks/fix-3.md", store.read_small, []

    def racing(sp, path):
        text = real(sp, path)
        if len(turns) < 2 and not turns.append(1) and len(turns) % 2:
            file.write_text(text + "\nanother writer")
        return text

    monkeypatch.setattr(store, "read_small", racing)
    verbs.move_task(spark, home, "fix-3", "start", TODAY, "s9")
    assert "another writer" in file.read_text() and "s9" in file.read_text()
    monkeypatch.setattr(store, "read_small", lambda sp, path: real(sp, path) + str(turns.append(1) or len(turns)))
    with pytest.raises(RuntimeError):
        verbs.move_task(spark, home, "fix-3", "done", TODAY)
    with pytest.raises(FileNotFoundError):
        verbs.move_task(spark, home, "none", "done", TODAY)


def test_scope_is_stored_and_imported_once(spark, tmp_path):
    put(tmp_path, "docs/Ops/notes.txt", "rotate the logs weekly")
    put(tmp_path, "docs/Ops/private.txt", "not for others")
    put(tmp_path, "settings.yaml", "k: 7\ninclude_dirs: [/gone]\n")
    at, root = f"{tmp_path}/settings.yaml", f"{tmp_path}/docs"
    verbs.edit_scope(spark, at, add=[root, root], deny=["*private*"])
    assert verbs.scope(spark, at) == (["/gone", root], ["*private*"]) and "k: 7" in (tmp_path / "settings.yaml").read_text()
    e = Engine(spark, f"{tmp_path}/store")
    done = lambda: {r.root: r.done for r in e.import_included(at).collect()}
    assert done() == {"/gone": "missing", root: "imported"} and done() == {"/gone": "missing", root: "unchanged"}
    assert e.table("messages").count() == 1 and e.unimported(at).count() == 0
    verbs.edit_scope(spark, at, remove=["/gone"], allow=["*private*"])
    assert e.unimported(at).count() == 1 and done() == {root: "imported"} and e.unimported(at).count() == 0


def test_bootstrap_goes_on_and_refuses_another_scope(home, spark, tmp_path):
    e, top = home
    folder = f"{tmp_path}/plan"
    assert e.bootstrap(folder, probes=("we always", "deployment")) is None  # all of it is older than the scope's days
    plan = e.bootstrap(folder, {"days": 400}, probes=("we always", "deployment"))
    assert plan["batches"] == ["app"] and plan["written"] > 0 and "capture: `" in (tmp_path / "plan/review-app.md").read_text()
    assert e.bootstrap(folder, {"days": 400}, probes=("we always",)) == plan
    with pytest.raises(ValueError, match="scope"):
        e.bootstrap(folder, {"slugs": ["other"], "days": 400})
    assert verbs.finish_batch(spark, f"{folder}/plan.json", "app")["completed"] == ["app"] and verbs.open_batches(verbs.load_plan(spark, f"{folder}/plan.json")) == []
    with pytest.raises(ValueError):
        verbs.finish_batch(spark, f"{folder}/plan.json", "none")
    (tmp_path / "plan/plan.json").write_text("{")
    with pytest.raises(ValueError, match="damaged"):
        e.bootstrap(folder)


def test_migration_and_rendering(home, spark, tmp_path):
    e, top = home
    old = "---\nname: Foo\ndescription: about foo\ntype: feedback\n---\n\nask before deleting\n"
    put(tmp_path, "proj/memory/feedback_foo.md", old)
    put(tmp_path, "proj/memory/project_same.md", old)
    put(tmp_path, "proj/memory/MEMORY.md", "index")
    moved = e.migrate(f"{tmp_path}/proj", f"{top}/home").collect()
    assert len(moved) == 1 and moved[0].target.endswith("-foo.md") and e.migrate(f"{tmp_path}/proj", f"{top}/home").count() == 0
    hits = e.search("run the linter")
    told = json.loads(verbs.render_json(hits))
    assert told["memory"] and told["session"] and "== memory" in verbs.render_layers(hits)
    alone = verbs.render_layers(hits.where("tier = 'session'"), promote=True)
    assert "worth a note" in alone
