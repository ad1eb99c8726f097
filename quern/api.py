"""The engine's verbs over a store folder: index, search, ingest, recall, review, coverage, doctor, forget, import.

A store holds tables (files, chunks, identity, messages, vectors, postings, stats, totals, ledger, archive, pieces) under one manifest:
a change of several is written beside the old ones and then turned to at once, so that readers and failures never meet
half of it; ingest adds parts and rewrites nothing.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern import store, verbs
from quern.config import DEFAULTS, Settings
from quern.functions import chunks as chunking
from quern.functions import text as rules
from quern.functions.globs import excluded
from quern.functions.vectors import Embedder, embedder
from quern.operators import fts, health, ingest, keyword_index, recall, reconcile, review, search, state
from quern.sources import files, sinks
from quern.store import Store, staged

SOURCES = ("memory", "sessions", "all")
#: Number of the layout of the store's tables.
SCHEMA = 3
#: The archive: a row a file, and the files' content in pieces.
ARCHIVE = "path string, of string, cwd string, session_id string, blob string, mtime_unix long, size_bytes long, digest string, origin string"
ARCHIVE_COLUMNS = [c.split(" ")[0] for c in ARCHIVE.split(", ")]
PIECES = "blob string, start long, data binary"
#: A component of a path that may come from outside: no separators, no dots alone, no control characters.
SAFE = r"^(?!\.+$)[\p{L}\p{N}_.\-]{1,255}$"


def prefix_of(root: str) -> str:
    """A short name of an included folder, for its messages and its mark."""
    return hashlib.sha256(root.rstrip("/").encode()).hexdigest()[:16]


def is_safe(component: Column) -> Column:
    return F.coalesce(component.rlike(SAFE), F.lit(False))


def load_settings(raw: str) -> Settings:
    """Settings of a YAML text: unknown keys are dropped, the others keep the type of their default."""
    import dataclasses

    import yaml

    given = yaml.safe_load(raw) or {}
    new = {}
    for f in dataclasses.fields(Settings):
        if f.name in given:
            old = getattr(DEFAULTS, f.name)
            new[f.name] = tuple(given[f.name]) if isinstance(old, tuple) else type(old)(given[f.name]) if not isinstance(old, (dt.date, dt.datetime)) else given[f.name]
    return dataclasses.replace(DEFAULTS, **new)


def scope_edit(dirs: list[str], add: list[str] = (), remove: list[str] = ()) -> list[str]:
    """Included folders after an edit: in order of first sight, without the removed ones."""
    return [d for d in dict.fromkeys([*dirs, *add]) if d not in set(remove)]


class Engine:
    def __init__(self, spark: SparkSession, store: str, settings: Settings = DEFAULTS, model: Embedder | None = None, exclude: list[str] = ()):
        self.spark, self.store, self.s, self.exclude = spark, store.rstrip("/"), settings, list(exclude)
        self.model = model or embedder("hashing", settings.dim)
        self.db = Store(spark, self.store, {"postings": keyword_index.LAYOUT, "messages": ingest.LAYOUT}, {"files": "file_path", "chunks": "file_path"})

    # ------------------------------------------------------------------ tables

    def has(self, name: str) -> bool:
        return self.db.has(name)

    def table(self, name: str) -> DataFrame:
        return self.db.table(name)

    def identity(self) -> DataFrame:
        """One row: by which model and in what width vectors are made, and when the index was made last."""
        return self.spark.createDataFrame([(type(self.model).__name__, self.model.dim, SCHEMA, self.s.now)], "model string, dim int, schema int, indexed_at timestamp_ntz")

    # ------------------------------------------------------------------ notes

    def _disk(self, home: str, only: list[str] | None = None) -> DataFrame:
        raw = files.memory_files(self.spark, home, only).select("path", "rel", "content", "mtime_unix", F.sha2("content", 256).alias("hash"))
        return raw.join(files.notes(raw), "path").withColumn("file_path", F.concat(F.lit("/m/"), "rel"))

    @staticmethod
    def _files(disk: DataFrame) -> DataFrame:
        return disk.select("file_path", "hash", "ok", "reason", "mtime_unix")

    def _chunks(self, notes: DataFrame) -> DataFrame:
        """Chunks of notes with their vectors; a note without a body is one chunk of its name and description."""
        cut = chunking.chunks(notes.select("file_path", "body"), "file_path", "body", self.s.chunk_bytes)
        meta = notes.select("file_path", "name", "description", "tags", "aliases", "created", "updated", "valid_from", "invalidated_at", "last_confirmed", "suspected_at")
        full = meta.join(cut, "file_path", "left").withColumn("text", F.coalesce("text", F.concat_ws(": ", "name", "description"))).fillna({"chunk_no": 0, "line_start": 1, "line_end": 1})
        full = full.withColumn("chunk_id", F.xxhash64("file_path", "chunk_no"))
        return full.join(self.model.embed(full.select("chunk_id", chunking.embedding_text(F.col("name"), F.col("text")).alias("t")), "chunk_id", F.col("t")), "chunk_id")

    def build_index(self, home: str) -> DataFrame:
        """A full rebuild; the old index stays until the new one stands. Returns counters by disposition."""
        disk = self._disk(home)
        self.db.commit({"files": self._files(disk), "chunks": self._chunks(disk.where("ok")), "identity": self.identity()})
        return self.table("files").groupBy(F.when(F.col("ok"), "indexed").otherwise(F.concat(F.lit("skipped: "), "reason")).alias("disposition")).agg(F.count("*").alias("n"))

    def update_index(self, home: str, only: list[str] | None = None) -> DataFrame:
        """Re-reads changed notes only, by content hash; returns path and action of every file, or of those named.

        only: paths below the home; no other file is read then. Of the tables the changed paths' buckets are written.
        """
        if not self.has("files"):
            self.build_index(home)
        disk = self._disk(home, only)
        known = self.table("files")
        if only is not None:
            known = known.where(F.col("file_path").isin([f"/m/{rel}" for rel in only]))
        actions = staged(reconcile.index_diff(disk.select(F.col("file_path").alias("path"), "hash", "ok"), known.where("ok").select(F.col("file_path").alias("path"), "hash")), "actions")
        touched = actions.where("action not in ('keep', 'invalid')").select(F.col("path").alias("file_path"))
        chunks = self._chunks(disk.where("ok").join(touched, "file_path", "left_semi"))
        rows = staged(self._files(disk), "files")
        new = rows.exceptAll(known.select(*rows.columns))
        other = new.select("file_path").unionByName(known.join(rows, "file_path", "left_anti").select("file_path"))
        self.db.commit({"identity": self.identity()}, patch={"chunks": (chunks, touched), "files": (new, other)})
        return actions

    # ------------------------------------------------------------------ transcripts

    def ingest_transcripts(self, path: str, full: bool = False) -> DataFrame:
        """Reads new and grown transcripts, keeps the first writer of each message; counters by disposition.

        Excluded paths are dropped before anything is stored. full reads all files again.
        """
        listing = files.files(self.spark, path, "*.jsonl").select("path", "mtime_unix", "size_bytes")
        listing = listing.where(~excluded(F.col("path"), self.exclude))
        todo = listing if full or not self.has("ledger") else ingest.changed_files(listing, self.table("ledger"))
        # what has not changed is not opened; the names of what has are fewer than those that Spark's own listing holds
        lines = files.transcripts(self.spark, *[files.as_path(r.path) for r in todo.select("path").collect()])
        told = ingest.messages(lines)
        good = told.where("disposition = 'message'").where(is_safe(F.col("session_id"))).drop("kind", "disposition")
        told_, listing = staged(ingest.counters(told), "counters"), staged(listing, "listing")
        self._add_messages(good, {"ledger": listing})
        return told_

    def _add_messages(self, rows: DataFrame, put: dict[str, DataFrame] | None = None) -> DataFrame:
        """Adds the messages that the store lacks, with their vectors and postings, all in one version."""
        rows = staged(rows, "rows")
        with ingest.by_blooms(self.spark):
            old = ingest.of_sessions(self.table("messages"), rows) if self.has("messages") else None
            new = ingest.first_writer(rows, old)
            new = staged(new if old is None else new.select(*old.columns), "new")
        text = F.col("content")
        add = {"messages": new, "vectors": self.model.embed(new.select("message_uuid", "content"), "message_uuid", text)} | self._postings(new)
        self.db.commit(put, add)
        return new

    @staticmethod
    def _postings(messages: DataFrame) -> dict[str, DataFrame]:
        return dict(zip(("postings", "stats", "totals"), keyword_index.build(messages, "message_uuid", F.col("content"), True), strict=True))

    def embed_missing(self) -> int:
        """Adds vectors for the messages that lack one; how many. What is stored is never embedded again."""
        rows = self.table("messages").select("message_uuid", "content")
        todo = staged(ingest.unembedded(rows, self.table("vectors"), "message_uuid"), "todo")
        many = todo.count()
        if many:
            made = staged(self.model.embed(todo, "message_uuid", F.col("content")), "made")
            if made.count() != many:
                raise RuntimeError(f"{many} messages gave {made.count()} vectors")
            self.db.commit(add={"vectors": made})
        return many

    def upsert_vectors(self, rows: DataFrame) -> None:
        """Replaces the vectors of the rows' messages (message_uuid, embedding) and adds those that are new."""
        self.db.commit({"vectors": reconcile.replace_rows(self.table("vectors"), rows.select("message_uuid", "embedding"), "message_uuid", rows)})

    def rebuild_fts(self) -> None:
        """Postings and lengths of all messages, made anew."""
        self.db.commit(self._postings(self.table("messages")))

    def forget(self, session: str) -> None:
        """Drops a session from every table and from the archive, in one version; an unknown one is an error."""
        gone = self.spark.createDataFrame([(session,)], "session_id string")
        m = self.table("messages")
        ids = staged(m.join(gone, "session_id", "left_semi").select("message_uuid", "jsonl_path"), "forgotten")
        archived = self.table("archive").where(F.col("session_id") == session) if self.has("archive") else None
        if ids.isEmpty() and (archived is None or archived.isEmpty()):
            raise KeyError(f"no session {session!r}")
        without = lambda t: self.table(t).join(ids.select("message_uuid"), "message_uuid", "left_anti")
        put = {"messages": reconcile.forget({"m": m}, gone)["m"]} | ({"vectors": without("vectors")} if self.has("vectors") else {})
        if self.has("postings"):
            lost = ids.select(F.col("message_uuid").alias("id"))
            put |= {"postings": keyword_index.without(self.table("postings"), lost), "stats": (stats := self.table("stats").join(lost, "id", "left_anti"))}
            put["totals"] = stats.agg(F.count("*").alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))
        if self.has("ledger"):
            put["ledger"] = self.table("ledger").join(ids.select(F.col("jsonl_path").alias("path")).distinct(), "path", "left_anti")
        if archived is not None:
            held, pieces = self._archived()
            put["archive"] = held.where(~F.col("session_id").eqNullSafe(session))
            put["pieces"] = pieces.join(put["archive"].select("blob"), "blob", "left_semi")
        self.db.commit(put)

    # ------------------------------------------------------------------ archive

    def _archived(self) -> tuple[DataFrame, DataFrame]:
        """The archive's rows and its pieces of content; both empty where there is none."""
        if not self.has("archive"):
            return self.spark.createDataFrame([], ARCHIVE), self.spark.createDataFrame([], PIECES)
        if "data" in self.table("archive").columns:  # an older layout, with the content beside the rest
            old = self.table("archive").withColumns({"of": F.col("path"), "blob": F.sha2("path", 256)})
            rows = reconcile.digested(old).select(*ARCHIVE_COLUMNS)
            self.db.commit({"archive": rows, "pieces": old.select("blob", F.lit(0).cast("long").alias("start"), "data")})
        return self.table("archive"), self.table("pieces")

    def _keep(self, rows: DataFrame, pieces: DataFrame) -> None:
        """The archive's rows anew, with pieces to add; the content that no row names any more goes."""
        rows, before = staged(rows.select(*ARCHIVE_COLUMNS), "rows"), self._archived()
        lost = before[0].select("blob").join(rows.select("blob"), "blob", "left_anti")
        if not self.has("pieces") or not lost.isEmpty():
            self.db.commit({"archive": rows, "pieces": before[1].unionByName(pieces).join(rows.select("blob"), "blob", "left_semi")})
        else:
            self.db.commit({"archive": rows}, {"pieces": pieces})

    def archive(self, path: str) -> DataFrame:
        """Keeps the bytes of transcripts that may go from disk; counters by what was done.

        The archive's rows are path, of (the live file), cwd, session_id, blob, mtime_unix, size_bytes, digest and origin;
        content lies beside them in pieces (blob, start, data). Files whose time and size are known are not opened; a
        grown one adds the bytes that are new, if the digest of those before is that of what is archived. A backfilled
        one is replaced, another of the same name is kept beside the old one under a name with its content's hash. Files
        whose folder (cwd) is excluded now are neither taken nor left in the archive; one whose folder cannot be told
        stays. A file that cannot be read is counted as unreadable and does not end the run.
        """
        old, pieces = self._archived()
        held, gone = reconcile.now_excluded(old, self.exclude)
        listing = staged(files.files(self.spark, path, "*.jsonl").select("path", "mtime_unix", "size_bytes"), "listing")
        same = ["path", "mtime_unix", "size_bytes"]
        known = old.select(F.col("of").alias("path"), *same[1:])
        todo = staged(listing.join(known, same, "left_anti").select("path"), "todo")
        # one reading gives the digests and the bytes that are kept; the names are fewer than those of Spark's own listing
        raw = staged(files.contents(self.spark, *[r.path for r in todo.collect()]), "read")
        cwd, session = files.head_fields(F.col("data"))
        live = raw.withColumns({"cwd": cwd, "session_id": session}).where(~F.coalesce(excluded(F.col("cwd"), self.exclude), F.lit(False)))
        # a session that was put together again goes by its transcript's name, so that this replaces it, but not if that one is archived as well
        named = live.where("session_id is not null").groupBy("session_id").agg(F.min("path").alias("__live")).join(held.select(F.col("path").alias("__live")), "__live", "left_anti")
        name = F.when(F.col("origin") == "backfill", F.coalesce("__live", "path")).otherwise(F.col("path"))
        held = held.join(named, "session_id", "left").withColumn("path", name).select(*ARCHIVE_COLUMNS)
        manifest = held.select("path", F.col("size_bytes").alias("kept"), "digest", "mtime_unix", "size_bytes", "origin")
        decided = staged(reconcile.archive_reconcile(live, manifest, manifest), "decided")
        before = held.select("path", F.col("blob").alias("__blob"), F.col("size_bytes").alias("__kept"))
        grown = F.col("action") == "replaced_append"
        taken = live.join(decided.where("action <> 'skipped_unchanged'"), "path").join(before, "path", "left").withColumns({"of": F.col("path"), "path": F.coalesce("sidecar", "path"), "digest": reconcile.chain(F.col("data"), F.col("size_bytes")), "origin": F.lit("live")})
        taken = taken.withColumn("blob", F.when(grown, F.col("__blob")).otherwise(F.sha2(F.concat_ws("/", "path", "digest"), 256)))
        if not todo.isEmpty() or not gone.isEmpty():
            rows = staged(taken.select(*ARCHIVE_COLUMNS), "taken")
            start = F.when(grown, F.col("__kept")).otherwise(F.lit(0).cast("long"))
            more = taken.withColumn("start", start).where("size_bytes > start or size_bytes = 0")
            more = more.select("blob", "start", F.expr("substring(data, cast(start + 1 as int))").alias("data")).join(pieces.select("blob", "start"), ["blob", "start"], "left_anti")
            if not rows.isEmpty() or not gone.isEmpty():
                self._keep(held.join(rows.select("path"), "path", "left_anti").unionByName(rows), more)
        count = lambda df, action: df.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(action).alias("action"), "n")
        shut = gone.select(F.col("of").alias("path"))
        skipped = listing.join(known, same, "left_semi").join(shut, "path", "left_anti")
        told = decided.groupBy("action").agg(F.count("*").alias("n")).unionByName(count(todo.join(raw, "path", "left_anti"), "unreadable"))
        return staged(told.unionByName(count(skipped, "skipped_unchanged")).unionByName(count(gone, "removed_excluded")), "told")

    def archived(self, session: str | None = None) -> DataFrame:
        """path and data of the archived files, or of one session's."""
        rows, pieces = self._archived()
        return reconcile.restored(rows if session is None else rows.where(F.col("session_id") == session), pieces)

    def prune(self) -> int:
        """Empties the archive, so that the next run takes every file as new; how many files went."""
        if not self.has("archive"):
            return 0
        many = self.table("archive").count()
        self.db.commit({"archive": self.spark.createDataFrame([], ARCHIVE), "pieces": self.spark.createDataFrame([], PIECES)})
        return many

    def backfill(self) -> DataFrame:
        """Sessions of the index that the archive lacks, put together again and archived; session_id and n_lines.

        Sessions whose folder (cwd) is excluded are left out.
        """
        held, _ = self._archived()
        of_session = self.table("messages").groupBy("session_id").agg(F.min_by("cwd", F.when(F.col("cwd") != "", F.col("line_number"))).alias("cwd"))
        open_ = staged(of_session.where(~F.coalesce(excluded(F.col("cwd"), self.exclude), F.lit(False))).join(held.select("session_id").distinct(), "session_id", "left_anti"), "open")
        lines = ingest.to_jsonl(self.table("messages").join(open_.select("session_id"), "session_id", "left_semi"))
        made = staged(reconcile.reassemble(lines.withColumnsRenamed({"raw": "content"}).withColumn("message_uuid", F.lit(""))), "backfilled")
        rows = made.join(open_, "session_id").select(F.concat(F.lit("backfill/"), "session_id", F.lit(".jsonl")).alias("path"), "cwd", "session_id", F.col("body").cast("binary").alias("data"))
        rows = rows.withColumns({"of": F.col("path"), "mtime_unix": F.lit(0).cast("long"), "size_bytes": F.octet_length("data").cast("long"), "origin": F.lit("backfill")})
        rows = rows.withColumn("digest", reconcile.chain(F.col("data"), F.col("size_bytes"))).withColumn("blob", F.sha2(F.concat_ws("/", "path", "digest"), 256))
        self._keep(held.unionByName(rows.select(*ARCHIVE_COLUMNS)), rows.select("blob", F.lit(0).cast("long").alias("start"), "data"))
        return made.select("session_id", "n_lines")

    # ------------------------------------------------------------------ search

    def _session_hits(self, query: str, n: int) -> tuple[DataFrame, DataFrame]:
        keys = self.table("messages").select("session_id", "message_uuid")
        phrases = fts.stem_phrases(fts.query_phrases(query))
        words = keyword_index.topk(self.table("postings"), self.table("totals"), phrases, n).withColumnRenamed("id", "message_uuid")
        near = search.cosine_topk(self.table("vectors"), self.model.embed_query(query), n, "message_uuid").select("message_uuid", F.col("cosine_score").alias("score"))
        return (words.join(keys, "message_uuid").withColumn("rank", F.lit(0)), near.join(keys, "message_uuid").withColumn("rank", F.lit(0)))

    def search(self, query: str, k: int | None = None, source: str = "all", include_invalidated: bool = False) -> DataFrame:
        """tier, id, score, snippet of the best memories and the best session messages; the tiers stay apart.

        An index of another model is an error, one of an older layout is brought up to date first.
        """
        import dataclasses

        if source not in SOURCES:
            raise ValueError(f"source is one of {SOURCES}")
        self.guard()
        s = dataclasses.replace(self.s, k=k or self.s.k)
        parts = []
        if source != "sessions":
            hits = search.search_memory(self.table("chunks"), self.model.embed_query(query), s, "/m", include_invalidated=include_invalidated)
            parts.append(hits.select(F.lit("memory").alias("tier"), F.col("file_path").alias("id"), F.col("final_score").alias("score"), rules.snippet(F.col("text")).alias("snippet")))
        if source != "memory" and self.has("messages"):
            merged = search.merge_hits(*self._session_hits(query, s.overfetch), ["session_id", "message_uuid"], s.k)
            text = self.table("messages").select("message_uuid", rules.snippet(F.col("content"), 200).alias("snippet"))
            parts.append(merged.join(text, "message_uuid").select(F.lit("session").alias("tier"), F.col("message_uuid").alias("id"), "score", "snippet"))
        out = parts[0] if parts else self.spark.createDataFrame([], "tier string, id string, score double, snippet string")
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def guard(self) -> bool:
        """Stops where the index was made by another model; makes anew what an older layout holds otherwise. Whether it did."""
        row = self.table("identity").first() if self.has("identity") else None
        if row is None:
            return False
        if (row.model, row.dim) != (type(self.model).__name__, self.model.dim):
            raise ValueError(f"the index was made by {row.model} ({row.dim} wide), not {type(self.model).__name__} ({self.model.dim}): rebuild it")
        if row.schema == SCHEMA:
            return False
        now = self.table("identity").withColumn("schema", F.lit(SCHEMA))
        self.db.commit({"identity": staged(now, "identity")} | (self._postings(self.table("messages")) if self.has("messages") else {}))
        return True

    def suspect_index(self, query: str) -> bool:
        """Whether a search that finds nothing should not be believed: rows are stored, and none was merely filtered."""
        stored = sum(self.table(t).count() for t in ("chunks", "messages") if self.has(t))
        if not stored or not self.search(query).isEmpty():
            return False
        return health.silent_empty(stored, 0, self.search(query, include_invalidated=True).count())

    # ------------------------------------------------------------------ lookups

    def file(self, file_path: str) -> DataFrame:
        return self.table("files").where(F.col("file_path") == file_path)

    def chunks_of(self, file_path: str) -> DataFrame:
        return self.table("chunks").where(F.col("file_path") == file_path).orderBy("chunk_no").drop("embedding")

    def width(self) -> int | None:
        """Width of the stored vectors; None where there is none."""
        row = self.table("chunks").select(F.size("embedding").alias("n")).first() if self.has("chunks") else None
        return row["n"] if row else None

    def fit_width(self) -> bool:
        """Makes tables of vectors that are empty anew; ones of another width than the model's are an error. Whether any was made."""
        empty = {}
        for name in ("chunks", "vectors"):
            if not self.has(name):
                continue
            t = self.table(name)
            if t.isEmpty():
                empty[name] = t
            else:
                health.check_dimension(t, "embedding", self.model.dim)
        if empty:
            self.db.commit(empty)
        return bool(empty)

    def last_indexed(self) -> DataFrame:
        """One row: when the index was made last, and the newest time of its files."""
        newest = self.table("files").agg(F.max("mtime_unix").alias("newest_mtime"))
        return self.table("identity").agg(F.max("indexed_at").alias("indexed_at")).join(F.broadcast(newest))

    # ------------------------------------------------------------------ notes and tasks on disk

    def capture(self, home: str, layer: str, filename: str, name: str, description: str, body: str | None = None, tags: list[str] = (), aliases: list[str] = (), project: str | None = None, valid_from: str | None = None, force: bool = False) -> str:
        """Writes a new note and indexes it; refused where the file exists or a known chunk is a near-duplicate."""
        path = verbs.note_path(home, layer, filename, project)
        if store.exists(self.spark, path):
            raise FileExistsError(path)
        text = body or f"# {name}\n\n{description}\n"
        if not force and self.has("chunks"):
            note = self.spark.createDataFrame([("new", name, text if chunking.chunk(text, 1 << 30) else None)], "note_id string, name string, body string")
            hit = self.near_duplicates(note).first()
            if hit:
                raise ValueError(f"a note like this is known: chunk {hit.hit['nearest']}, similarity {hit.hit['similarity']:.3f}")
        if not store.create(self.spark, path, verbs.note_text(layer, name, description, self.s.now, body, tags, aliases, valid_from).encode()):
            raise FileExistsError(path)
        self.update_index(home, [path.removeprefix(f"{home.rstrip('/')}/")])
        return path

    def confirm(self, home: str, rel: str) -> None:
        verbs.confirm_note(self.spark, f"{home.rstrip('/')}/{rel}", self.s.today)
        self.update_index(home, [rel])

    def suspect(self, home: str, rel: str, reason: str | None = None) -> None:
        verbs.suspect_note(self.spark, f"{home.rstrip('/')}/{rel}", self.s.now, reason)
        self.update_index(home, [rel])

    def invalidate(self, home: str, rel: str, at: str | None = None, reason: str | None = None) -> None:
        verbs.invalidate_note(self.spark, f"{home.rstrip('/')}/{rel}", self.s.now, at, reason)
        self.update_index(home, [rel])

    def migrate(self, root: str, home: str) -> DataFrame:
        """Writes older notes (folders named memory) into the home, one of each body that is not there; path and target.

        Bodies are compared by hash in tables; a note is one small file, written through the file system.
        """
        raw = files.legacy_notes(self.spark, root)
        notes = files.notes(raw).where("ok").join(raw.select("path", "dir"), "path")
        known = files.notes(files.memory_files(self.spark, home)).select(reconcile.body_hash(F.col("body")).alias("body_hash")) if self.has("files") else self.spark.createDataFrame([], "body_hash string")
        layer = files.legacy_layer(F.col("type"))
        slug = rules.slug(F.regexp_replace("dir", "/memory$", ""))
        new = reconcile.new_bodies(notes, known).withColumns({"layer": layer, "target": files.legacy_target(F.element_at(F.split("path", "/"), -1), slug, layer)})
        rows = []
        for r in new.orderBy("path").toLocalIterator():
            path = verbs.note_path(home, r["layer"], r["target"])
            if store.create(self.spark, path, verbs.note_text(r["layer"], r["name"], r["description"], self.s.now, "\n" + r["body"] + "\n", r["tags"], r["aliases"]).encode()):
                rows.append((r["path"], path))
        self.update_index(home)
        return self.spark.createDataFrame(rows, "path string, target string")

    def tasks(self, home: str) -> DataFrame:
        return state.task_list(files.tasks(self.spark, f"{home.rstrip('/')}/tasks"))

    # ------------------------------------------------------------------ bootstrap

    def bootstrap(self, folder: str, scope: dict | None = None, top_n: int = 30, probes: tuple[str, ...] = rules.PROBES) -> dict | None:
        """Plans batches of candidates by project and writes a review file for each; goes on with a plan that was begun.

        scope: slugs and days. A plan of another scope is refused. The plan is saved before the first file and after
        each, so that a crash leaves what is done; a batch is done when finish_batch() says so.
        """
        folder, scope = folder.rstrip("/"), {"slugs": sorted((scope or {}).get("slugs", [])), "days": (scope or {}).get("days", self.s.scope_days)}
        at = f"{folder}/plan.json"
        plan = verbs.load_plan(self.spark, at)
        if plan is not None and plan["scope"] != scope:
            raise ValueError(f"the plan {at} has another scope: {plan['scope']}")
        fresh = self.recall_candidates(probes).where("not captured").withColumn("ts", F.timestamp_seconds("timestamp_unix").cast("timestamp_ntz"))
        import dataclasses

        found = staged(recall.apply_scope(fresh, scope["slugs"], self.s.now, dataclasses.replace(self.s, scope_days=scope["days"])), "candidates")
        if plan is None:
            batches = [r.slug for r in recall.batches(found).orderBy("slug").collect()]  # projects among a bounded number of candidates
            if not batches:
                return None
            plan = {"version": verbs.PLAN_VERSION, "scope": scope, "batches": batches, "completed": [], "written": 0, "model": type(self.model).__name__, "created": self.s.now.isoformat()}
            verbs.save_plan(self.spark, at, plan)
        for b in verbs.open_batches(plan):
            path = f"{folder}/review-{b}.md"
            if store.exists(self.spark, path):
                continue
            mine = found.where(F.col("slug") == b)
            ranked = recall.top_n(mine.withColumn("command", rules.capture_command(F.col("content"))), top_n, F.desc("score"), "message_uuid")
            shown = recall.by_layer(ranked.withColumn("content", rules.one_line(F.col("content"))), F.desc("score"), "message_uuid")
            store.create(self.spark, path, sinks.render_review(shown.select("layer", "layer_order", "rank", "content", "command", "status")).encode())
            plan["written"] += mine.count()
            verbs.save_plan(self.spark, at, plan)
        return plan

    # ------------------------------------------------------------------ curation

    def near_duplicates(self, notes: DataFrame, least: float | None = None) -> DataFrame:
        """First conflicting chunk of each new note (note_id, body) with what is known."""
        cut = chunking.chunks(notes, "note_id", "body", self.s.chunk_bytes).withColumn("key", F.xxhash64("note_id", "chunk_no"))
        if "name" in notes.columns:  # as the index embeds them
            cut = cut.join(notes.select("note_id", "name"), "note_id").withColumn("text", chunking.embedding_text(F.col("name"), F.col("text")))
        vec = self.model.embed(cut, "key", F.col("text"))
        return recall.first_conflict(cut.join(vec, "key").select("note_id", "chunk_no", "embedding"), self.table("chunks").select(F.col("chunk_id").alias("corpus_id"), "embedding"), least or self.s.capture_similarity)

    def recall_candidates(self, probes: tuple[str, ...] = rules.PROBES) -> DataFrame:
        """Messages that standing phrases find in either tier, best score first, near-known ones marked captured."""
        asked = {i: fts.stem_phrases(fts.query_phrases(p)) for i, p in enumerate(probes)}
        told = self.table("totals").agg(F.sum("docs").alias("n"), F.sum("tokens").alias("t")).first()
        found = keyword_index.hits(self.table("postings"), {t for x in asked.values() for p in x for t in p})  # one scan for all probes
        words = keyword_index.probe_scores(found, asked, told.n or 0, (told.t or 0) / max(told.n or 0, 1) or 1.0).select("probe", F.col("id").alias("message_uuid"), "score")
        first = Window.partitionBy("probe").orderBy(F.desc("score"), "message_uuid")
        words = words.withColumn("n", F.row_number().over(first)).where(F.col("n") <= self.s.per_probe).select("message_uuid", "score", F.col("probe").alias("query_idx"), F.lit(0).alias("tier_rank"), F.lit(0).alias("rank"))
        queries = self.spark.createDataFrame([(i, self.model.embed_query(p)) for i, p in enumerate(probes)], "probe int, query array<double>")
        near = search.probes_topk(self.table("vectors"), queries, self.s.per_probe, "message_uuid")
        hits = near.select("message_uuid", F.col("cosine_score").alias("score"), F.col("probe").alias("query_idx"), F.lit(1).alias("tier_rank"), F.lit(0).alias("rank")).unionByName(words)
        m = self.table("messages")
        paths = m.select("message_uuid", "session_id", "jsonl_path")
        best = recall.keep_best(hits.join(paths, "message_uuid"), ["session_id", "message_uuid"], self.s.recall_most, "jsonl_path", self.exclude)
        full = best.join(m.select("message_uuid", "content", "role", "cwd", "timestamp_unix"), "message_uuid")
        marked = recall.split_captured(self.table("vectors").join(best.select("message_uuid"), "message_uuid", "left_semi"), self.table("chunks").select("chunk_id", "embedding"), "message_uuid", "chunk_id", self.s.recall_similarity)
        return full.join(marked, "message_uuid").withColumn("layer", rules.layer_guess(F.col("content"))).withColumn("slug", rules.slug(F.col("cwd")))

    def overdue(self) -> DataFrame:
        return review.overdue(self.table("chunks").select("file_path", "last_confirmed", "updated", "created").distinct(), self.s)

    # ------------------------------------------------------------------ health

    def coverage(self, home: str) -> DataFrame:
        """file_path and reason of the notes on disk that search cannot see."""
        walked = self._disk(home).select(F.col("file_path").alias("path"), "ok", F.lit(True).alias("walked"))
        every = files.all_markdown(self.spark, home).where("rel not like 'tasks/%' and rel <> 'MEMORY.md'").select(F.concat(F.lit("/m/"), "rel").alias("path"))
        disk = every.join(walked, "path", "left").fillna({"ok": False, "walked": False})
        return health.coverage(disk, self.table("chunks").select(F.col("file_path").alias("path")).distinct())

    def doctor(self, home: str, scope_file: str | None = None, archive_path: str | None = None) -> DataFrame:
        """label, detail, status and remedy of every check."""
        health.check_dimension(self.table("chunks"), "embedding", self.model.dim)
        other = self.table("identity").where((F.col("model") != type(self.model).__name__) | (F.col("dim") != self.model.dim) | (F.col("schema") != SCHEMA))
        checks = {
            "notes that search cannot see": (self.coverage(home), "update the index"),
            "indexed notes without chunks": (health.files_without_chunks(self.table("files").where("ok").select("file_path"), self.table("chunks")), "rebuild the index"),
            "index made by another model or schema": (other, "rebuild the index"),
            "chunks that do not find themselves": (self.lost_chunks(), "rebuild the index"),
        }
        if self.has("messages"):
            m, v = self.table("messages"), self.table("vectors")
            checks["messages without a vector"] = (ingest.unembedded(m.select("message_uuid"), v, "message_uuid"), "embed what is missing")
            checks["vectors without a message"] = (v.select("message_uuid").join(m.select("message_uuid"), "message_uuid", "left_anti"), "rebuild the vectors")
            stray, missing = fts.consistency(m, self.table("postings").select(F.explode("entries.id").alias("message_uuid")), "message_uuid", F.col("content"))
            checks["postings without a message"] = (stray, "rebuild the keyword index")
            checks["messages that are not in the keyword index"] = (missing, "rebuild the keyword index")
        if archive_path:
            live = files.files(self.spark, archive_path, "*.jsonl").select("path")
            held = self._archived()[0].select(F.col("of").alias("path"))
            checks["transcripts that are not archived"] = (live.join(held, "path", "left_anti"), "archive them")
            checks["the archive cannot be written to"] = (self.spark.range(0 if store.writable(self.spark, self.store) else 1), "mend the folder's permissions, or move the store")
            label = verbs.cloud_of(self.store)
            checks["the archive lies in a folder that is copied elsewhere" + (f": {label}" if label else "")] = (self.spark.range(1 if label else 0), "move the store")
        if scope_file:
            checks["included files that are not imported"] = (self.unimported(scope_file), "import the included folders")
        return health.findings(checks)

    def archive_facts(self) -> DataFrame:
        """One row: sessions and files in the archive, the newest file's time and the bytes."""
        return self.table("archive").agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("files"), F.max("mtime_unix").alias("newest"), F.sum("size_bytes").alias("bytes"))

    def lost_chunks(self, every: int = 64, top: int = 3) -> DataFrame:
        """Of one in so many stored chunks, those that a search for their own text, embedded anew, does not bring up among the first."""
        rows = self.table("chunks")
        asked = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(every)) == 0).orderBy("chunk_id").limit(32)
        again = self.model.embed(asked.select("chunk_id", chunking.embedding_text(F.col("name"), F.col("text")).alias("t")), "chunk_id", F.col("t"))
        hits = search.probes_topk(rows.select("chunk_id", "embedding"), again.select(F.col("chunk_id").alias("probe"), F.col("embedding").alias("query")), top, "chunk_id")
        # a chunk of the same text may stand before it; one that only comes up as nothing is nearer does not find itself
        return hits.groupBy("probe").agg(F.max("cosine_score").alias("best")).where("best < 0.999").select("probe")

    def unimported(self, scope_file: str) -> DataFrame:
        """Files of the included folders that no message was made of."""
        out = self.spark.createDataFrame([], "message_uuid string, rel_to_source string")
        for root, found in self._included(scope_file):
            rows = ingest.document_messages(found, prefix_of(root)).select("message_uuid").join(self.table("messages").select("message_uuid"), "message_uuid", "left_anti")
            out = out.unionByName(rows.withColumn("rel_to_source", F.lit(root)))
        return out

    def probe(self, related: tuple[str, str], unrelated: str) -> bool:
        """Whether the embedder tells a related pair from an unrelated one by the margin."""
        a, b, c = (self.model.embed_query(t) for t in (*related, unrelated))
        score = lambda x, y: sum(i * j for i, j in zip(x, y, strict=True))
        return health.margin(score(a, b), score(a, c))

    # ------------------------------------------------------------------ import

    def _import(self, found: DataFrame, prefix: str) -> DataFrame:
        rows = ingest.document_messages(found, prefix).drop("type").withColumns({"timestamp_unix": F.try_to_timestamp("timestamp_iso").cast("long"), "jsonl_path": F.concat(F.lit(f"import:{prefix}/"), "session_id"), "line_number": F.lit(1)})
        return self._add_messages(rows)

    def import_documents(self, root: str, prefix: str, deny: tuple[str, ...] = ()) -> DataFrame:
        """Messages of a tree of text files, one session a folder; first writer wins as for transcripts."""
        self._import(files.sessions(files.text_files(self.spark, root, s=self.s, deny=deny), root), prefix)
        return self.table("messages").where(F.col("jsonl_path").startswith(f"import:{prefix}/"))

    def _included(self, scope_file: str):
        dirs, deny = verbs.scope(self.spark, scope_file)
        for root in dirs:
            if store.exists(self.spark, root):
                yield root, files.sessions(files.text_files(self.spark, root, s=self.s, deny=tuple(deny)), root)

    def import_included(self, scope_file: str) -> DataFrame:
        """Imports every included folder whose files have changed since the last time; root and what was done."""
        done = []
        for root in verbs.scope(self.spark, scope_file)[0]:
            if not store.exists(self.spark, root):
                done.append((root, "missing"))
        for root, found in self._included(scope_file):
            listing = found.select(F.lit(root).alias("root"), F.col("rel_to_source").alias("path"), "mtime_unix", F.octet_length("text").alias("size_bytes"))
            row = review.manifest_hash(listing, "root").first()
            mark = f"{self.store}/included-{prefix_of(root)}"
            now = row["manifest"] if row else ""
            if store.exists(self.spark, mark) and store.read_small(self.spark, mark) == now:
                done.append((root, "unchanged"))
                continue
            self._import(found, prefix_of(root))
            if not store.create(self.spark, mark, now.encode()):  # after the import: a crash before it repeats the import
                store.replace(self.spark, mark, now.encode())
            done.append((root, "imported"))
        return self.spark.createDataFrame(done, "root string, done string")

    def count_transcripts(self, root: str, most: int = 10_000) -> int:
        """Transcripts below a folder, counted up to a limit; a listing alone, no file is read."""
        return files.files(self.spark, root, "*.jsonl").select("path").limit(most).count() if store.exists(self.spark, root) else 0

    def discover_dirs(self, root: str) -> DataFrame:
        """Folders with text below root, those with most notes first."""
        found = files.text_files(self.spark, root, s=self.s)
        return files.rank_dirs(found.select(F.regexp_replace("rel", "/?[^/]*$", "").alias("dir"), F.lower(F.element_at(F.split("rel", r"\."), -1)).alias("ext")))
