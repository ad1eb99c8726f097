"""File sources: notes with frontmatter, text trees, sessions and folders of knowledge."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.config import DEFAULTS, HARNESS_LAYERS, INDEXED_DIRS, LAYERS, LEGACY_LAYERS, TEXT_EXTENSIONS, Settings
from quern.functions.globs import excluded
from quern.schemas import MEMORY_FILE
from quern.store import exists, staged

#: Folders that never hold knowledge, matched as whole segments below the root.
JUNK_DIRS = ("node_modules", ".git", ".hg", ".svn", "__pycache__", ".venv", "venv", "env", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", "target", ".next", ".nuxt", ".cache", ".gradle", ".idea", ".vscode", "vendor", "site-packages", ".terraform", "coverage")


def files(spark: SparkSession, root: str, glob: str = "*", only: list[str] | None = None) -> DataFrame:
    """path, rel, mtime_unix, size_bytes and content of every file below root, or of the files named by their rel."""
    base = root.rstrip("/")
    paths = base if only is None else [as_path(f"{base}/{rel}") for rel in only if exists(spark, f"{base}/{rel}")]
    if not paths:
        return spark.createDataFrame([], "path string, rel string, mtime_unix long, size_bytes long, content binary")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)
    name = base.split("://", 1)[-1].removeprefix("file:")
    return df.select("path", F.element_at(F.split("path", f"{name}/", 2), 2).alias("rel"), F.unix_timestamp("modificationTime").alias("mtime_unix"), F.col("length").alias("size_bytes"), "content")


def all_markdown(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """Every note on disk but those below a hidden segment."""
    return files(spark, root, "*.md", only).where(~F.col("rel").rlike(r"(^|/)\."))


def memory_files(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """Notes that are indexed: layer folders, loose project files and layer folders of projects, in path order."""
    part = F.split("rel", "/")
    dirs = list(INDEXED_DIRS)
    keep = part[0].isin(*dirs) & (F.size(part) > 1) | (part[0] == "projects") & ((F.size(part) == 2) | (F.size(part) > 3) & part[2].isin(*dirs))
    return all_markdown(spark, root, only).where(keep).orderBy("rel")


def parse_note(path: str, raw: bytes) -> dict:
    """A note's fields, or ok False and a reason. Frontmatter is YAML between two lines of dashes."""
    import yaml

    out: dict = {f.name: None for f in MEMORY_FILE.fields} | {"path": path, "ok": False}
    text = raw.decode("utf-8", "replace").lstrip("﻿")
    parts = text.replace("\r\n", "\n").split("\n---", 2) if text.startswith("---\n") or text.startswith("---\r\n") else []
    if len(parts) < 2:
        return out | {"reason": "missing frontmatter"}
    try:
        meta = yaml.safe_load(parts[0][3:])
    except yaml.YAMLError:
        return out | {"reason": "frontmatter is no YAML"}
    if not isinstance(meta, dict) or not meta:
        return out | {"reason": "missing frontmatter"}
    nested = meta.get("metadata")
    if meta.get("type") in (None, "") and isinstance(nested, dict):
        meta["type"] = nested.get("type")
    if isinstance(meta.get("type"), str):
        meta["type"] = HARNESS_LAYERS.get(meta["type"], meta["type"])
    for name in ("name", "description", "type"):
        if meta.get(name) in (None, ""):
            return out | {"reason": f"missing {name}"}
    if meta["type"] not in LAYERS:
        return out | {"reason": "invalid type"}
    for name in ("tags", "aliases", "see_also"):
        v = meta.get(name)
        if v is not None and not isinstance(v, list):
            return out | {"reason": f"{name} is no list"}
        out[name] = [str(x) for x in v or []]
    for name in ("created", "updated", "valid_from", "last_confirmed"):
        out[name] = when(meta.get(name), True)
    for name in ("invalidated_at", "suspected_at"):
        out[name] = when(meta.get(name), False)
    reason = str(meta.get("suspect_reason") or "").strip() or None
    return out | {"ok": True, "reason": None, "name": str(meta["name"]), "description": str(meta["description"]), "type": str(meta["type"]), "scope": str(meta.get("scope", "private")), "suspect_reason": reason, "body": "\n---".join(parts[1:]).lstrip("-").strip("\n")}


def when(value, date_only: bool) -> str | None:
    if value in (None, ""):
        return None
    if isinstance(value, dt.datetime):
        return value.date().isoformat() if date_only else value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    text = str(value).strip()
    return text[:10] if date_only else text.replace(" ", "T", 1)


def notes(raw: DataFrame) -> DataFrame:
    """MEMORY_FILE rows of files(); YAML needs Python, so it runs in Arrow batches."""
    names = [f.name for f in MEMORY_FILE.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, kinds = ("tags", "aliases", "see_also"), pa.string()
        for batch in batches:
            rows = [parse_note(p, c) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.list_(pa.string()) if n in lists else pa.bool_() if n == "ok" else kinds) for n in names], names=names)

    return raw.select("path", "content").mapInArrow(run, MEMORY_FILE)


def text_files(spark: SparkSession, root: str, exts: tuple[str, ...] = TEXT_EXTENSIONS, s: Settings = DEFAULTS, deny: tuple[str, ...] = ()) -> DataFrame:
    """Text files of a tree: known extensions, up to the size limit, not blank, outside of junk folders and denied globs."""
    part = F.split("rel", "/")
    junk = F.arrays_overlap(F.slice(part, F.lit(1), F.size(part) - 1), F.array(*[F.lit(x) for x in JUNK_DIRS]))
    named = files(spark, root).where(F.lower(F.element_at(F.split("rel", r"\."), -1)).isin(*exts) & (F.col("size_bytes") <= s.import_bytes) & ~junk & ~excluded(F.col("rel"), list(deny)))
    text = named.withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))
    return text.where(F.col("text").rlike(r"(?U)\S")).select("path", "rel", "mtime_unix", "size_bytes", "text")


def scope_counts(spark: SparkSession, root: str, exts: tuple[str, ...] = TEXT_EXTENSIONS, s: Settings = DEFAULTS, deny: tuple[str, ...] = ()) -> DataFrame:
    """One row: inspected (files below root) and in_scope (those that text_files() takes)."""
    inspected = files(spark, root).agg(F.count("*").alias("inspected"))
    return inspected.join(F.broadcast(text_files(spark, root, exts, s, deny).agg(F.count("*").alias("in_scope"))))


def sessions(df: DataFrame, folder: str) -> DataFrame:
    """Import sessions: a file's first folder, or `_root` for loose files; columns of document_messages()."""
    part = F.split("rel", "/")
    session = F.when(F.size(part) > 1, part[0]).otherwise("_root")
    inner = F.when(F.size(part) > 1, F.array_join(F.slice(part, F.lit(2), F.size(part)), "/")).otherwise(F.col("rel"))
    return df.select(F.col("rel").alias("rel_to_source"), inner.alias("rel_to_session"), session.alias("session"), F.concat(F.lit(folder.rstrip("/") + "/"), session).alias("folder"), "mtime_unix", "text")


def rank_dirs(df: DataFrame) -> DataFrame:
    """dir, md and texts of folders by their notes, then texts, then name."""
    return df.groupBy("dir").agg(F.count_if(F.col("ext") == "md").alias("md"), F.count("*").alias("texts")).orderBy(F.desc("md"), F.desc("texts"), "dir")


def extensions(base: Column, include: list[str], exclude: list[str]) -> Column:
    """(base with include) without exclude: what is excluded wins."""
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return F.array_except(F.array_union(base, arr(include)), arr(exclude))


def legacy_notes(spark: SparkSession, root: str, migrated: DataFrame | None = None) -> DataFrame:
    """Older notes directly in folders named memory, without their index file and without migrated folders."""
    found = files(spark, root, "*.md").where(F.col("rel").rlike(r"(^|/)memory/[^/]+\.md$") & ~F.col("rel").rlike(r"(^|/)MEMORY\.md$"))
    found = found.withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    return found if migrated is None else found.join(migrated.select("dir"), "dir", "left_anti")


def legacy_layer(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for old, new in LEGACY_LAYERS.items():
        out = F.when(kind == old, F.lit(new)).otherwise(out)
    return F.coalesce(out, F.lit("knowledge"))


def legacy_target(name: Column, slug: Column, layer: Column) -> Column:
    """File name of a migrated note: its old prefix gone, the project before it, `when-` before all for that layer."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.md$", ""), "^(?:feedback|project|reference)_", "")
    return F.concat(F.when(layer == "when", "when-").otherwise(""), slug, F.lit("-"), stem, F.lit(".md"))


def tags_of_refs(lines: DataFrame) -> DataFrame:
    """tag names of a remote's reference listing (raw), without peeled ones."""
    return lines.select(F.regexp_extract("raw", r"refs/tags/(\S+)$", 1).alias("tag")).where("tag <> '' and not endswith(tag, '^{}')")


def journal(spark: SparkSession, path: str) -> DataFrame:
    """ts and payload of a journal's lines; torn lines are dropped."""
    raw = spark.read.text(path).select(F.col("value").alias("raw"))
    return raw.where(F.try_parse_json("raw").isNotNull() & F.trim("raw").startswith("{")).select(F.get_json_object("raw", "$.ts").alias("ts"), F.get_json_object("raw", "$.payload").alias("payload"))


def as_path(name: str) -> str:
    """A file's name as a path that a reader takes as it is, not as a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", name)


def transcripts(spark: SparkSession, *roots: str) -> DataFrame:
    """jsonl_path, line_number (from 1, blank lines counted) and raw of every transcript line; roots: folders or files.

    Lines are read by splits of files, so that no file is held as one value. A line's number is its place in its split
    and the lines of the file's splits before it: counts by split are added up by file, and nothing is sorted by line.
    """
    if not roots:
        return spark.createDataFrame([], "jsonl_path string, line_number int, raw string")
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("lineSep", "\n").text(list(roots))
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")  # as listings name it
    placed = read.select(path.alias("jsonl_path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__row"), F.regexp_replace(F.make_valid_utf8("value"), "\r$", "").alias("raw"))
    placed = staged(placed, "lines")
    of_split = placed.groupBy("jsonl_path", "__start").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    before = Window.partitionBy("jsonl_path").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    told = of_split.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return placed.join(told, ["jsonl_path", "__start"]).select("jsonl_path", (F.col("__row") - F.col("__first") + F.col("__before") + 1).cast("int").alias("line_number"), "raw")


def contents(spark: SparkSession, *paths: str) -> DataFrame:
    """path, mtime_unix, size_bytes and data of files; those that cannot be read are left out."""
    if not paths:
        return spark.createDataFrame([], "path string, mtime_unix long, size_bytes long, data binary")
    read = spark.read.format("binaryFile").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load([as_path(p) for p in paths])
    return read.select("path", F.unix_timestamp("modificationTime").alias("mtime_unix"), F.col("length").alias("size_bytes"), F.col("content").alias("data"))


def head_fields(data: Column) -> tuple[Column, Column]:
    """cwd and session of a transcript's bytes: the first cwd that is filled and the greatest sessionId of fifty lines."""
    lines = F.slice(F.split(F.make_valid_utf8(data.cast("string")), "\n", 51), 1, 50)
    cwd = F.transform(lines, lambda x: F.nullif(F.get_json_object(x, "$.cwd"), F.lit("")))
    return F.get(F.filter(cwd, lambda x: x.isNotNull()), F.lit(0)), F.array_max(F.transform(lines, lambda x: F.get_json_object(x, "$.sessionId")))


def tasks(spark: SparkSession, root: str) -> DataFrame:
    """Task files, malformed ones dropped, by creation and id."""
    from quern.schemas import TASK

    names = [f.name for f in TASK.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = raw.decode("utf-8", "replace").split("\n---", 2)
                try:
                    meta = yaml.safe_load(parts[0].removeprefix("---")) if len(parts) > 1 else None
                except yaml.YAMLError:
                    meta = None
                if not isinstance(meta, dict) or not meta.get("title") or meta.get("status") not in ("open", "in_progress", "blocked", "done"):
                    continue
                rows.append({n: str(meta.get(n) or "") for n in names} | {"id": str(meta.get("id") or path.rsplit("/", 1)[-1].removesuffix(".md")), "links": [str(x) for x in meta.get("links") or []], "body": parts[1].lstrip("-").strip("\n")})
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.list_(pa.string()) if n == "links" else pa.string()) for n in names], names=names)

    return files(spark, root, "*.md").select("path", "content").mapInArrow(run, TASK).orderBy("created", "id")
