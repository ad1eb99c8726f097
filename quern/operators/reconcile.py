"""Change capture: index against disk, archive against live files, backfill, forgetting, versioned writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import store
from quern.functions.globs import excluded


def index_diff(disk: DataFrame, index: DataFrame) -> DataFrame:
    """path and action of every file of either side (path, hash; disk also ok): add, change, keep, drop, invalid."""
    a, b = disk.select("path", F.col("hash").alias("new"), F.col("ok")), index.select("path", F.col("hash").alias("old"))
    both = a.join(b, "path", "full_outer")
    action = F.when(F.col("new").isNull(), "drop").when(~F.col("ok") & F.col("old").isNotNull(), "drop_invalid").when(~F.col("ok"), "invalid").when(F.col("old").isNull(), "add").when(F.col("old") != F.col("new"), "change").otherwise("keep")
    return both.select("path", action.alias("action"))


#: Bytes of a block of digests.
BLOCK = 1 << 16


def chain(data: Column, upto: Column) -> Column:
    """Digest of the first `upto` bytes: every block of 64 kB is hashed together with the digest of those before it."""
    piece = lambda i: F.substring(data, (i * BLOCK + 1).cast("int"), F.least(F.lit(BLOCK), upto - i * BLOCK).cast("int"))
    blocks = F.when(upto > 0, F.sequence(F.lit(0).cast("long"), F.ceil(upto / BLOCK) - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(blocks, F.lit(""), lambda told, i: F.sha2(F.concat(told.cast("binary"), piece(i)), 256))


def digested(archive: DataFrame) -> DataFrame:
    """kept (number of bytes) and digest instead of data."""
    kept = F.octet_length("data").cast("long")
    return archive.withColumns({"kept": kept, "digest": chain(F.col("data"), kept)}).drop("data")


def archive_reconcile(live: DataFrame, archive: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, action and, for diverged files, the sidecar's name.

    live: path, mtime_unix, size_bytes, data; archive: path and either data or kept and digest; manifest: path,
    mtime_unix, size_bytes, origin. In order: no archive file copies; an unchanged manifest entry skips; an archive that
    is a prefix of the live bytes is replaced by them; one made by backfill is replaced; else both stay, the live bytes
    in a sidecar named by content. Whether it is a prefix is told by the digest of as many live bytes as are archived.
    """
    arch = (archive if "digest" in archive.columns else digested(archive)).select("path", "kept", "digest")
    known = manifest.select("path", F.col("mtime_unix").alias("m"), F.col("size_bytes").alias("s"), "origin")
    joined = live.join(arch, "path", "left").join(known, "path", "left")
    prefix = (F.octet_length("data") >= F.col("kept")) & (chain(F.col("data"), F.col("kept")) == F.col("digest"))
    action = F.when(F.col("digest").isNull(), "copied").when((F.col("m") == F.col("mtime_unix")) & (F.col("s") == F.col("size_bytes")), "skipped_unchanged").when(prefix, "replaced_append").when(F.col("origin") == "backfill", "replaced_backfill").otherwise("diverged_sidecar")
    side = F.concat("path", F.lit("."), F.substring(F.sha2("data", 256), 1, 8))
    return joined.withColumn("action", action).select("path", "action", F.when(F.col("action") == "diverged_sidecar", side).alias("sidecar"))


def restored(manifest: DataFrame, pieces: DataFrame) -> DataFrame:
    """path and data of archived files, put together from their pieces (blob, start, data)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", F.hex("data").alias("hex")))), lambda x: x["hex"])
    whole = manifest.select("path", "blob").join(pieces, "blob", "left")
    return whole.groupBy("path").agg(F.unhex(F.array_join(parts, "")).alias("data"))


def now_excluded(held: DataFrame, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Archived rows that stay, and those whose folder (cwd) the patterns exclude now; without a folder a row stays."""
    shut = F.coalesce(excluded(F.col("cwd"), patterns), F.lit(False))
    return held.where(~shut), held.where(shut)


def backfill(messages: DataFrame, archive_sessions: DataFrame) -> DataFrame:
    """Sessions of the index that the archive lacks, put together again: lines in order."""
    missing = messages.join(archive_sessions.select("session_id").distinct(), "session_id", "left_anti")
    return reassemble(missing)


def reassemble(messages: DataFrame) -> DataFrame:
    """One row a session: its lines by line number. A session is one conversation, so its size is bounded."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_number", "message_uuid", "content"))), lambda x: x["content"])
    return messages.groupBy("session_id").agg(F.count("*").alias("n_lines"), F.array_join(lines, "\n").alias("body"))


def forget(tables: dict[str, DataFrame], sessions: DataFrame) -> dict[str, DataFrame]:
    """Every table without the sessions' rows."""
    return {n: t.join(sessions, "session_id", "left_anti") for n, t in tables.items()}


def new_bodies(legacy: DataFrame, present: DataFrame) -> DataFrame:
    """Legacy notes (path, body) whose body is in neither the store (body_hash) nor an earlier path of the batch."""
    hashed = legacy.withColumn("body_hash", body_hash(F.col("body")))
    first = Window.partitionBy("body_hash").orderBy("path")
    return hashed.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").join(present.select("body_hash"), "body_hash", "left_anti")


def body_hash(body):
    """Hash of a body without white space around it and at the ends of its lines."""
    strip = F.regexp_replace(body, r"^\s+|\s+$", "")
    return F.sha2(F.array_join(F.transform(F.split(strip, "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), "\n"), 256)


def replace_rows(old: DataFrame, new: DataFrame, key: str, changed: DataFrame) -> DataFrame:
    """The table after a keyed replace: rows of changed keys go, new rows come."""
    return old.join(changed.select(key), key, "left_anti").unionByName(new)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Writes a version beside the others and then its pointer, a new file: readers take the largest that has one.

    A failure before the pointer leaves the old version as it was; no moment is without one.
    """
    root = root.rstrip("/")
    path = f"{root}/v={version}"
    df.write.mode("overwrite").parquet(path)
    if not store.create(df.sparkSession, f"{root}/current-{version}", str(version).encode()):
        raise OSError(f"version {version} of {root} has been turned to already")
    return path


def read_current(spark, root: str) -> DataFrame:
    turned = [int(n[8:]) for n in store.listed(spark, root.rstrip("/")) if n.startswith("current-") and n[8:].isdigit()]
    if not turned:
        raise FileNotFoundError(f"no version of {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/v={max(turned)}")
