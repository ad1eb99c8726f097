"""Transcript ingest: JSONL lines to typed messages with a disposition for every line."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.dates import iso_unix

#: Messages are stored with Bloom filters over their sessions, so that a reader of some sessions skips the other parts.
LAYOUT = {"parquet.bloom.filter.enabled#session_id": "true", "parquet.bloom.filter.expected.ndv#session_id": "10000"}
#: Sessions of a batch up to which the stored messages are looked up by them; beyond, all keys are compared.
MOST_SESSIONS = 200
PUSHED = "spark.sql.parquet.pushdown.inFilterThreshold"


def flatten(content: Column) -> Column:
    """Message content as text: a string stripped; of a list its blocks' `text` fields, stripped, joined by a blank.

    content is raw JSON. Null where nothing is left.
    """
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    blocks = F.from_json(content, "array<string>")
    texts = F.transform(F.filter(F.transform(blocks, lambda b: F.get_json_object(b, "$.text")), lambda t: t.isNotNull()), strip)
    joined = F.array_join(F.filter(texts, lambda t: t != ""), " ")
    plain = F.get(F.from_json(F.concat(F.lit("["), content, F.lit("]")), "array<string>"), F.lit(0))
    return F.nullif(F.when(content.startswith("["), joined).when(content.startswith('"'), strip(plain)), F.lit(""))


def messages(lines: DataFrame) -> DataFrame:
    """Every line (jsonl_path, line_number, raw) with the fields of a message and a disposition.

    skipped: another type; malformed: no JSON object, or a required field is missing; no_text: nothing to index;
    bad_timestamp: text without a time; message: the rest. No-text is found before a bad time.
    """
    get = lambda p: F.get_json_object("raw", p)
    content = get("$.message.content")
    # get_json_object unquotes strings, so lists are told from strings by their brackets
    is_list = content.startswith("[") & F.from_json(content, "array<string>").isNotNull()
    text = F.when(is_list, flatten(content)).otherwise(F.nullif(F.regexp_replace(content, r"(?U)^\s+|\s+$", ""), F.lit("")))
    kind, time = get("$.type"), get("$.timestamp")
    rows = lines.where(F.trim("raw") != "").select(
        get("$.sessionId").alias("session_id"), get("$.uuid").alias("message_uuid"), get("$.parentUuid").alias("parent_uuid"), F.coalesce(get("$.message.role"), kind).alias("role"), text.alias("content"), get("$.cwd").alias("cwd"),
        time.alias("timestamp_iso"), iso_unix(time).alias("timestamp_unix"), "jsonl_path", "line_number", kind.alias("kind"), F.try_parse_json("raw").isNotNull().alias("json"), F.trim("raw").startswith("{").alias("object"),
    )
    filled = lambda c: F.nullif(F.col(c), F.lit("")).isNotNull()
    disposition = F.when(~F.col("json") | ~F.col("object"), "malformed").when(~F.coalesce(F.col("kind").isin("user", "assistant"), F.lit(False)), "skipped").when(~filled("session_id") | ~filled("message_uuid") | ~filled("timestamp_iso"), "malformed").when(F.col("content").isNull(), "no_text").when(F.col("timestamp_unix").isNull(), "malformed").otherwise("message")
    return rows.withColumn("disposition", disposition).drop("json", "object")


def counters(dispositions: DataFrame) -> DataFrame:
    return dispositions.groupBy("disposition").agg(F.count("*").alias("n"))


def first_writer(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The first row of each (session_id, message_uuid) by path and line; none that the store has already."""
    first = Window.partitionBy("session_id", "message_uuid").orderBy("jsonl_path", "line_number")
    new = rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return new if existing is None else new.join(existing.select("session_id", "message_uuid"), ["session_id", "message_uuid"], "left_anti")


@contextlib.contextmanager
def by_blooms(spark: SparkSession) -> Iterator[None]:
    """Lists of sessions reach the Parquet reader as values, which its Bloom filters can answer, not as a range."""
    before = spark.conf.get(PUSHED)
    spark.conf.set(PUSHED, str(MOST_SESSIONS))
    try:
        yield
    finally:
        spark.conf.set(PUSHED, before)


def of_sessions(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The stored messages of the batch's sessions, by a filter that the reader takes; all of them where these are many."""
    mine = [r[0] for r in batch.select("session_id").distinct().limit(MOST_SESSIONS + 1).collect()]
    return stored if len(mine) > MOST_SESSIONS else stored.where(F.col("session_id").isin(mine))


def changed_files(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose time or size is not the ledger's: transcripts grow in place, so a path alone says nothing."""
    old = ledger.select("path", F.col("mtime_unix").alias("m"), F.col("size_bytes").alias("s"))
    return listing.join(old, "path", "left").where("m is null or m <> mtime_unix or s <> size_bytes").drop("m", "s")


def unembedded(rows: DataFrame, vectors: DataFrame, id_col: str) -> DataFrame:
    return rows.join(vectors.select(id_col), id_col, "left_anti")


def transcript_cwd(lines: DataFrame) -> DataFrame:
    """cwd of each transcript: its first non-empty one among the first fifty lines."""
    seen = lines.where("line_number <= 50").select("jsonl_path", "line_number", F.nullif(F.get_json_object("raw", "$.cwd"), F.lit("")).alias("cwd"))
    return seen.groupBy("jsonl_path").agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_number"))).alias("cwd"))


def to_jsonl(rows: DataFrame) -> DataFrame:
    """Rows of messages as the lines of a transcript."""
    return rows.select("session_id", "line_number", F.to_json(F.struct(F.col("role").alias("type"), F.col("message_uuid").alias("uuid"), F.col("parent_uuid").alias("parentUuid"), F.col("session_id").alias("sessionId"), F.col("timestamp_iso").alias("timestamp"), "cwd", F.struct("role", "content").alias("message"))).alias("raw"))


def document_messages(files: DataFrame, prefix: str) -> DataFrame:
    """Messages of imported text files (rel_to_source, rel_to_session, session, folder, mtime_unix, text)."""
    key = lambda rel: F.sha1(F.concat(F.lit(prefix), F.lit("\0"), rel))
    return files.where("text is not null").select(
        F.lit("user").alias("type"), key(F.col("rel_to_source")).alias("message_uuid"), F.lit(None).cast("string").alias("parent_uuid"), key(F.col("session")).alias("session_id"), F.date_format(F.timestamp_seconds("mtime_unix"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_iso"),
        F.col("folder").alias("cwd"), F.lit("document").alias("role"), F.concat("rel_to_session", F.lit("\n\n"), "text").alias("content"),
    )
