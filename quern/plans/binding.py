"""The library's entities over the plain tables: notes from documents, messages from conversations, freezes from events.

Each has a DataFrame form and the same thing as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.store import spread

LAYER_DIRS = ("always", "when", "topics", "knowledge", "feedback")

MEM = """mem AS (SELECT doc_id AS chunk_id, text, source,
  '/m/' || CASE doc_id % 5 WHEN 0 THEN 'always' WHEN 1 THEN 'when' WHEN 2 THEN 'topics' WHEN 3 THEN 'knowledge' ELSE 'feedback' END || '/' || doc_id || '.md' AS file_path,
  CAST(DATE '2025-01-01' + CAST(doc_id % 500 AS INTEGER) AS VARCHAR) AS created,
  CAST(DATE '2025-01-01' + CAST(doc_id % 500 + doc_id % 90 AS INTEGER) AS VARCHAR) AS updated,
  CASE WHEN doc_id % 11 = 0 THEN '2027-01-01' END AS valid_from,
  CASE WHEN doc_id % 7 = 0 THEN '2026-01-01T00:00:00' END AS invalidated_at,
  CASE WHEN doc_id % 3 = 0 THEN CAST(DATE '2025-01-01' + CAST(doc_id % 500 + 30 AS INTEGER) AS VARCHAR) END AS last_confirmed,
  CASE WHEN doc_id % 13 = 0 THEN '2026-02-02T00:00:00' END AS suspected_at
  FROM documents)"""
MSG = """msg AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id || '-' || turn AS message_uuid, role, text AS content,
  '/home/u/p' || (conv_id % 6) AS cwd, TIMESTAMP '2026-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS ts,
  CAST(turn + 1 AS INTEGER) AS line_number, '/t/' || conv_id || '.jsonl' AS jsonl_path, conv_id, turn FROM conversations)"""
EVT = """evt AS (SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, CAST(ts AS TIMESTAMP) AS ts, event_type, value, props FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def mem(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    day = lambda n: F.date_add(F.lit("2025-01-01").cast("date"), n.cast("int")).cast("string")
    layer = F.element_at(F.array(*[F.lit(x) for x in LAYER_DIRS]), (i % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        i.alias("chunk_id"), "text", "source", F.concat(F.lit("/m/"), layer, F.lit("/"), i.cast("string"), F.lit(".md")).alias("file_path"), day(i % 500).alias("created"), day(i % 500 + i % 90).alias("updated"), F.when(i % 11 == 0, "2027-01-01").alias("valid_from"),
        F.when(i % 7 == 0, "2026-01-01T00:00:00").alias("invalidated_at"), F.when(i % 3 == 0, day(i % 500 + 30)).alias("last_confirmed"), F.when(i % 13 == 0, "2026-02-02T00:00:00").alias("suspected_at"),
    )


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with a vector: that of their number modulo the number of vectors."""
    return with_vector(spark, sf_dir, mem(spark, sf_dir), F.col("chunk_id"))


def with_vector(spark: SparkSession, sf_dir: str, rows: DataFrame, number: Column) -> DataFrame:
    """rows with vec_id and embedding: the vector of number modulo how many there are."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    many = F.broadcast(vectors.agg(F.count("*").alias("__many")))  # one row
    return rows.withColumn("__number", number).join(many).withColumn("vec_id", F.try_mod("__number", "__many")).drop("__number", "__many").join(vectors, "vec_id")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def msg(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        c.cast("string").alias("session_id"), F.concat(c.cast("string"), F.lit("-"), t.cast("string")).alias("message_uuid"), "role", F.col("text").alias("content"), F.concat(F.lit("/home/u/p"), (c % 6).cast("string")).alias("cwd"),
        (F.lit("2026-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=c.cast("int"), mins=t.cast("int"))).alias("ts"), (t + 1).cast("int").alias("line_number"), F.concat(F.lit("/t/"), c.cast("string"), F.lit(".jsonl")).alias("jsonl_path"), "conv_id", "turn",
    )


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value", "props")


def jsonl(messages: DataFrame) -> DataFrame:
    """The messages as transcript lines: system turns keep their own type, every ninth content is a list of blocks."""
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"))))
    content = F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, blocks).otherwise(F.to_json(F.struct(F.col("content").alias("c"))))
    text = F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, content).otherwise(F.regexp_extract(content, r'(?s)^\{"c":(.*)\}$', 1))
    field = lambda n, c: F.concat(F.lit(f'"{n}":"'), c, F.lit('"'))
    raw = F.concat(F.lit("{"), F.concat_ws(",", field("type", "role"), field("uuid", "message_uuid"), field("sessionId", "session_id"), field("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), field("cwd", "cwd")), F.lit(',"message":{"role":"'), F.col("role"), F.lit('","content":'), text, F.lit("}}"))
    return messages.select("jsonl_path", "line_number", raw.alias("raw"))
