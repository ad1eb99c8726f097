"""Streaming ingest: messages as they are dropped, first writer wins, resumable by checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.ingest import first_writer
from quern.store import exists, scratch


def work_dir(spark: SparkSession, name: str) -> str:
    """A folder for a query's checkpoint and output below the session's shared folder."""
    return scratch(spark, name)


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile())


def drops(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a stream: a single file is found by its name, a folder is read as it fills."""
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    like = spark.read.parquet(path)
    if _is_file(spark, path):
        return spark.readStream.schema(like.schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return spark.readStream.schema(like.schema).parquet(path)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into a Parquet table (append) or the last complete state, and reads it."""
    spark = stream.sparkSession
    base = work_dir(spark, name)
    out = f"{base}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = writer.outputMode("append").format("parquet").start(out)
    else:
        q = writer.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(out)


def dedupe(stream: DataFrame, time_col: str | None = None, within: str = "7 days") -> DataFrame:
    """One row of each (session_id, message_uuid).

    With a time column, state is dropped when a key is older than `within`, which a repetition may be late by; without
    one, state holds a key of every message for ever.
    """
    keys = ["session_id", "message_uuid"]
    return stream.withWatermark(time_col, within).dropDuplicatesWithinWatermark(keys) if time_col else stream.dropDuplicates(keys)


#: Parts that a table of upsert_batches() is dealt into by session.
BUCKETS = 256


def watch(changes: DataFrame, act: Callable[[], None], base: str, every: str = "500 milliseconds"):
    """Runs act once for all changes of an interval: bursts are taken together, and no two runs overlap."""

    def run(df: DataFrame, n: int) -> None:
        if not df.isEmpty():
            act()

    return changes.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(processingTime=every).foreachBatch(run)


def upsert_batches(stream: DataFrame, store: str, base: str):
    """Exactly-once ingest into a table: each batch adds the keys that the table lacks, of each the first by path and line.

    The table is dealt by a hash of the session, and a batch is compared with the parts of its own sessions alone.
    """
    spark = stream.sparkSession

    def put(df: DataFrame, n: int) -> None:
        placed = {"jsonl_path", "line_number"} <= set(df.columns)
        new = first_writer(df) if placed else df.dropDuplicates(["session_id", "message_uuid"])
        new = new.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int"))
        if exists(spark, store):
            mine = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS numbers at most
            old = spark.read.schema(new.schema).parquet(store).where(F.col("bucket").isin(mine))
            new = new.join(old.select("session_id", "message_uuid"), ["session_id", "message_uuid"], "left_anti")
        new.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(store)

    return stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put)


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each session, ingested as a stream into a dealt table: what it holds is the only memory of keys."""
    raw = drops(spark, sf_dir, "conversations").where("role <> 'system'")
    named = raw.select(F.col("conv_id").cast("string").alias("session_id"), F.concat_ws("-", "conv_id", "turn").alias("message_uuid"))
    base = work_dir(spark, "ingest")
    q = upsert_batches(named, f"{base}/store", base)
    q.start().awaitTermination()
    return spark.read.schema(named.schema).parquet(f"{base}/store").groupBy("session_id").agg(F.count("*").alias("n"))
