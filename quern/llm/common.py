"""What the operators of this subpackage share: text batches, staged tables, digests, connected components."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.store import scratch, spread, staged  # noqa: F401

#: Rows and bytes of text that a Python worker handles at once; memory, not results, depends on them.
CHUNK_ROWS, CHUNK_BYTES = 1024, 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def keep(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, under fixed names, so that no other column can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished stages now: it does so when the driver's JVM collects them."""
    gc.collect()
    spark._jvm.System.gc()


def drop_staged(df: DataFrame) -> None:
    """Deletes the table that staged() wrote and df reads."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(f)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_chunks(batch: pa.RecordBatch, at: int, rows: int = CHUNK_ROWS, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch of at most so many rows and, but for single long texts, bytes of column at."""
    sizes = pc.binary_length(batch.column(at)).fill_null(0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= rows or total + n > most):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(df: DataFrame, fn: Callable[[list[int], list[bytes | None]], dict], schema: pa.Schema, spark_schema: str, extra: list[str] | None = None) -> DataFrame:
    """Runs fn over chunks of (doc_id, UTF-8 bytes or None) of a DataFrame of keep(); fn returns columns by name."""
    cols = ["doc_id", "text", *(extra or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch, 1):
                part = batch.slice(a, b - a)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                more = [part.column(i).to_pylist() for i in range(2, len(cols))]
                out = fn(part.column(0).to_pylist(), texts, *more)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(i).type) for i, x in enumerate(out[n] for n in schema.names)], schema=schema)

    return df.select(*cols).mapInArrow(run, spark_schema)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def crc_mod(col: Column, n: int) -> Column:
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur3's constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find: (node, label) for every node of the edges; label is the component's least node.

    Each round hooks every node onto its least neighbour, halves the pointer chains until they are flat, and
    contracts the edges by the new labels; loops go, so few rounds remain whatever the shape. Neighbour lists
    are never gathered: each round is a min() with partial aggregation and equi-joins, every round's table is
    written to the shared folder.
    """
    rest = staged(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    label: DataFrame | None = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = staged(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "up")
        while True:
            to = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
            jumped = staged(up.join(to, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), "jump")
            drop_staged(up)
            up = jumped.select("node", "label")
            if jumped.where("moved").isEmpty():
                break
        if label is None:
            label = up
        else:
            after = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
            old, label = label, staged(label.join(after, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
            drop_staged(old)
        x, y = up.select(F.col("node").alias("u"), F.col("label").alias("x")), up.select(F.col("node").alias("v"), F.col("label").alias("y"))
        before, rest = rest, staged(rest.join(x, "u").join(y, "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        drop_staged(before)
        if label is not up:
            drop_staged(up)
    return label if label is not None else rest.select(F.col("u").alias("node"), F.col("v").alias("label"))
