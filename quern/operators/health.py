"""Coverage, index health and findings: anti-joins and small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(disk: DataFrame, indexed: DataFrame) -> DataFrame:
    """path and reason of files that search cannot see: never walked, invalid, or not indexed yet."""
    missing = disk.join(indexed.select("path"), "path", "left_anti")
    reason = F.when(~F.col("walked"), "never_walked").when(~F.col("ok"), "invalid").otherwise("not_yet_indexed")
    return missing.select("path", reason.alias("reason"))


def verdict(disk: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: counts, and ok only if nothing is rejected and as many are indexed as lie on disk."""
    gaps = coverage(disk, indexed)
    n = disk.agg(F.count("*").alias("on_disk")).join(F.broadcast(indexed.agg(F.count("*").alias("indexed")))).join(F.broadcast(gaps.agg(F.count_if(F.col("reason") != "not_yet_indexed").alias("rejected"))))
    return n.withColumn("status", F.when((F.col("rejected") == 0) & (F.col("indexed") == F.col("on_disk")), "ok").otherwise("problem"))


def percent(df: DataFrame, group: str, indexed: str) -> DataFrame:
    """discoverable, indexed and percent (0 where there is nothing) of each group."""
    return df.groupBy(group).agg(F.count("*").alias("discoverable"), F.count_if(F.col(indexed)).alias("indexed")).withColumn("percent", F.round(F.coalesce(F.try_divide(100.0 * F.col("indexed"), F.col("discoverable")), F.lit(0.0)), 4))


def files_without_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    return files.join(chunks.select("file_path").distinct(), "file_path", "left_anti")


def findings(counts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """label, detail (rows) and status of checks that are ok when their DataFrame is empty; (rows, remedy) by label."""
    parts = [df.agg(F.count("*").alias("detail")).select(F.lit(label).alias("label"), "detail", F.when(F.col("detail") == 0, "ok").otherwise("problem").alias("status"), F.when(F.col("detail") == 0, "").otherwise(remedy).alias("remedy")) for label, (df, remedy) in counts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_dimension(df: DataFrame, vector_col: str, dim: int) -> None:
    """Raises where a stored vector has another width than the embedder."""
    wrong = df.where(F.size(vector_col) != dim).limit(1).collect()
    if wrong:
        raise ValueError(f"stored vectors are not {dim} wide: rebuild the index")


def silent_empty(stored, hits, filtered):
    """Data is there, nothing was found and nothing was merely filtered: the index is suspect. Of numbers or Columns."""
    return (stored > 0) & (hits == 0) & (filtered == 0)


def last_indexed(files: DataFrame) -> DataFrame:
    """One row: the latest indexed_at, the newest mtime_unix and the number of files."""
    return files.agg(F.max("indexed_at").alias("indexed_at"), F.max("mtime_unix").alias("newest_mtime"), F.count_distinct("file_path").alias("files"))


def counted(rows: DataFrame, most: int) -> DataFrame:
    """One row: n, how many rows there are, counted no further than a limit."""
    return rows.limit(most).agg(F.count("*").alias("n"))


def margin(related: float, unrelated: float, least: float = 0.10) -> bool:
    return related - unrelated >= least


def outcomes(ledger: DataFrame) -> DataFrame:
    """claims, launched, failed and unknown of a ledger (outcome)."""
    n = ledger.agg(F.count_if(F.col("outcome") == "claim").alias("claims"), F.count_if(F.col("outcome") == "launched").alias("launched"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    return n.withColumn("unknown", F.col("claims") - F.col("launched") - F.col("failed"))
