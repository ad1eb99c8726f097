"""Sinks: transcripts by session, index listings, skip manifests, review files."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ingest import to_jsonl


def write_transcripts(messages: DataFrame, path: str) -> None:
    """One folder of lines for each session, in order; what was there is replaced.

    Folders are named by the session with odd characters as dashes; two sessions of one name are an error.
    """
    lines = to_jsonl(messages).withColumn("session", folder_name(F.col("session_id")))
    names = lines.groupBy("session").agg(F.min("session_id").alias("a"), F.max("session_id").alias("b")).where("a <> b").first()
    if names:
        raise ValueError(f"sessions {names['a']!r} and {names['b']!r} have the same folder {names['session']!r}")
    lines.repartition("session").sortWithinPartitions("session", "line_number").select("session", F.col("raw").alias("value")).write.mode("overwrite").partitionBy("session").text(path)


def folder_name(session: Column) -> Column:
    return F.regexp_replace(session, r"[^\p{L}\p{N}_.\-]+", "-")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def skip_manifest(gaps: DataFrame) -> DataFrame:
    """One row: how many files are skipped, and which. The list is of a note store's rejected files."""
    return gaps.agg(F.count("*").alias("count"), F.sort_array(F.collect_list("path")).alias("paths"))


def render_index(layers: DataFrame, tags: DataFrame, aliases: DataFrame) -> str:
    """The index note: files by layer and by tag (key, file), file by alias. Small tables by nature, rendered on the driver."""
    out = ["# Index", ""]
    for title, df, key, value in (("Layers", layers, "key", "file"), ("Tags", tags, "key", "file"), ("Aliases", aliases, "alias", "file_path")):
        out += [f"## {title}", ""]
        for name, rows in groupby(df.orderBy(key, value).toLocalIterator(), lambda r: r[key]):
            out.append(f"- {name}: {', '.join(r[value] for r in rows)}")
        out.append("")
    return "\n".join(out)


def render_review(ranked: DataFrame) -> str:
    """A checklist of candidates (layer, content, command, status) by layer; deferred ones after the active."""
    active, deferred = ["# Review"], ["", "## Deferred", ""]
    last = None
    for r in ranked.orderBy("status", "layer_order", "rank").toLocalIterator():
        if r["status"] == "active":
            if r["layer"] != last:
                active += ["", f"## {r['layer']}", ""]
                last = r["layer"]
            active += [f"- [ ] {r['content']}", f"  capture: `{r['command']}`"]
        else:
            deferred.append(f"- {r['content']}")
    return "\n".join(active + (deferred if len(deferred) > 3 else [])) + "\n"


def within_budget(text: str, most: int) -> bool:
    return len(text.encode()) <= most


def promote(always: str, pointer: str, most: int) -> str:
    """The always-on note with a pointer line in its section: once, and only within the byte budget."""
    if pointer in always:
        return always
    head = "## Pointers"
    base = always.rstrip("\n") + ("" if head in always else f"\n\n{head}\n")
    made = base.rstrip("\n") + f"\n- {pointer}\n"
    return made if within_budget(made, most) else always
