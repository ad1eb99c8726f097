"""Heading-aware chunks of markdown. Python, in Arrow batches: line rules and paragraph packing have no built-in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"^(#{1,6})\s+(.+)$")


def sections(body: str) -> Iterator[tuple[str | None, str, int, int]]:
    """(heading, text, first line, last line) of the text before the first heading and of each heading's."""
    lines = body.splitlines()
    starts = [i for i, line in enumerate(lines) if HEADING.match(line)]
    for a, b in zip([0, *starts], [*starts, len(lines)], strict=True):
        text = "\n".join(lines[a:b]).strip()
        if text:
            m = HEADING.match(lines[a])
            yield m.group(2).strip() if m else None, text, a + 1, b


def packed(heading: str | None, text: str, first: int, last: int, most: int) -> Iterator[tuple[str | None, str, int, int]]:
    """The section, or its paragraphs packed up to `most` UTF-8 bytes; joints do not count, one paragraph may overshoot."""
    if len(text.encode()) <= most:
        yield heading, text, first, last
        return
    parts = re.split(r"\n\s*\n", text)
    if len(parts) > 1 and HEADING.match(parts[0].splitlines()[0]):
        parts[:2] = [parts[0] + "\n\n" + parts[1]]  # a heading never stands alone
    groups: list[list[str]] = []
    size = 0
    for p in parts:
        n = len(p.encode())
        if not groups or size + n > most:
            groups.append([])
            size = 0
        groups[-1].append(p)
        size += n
    start = first
    for k, g in enumerate(groups):
        end = start + sum(p.count("\n") + 2 for p in g) - 1 if k + 1 < len(groups) else last
        joined = "\n\n".join(g).strip()
        if joined:
            yield heading, joined, start, min(end, last)
        start = end + 1


def chunk(body: str | None, most: int) -> list[dict]:
    names = ("heading", "text", "line_start", "line_end")
    return [dict(zip(names, c, strict=True)) for s in sections(body or "") for c in packed(*s, most)]


def chunks(df: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """id, chunk_no, heading, text, line_start, line_end of every chunk; blank bodies have none."""
    kind = pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())]))
    of = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([chunk(t, most) for t in part.column(1).to_pylist()], kind)], names=[id_col, "chunks"])

    made = df.select(id_col, text_col).mapInArrow(run, f"{id_col} {of}, chunks array<struct<heading:string,text:string,line_start:int,line_end:int>>")
    return made.select(id_col, F.posexplode("chunks").alias("chunk_no", "c")).select(id_col, "chunk_no", "c.*")


def section_rows(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, section, heading, line_start, n_lines of every section, JVM-side: lines numbered, headings counted up to each."""
    lines = df.select(id_col, F.posexplode(F.split(text, "\n")).alias("i", "line")).withColumn("head", F.col("line").rlike(r"^#{1,6}\s+.+$"))
    numbered = lines.withColumn("section", F.sum(F.col("head").cast("int")).over(_upto(id_col)))
    heading = F.max(F.when(F.col("head"), F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1))))
    return numbered.groupBy(id_col, "section").agg(heading.alias("heading"), (F.min("i") + 1).alias("line_start"), F.count("*").alias("n_lines"), F.max(F.trim("line") != "").alias("filled")).where("filled").drop("filled")


def _upto(id_col: str):
    from pyspark.sql import Window

    return Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)


def embedding_text(name: Column, text: Column) -> Column:
    return F.concat_ws("\n", name, text)
