"""Media columns: bytes stored as lossless WebP images, read back by the decoder, and features of the samples."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm import webp
from quern.llm.common import keep, map_texts, sha256

ROW = 576
FILL = 255
#: Repeated lines from this length are written as references, up to this distance.
LEAST_MATCH, FARTHEST = 12, (1 << 20) - 256
MOST_MATCH = 4096


def payload_of(data: bytes) -> bytes:
    """The bytes and a fill up to a positive multiple of ROW."""
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW, bytes([FILL]))


def repeats(data: bytes) -> list[tuple[int, int, int]]:
    """References (start, length, distance): lines that stand earlier in data, and the fill at its end."""
    found: list[tuple[int, int, int]] = []
    ends = len(data.rstrip(bytes([FILL])))
    last: dict[bytes, int] = {}
    at = 0
    for line in data[:ends].split(b"\n"):
        if len(line) >= LEAST_MATCH:
            before = last.get(line)
            if before is not None and at - before <= FARTHEST:
                found += [(at + k, min(MOST_MATCH, len(line) - k), at - before) for k in range(0, len(line), MOST_MATCH)]
            last[line] = at
        at += len(line) + 1
    found += [(k, min(MOST_MATCH, len(data) - k), 1) for k in range(ends + 1, len(data), MOST_MATCH)]
    return found


def store(payload: bytes) -> bytes:
    """One lossless WebP file for every 16384 rows of ROW samples, one after the other."""
    part = ROW * webp.MAX_SIDE
    return b"".join(webp.encode_grey(np.frombuffer(p := payload[k : k + part], dtype=np.uint8), ROW, repeats(p)) for k in range(0, len(payload), part))


def load(media: bytes) -> np.ndarray:
    """The pixel arrays of stored files, joined: rows of ROW samples."""
    parts, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        parts.append((webp.decode(media[at : at + size]) >> 8 & 0xFF).astype(np.uint8))
        at += size
    return np.concatenate(parts)


def features(image: np.ndarray) -> str:
    """Height, mean, deviation, distinct samples, most frequent sample and mean step between neighbours in a row."""
    counts = np.bincount(image.ravel(), minlength=256)
    n, values = image.size, np.arange(256)
    mean = float(counts @ values) / n
    spread = max(0.0, float(counts @ (values * values)) / n - mean * mean) ** 0.5
    step = int(np.abs(np.diff(image.astype(np.int16), axis=1)).sum()) / n
    return f"rows={image.shape[0]};mean={mean:.4f};sd={spread:.4f};distinct={int((counts > 0).sum())};mode={int(counts.argmax())};step={step:.4f}"


def media_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (binary) of every row; a null text is stored as an empty one. No shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(ids: list[int], texts: list[bytes | None]) -> dict:
        return {"doc_id": ids, "n_bytes": [len(t or b"") for t in texts], "media": [store(payload_of(t or b"")) for t in texts]}

    return map_texts(keep(df, id_col, text_col), run, schema, "doc_id long, n_bytes long, media binary")


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds pixels (binary: rows of ROW samples read back) and feature to a media_table(); null media stay null."""
    names = [c for c in df.columns if c not in ("pixels", "feature")]
    at = names.index(media_col)

    def run(batches):
        for batch in batches:
            images = [None if m is None else load(m) for m in batch.column(at).to_pylist()]
            more = [pa.array([None if i is None else i.tobytes() for i in images], pa.binary()), pa.array([None if i is None else features(i) for i in images], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "pixels", "feature"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields)
    return df.select(*names).mapInArrow(run, f"{fields}, pixels binary, feature string")


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text, reads the stored bytes back and returns digests of both, and features.

    A null text counts as empty: one row of fill. Equal texts give equal values; repeated rows stay; an empty table
    gives no rows; other columns are not read. The stored form lives only while its row is made: no shuffle, no disk.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(ids: list[int], texts: list[bytes | None]) -> dict:
        out: dict = {n: [] for n in schema.names}
        out["doc_id"] = ids
        for t in texts:
            media = store(payload_of(t or b""))
            image = load(media)
            data = image.tobytes()
            for n, v in (("n_bytes", len(t or b"")), ("payload_bytes", len(data)), ("payload_sha256", sha256(data)), ("tail_crc32", zlib.crc32(data[-32:])), ("media_bytes", len(media)), ("media_sha256", sha256(media)), ("feature", features(image))):
                out[n].append(v)
        return out

    return map_texts(keep(df, id_col, text_col), run, schema, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.common import read_table

    return media_digests(read_table(spark, sf_dir, "documents"))
