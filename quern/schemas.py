"""Schemas of stored and read tables; sources never infer."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DateType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


CHUNK = struct(heading=S, text=S, line_start=I, line_end=I)
MEMORY_FILE = struct(path=S, ok=T.BooleanType(), reason=S, name=S, description=S, type=S, scope=S, tags=T.ArrayType(S), aliases=T.ArrayType(S), see_also=T.ArrayType(S), created=S, updated=S, valid_from=S, invalidated_at=S, last_confirmed=S, suspected_at=S, suspect_reason=S, body=S)
MESSAGE = struct(session_id=S, message_uuid=S, parent_uuid=S, role=S, content=S, cwd=S, timestamp_iso=S, timestamp_unix=L, jsonl_path=S, line_number=I)
MANIFEST = struct(path=S, mtime_unix=L, size_bytes=L, origin=S)
TASK = struct(id=S, title=S, status=S, owner_role=S, session_id=S, created=S, updated=S, links=T.ArrayType(S), body=S)
EVENT = struct(ts=S, payload=S)
