"""Vector expressions: cosine and L2 in double precision, and the feature-hashing embedder."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + TINY) * (norm(b) + TINY))


def cosine_to(a: Column, query: list[float]) -> Column:
    """Cosine to a fixed query; its norm is folded into the literal."""
    length = math.sqrt(sum(x * x for x in query)) + TINY
    return dot(a, F.array(*[F.lit(float(x) / length) for x in query])) / (norm(a) + TINY)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


#: Fixed value: the white space that str.split() cuts at, as a class of a pattern.
BLANKS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


#: Rows whose sums a worker holds at once, tokens that it gathers before it adds them up, and pairs of rows and tokens of
#: one addition: memory, not results, depends on them, however long a text is.
ROWS, HELD, PAIRS = 256, 1 << 18, 1 << 15


def token_slots(token: str) -> tuple[list[int], list[int]]:
    """The sixteen (seed, sign) pairs of a token: two bytes of its SHA-256 each, the first one's parity the sign."""
    d = hashlib.sha256(token.encode()).digest()
    return [d[i] << 8 | d[i + 1] for i in range(0, 32, 2)], [1 - 2 * (d[i] % 2) for i in range(0, 32, 2)]


def hashed(df: DataFrame, id_col: str, text: Column, dim: int, unit: bool) -> DataFrame:
    """One pass in Arrow batches: id with its unit vector, or with the slots it touches and their integer weights.

    Rows stay where they are: a row's distinct tokens are hashed and counted in its task, and nothing is shuffled.
    """
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                sums, times = np.zeros(part.num_rows * dim), np.zeros(part.num_rows * dim, dtype=np.int64)
                known: dict[str, int] = {}  # place of a token's digest
                digests, row, token, many = bytearray(), [], [], []

                def add() -> None:
                    d = np.frombuffer(bytes(digests), dtype=np.uint8).reshape(-1, 16, 2).astype(np.int64)
                    slots, signs = (d[:, :, 0] << 8 | d[:, :, 1]) % dim, 1 - 2 * (d[:, :, 0] % 2)
                    for i in range(0, len(token), PAIRS):
                        at = token[i : i + PAIRS]
                        flat = (np.array(row[i : i + PAIRS], dtype=np.int64)[:, None] * dim + slots[at]).ravel()
                        sums[:] += np.bincount(flat, (signs[at] * np.array(many[i : i + PAIRS], dtype=np.int64)[:, None]).ravel(), minlength=len(sums))
                        times[:] += np.bincount(flat, minlength=len(times))
                    for x in (known, digests, row, token, many):
                        x.clear()

                for r, t in enumerate(part.column(1).to_pylist()):
                    counted = Counter((t or "").split())
                    for x, n in counted.items():
                        at = known.get(x)
                        if at is None:
                            at = known[x] = len(known)
                            digests += hashlib.sha256(x.encode()).digest()
                        row.append(r)
                        token.append(at)
                        many.append(n)
                        if len(token) >= HELD:
                            add()
                add()
                total, touched = sums.astype(np.int64).reshape(-1, dim), times.reshape(-1, dim) > 0
                if unit:
                    length = np.sqrt((total * total).sum(1, dtype=np.float64))
                    made = total / np.where(length > 0, length, 1)[:, None]
                    made[length == 0, 0] = 1.0
                    vectors_ = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, dim, dtype=np.int32)), pa.array(made.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0), vectors_], names=[id_col, "embedding"])
                else:
                    r, slot = np.nonzero(touched)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(slot, pa.int32()), pa.array(total[r, slot])], names=[id_col, "slot", "weight"])

    shape = T.StructType([T.StructField(id_col, kind)]).add("embedding", T.ArrayType(T.DoubleType())) if unit else T.StructType([T.StructField(id_col, kind)]).add("slot", T.IntegerType()).add("weight", T.LongType())
    return df.select(id_col, F.regexp_replace(F.lower(text), BLANKS, " ").alias("__text")).mapInArrow(run, shape)


def hash_slots(df: DataFrame, id_col: str, text: Column, dim: int) -> DataFrame:
    """id, slot, weight (integer sum of signs) of every slot that a row's tokens touch."""
    return hashed(df, id_col, text, dim, False)


def embed(df: DataFrame, id_col: str, text: Column, dim: int) -> DataFrame:
    """id and embedding (unit array<double>) of every row; no tokens, or full cancellation, give the first unit vector."""
    return hashed(df, id_col, text, dim, True)


def embed_query(text: str, dim: int) -> list[float]:
    """The same embedding of one string, on the driver."""
    out = [0] * dim
    for token in text.lower().split():
        for seed, sign in zip(*token_slots(token), strict=True):
            out[seed % dim] += sign
    length = math.sqrt(sum(x * x for x in out))
    return [x / length for x in out] if length else [1.0] + [0.0] * (dim - 1)


class Embedder:
    """Extension point: dim, embed_query() for strings and embed() for tables."""

    def __init__(self, dim: int):
        self.dim = dim

    def embed_query(self, text: str) -> list[float]:
        return embed_query(text, self.dim)

    def embed(self, df: DataFrame, id_col: str, text: Column) -> DataFrame:
        return embed(df, id_col, text, self.dim)


EMBEDDERS: dict[str, type[Embedder]] = {"hashing": Embedder}


def embedder(name: str = "hashing", dim: int = 384) -> Embedder:
    if name not in EMBEDDERS:
        raise ValueError(f"no embedder {name!r}; known: {sorted(EMBEDDERS)}. Models plug in by EMBEDDERS[name] = class")
    return EMBEDDERS[name](dim)
