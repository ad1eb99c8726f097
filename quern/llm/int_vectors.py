"""Vectors as integers: what the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 256
#: Integer components end here, at 262,144 in a vector's own units, so that sums of squares stay within 64 bits (up to 2,048 components).
LARGEST = 1 << 26


def finite(v: Column) -> Column:
    """Whether an array of doubles is there and holds finite numbers only; false for null."""
    odd = [F.array_contains(v, F.lit(float(x))) for x in ("nan", "inf", "-inf")]  # null where a component is null and none is x
    return F.coalesce(~(odd[0] | odd[1] | odd[2]), F.lit(False))


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and v (doubles) of the rows whose vector is there, finite and not empty."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(finite(F.col("v")) & (F.size("v") > 0))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of floor(STEPS * x) of an Arrow column of lists that have width doubles each."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.clip(np.floor(x * float(STEPS)), -LARGEST, LARGEST).astype(np.int64)
