"""Integer vectors from arrays of floating-point numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Integers of this magnitude and more are refused: sums of two must fit a long.
LIMIT = 1 << 62


def whole_vectors(df: DataFrame, vector_col: str) -> DataFrame:
    """The rows whose vector is not null and holds finite numbers only."""
    fine = F.forall(F.col(f"`{vector_col}`"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return df.where(F.coalesce(fine, F.lit(False)))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * component) as longs; a component too large for one is an error."""
    def floor(x: Column) -> Column:
        big = F.raise_error(F.lit(f"{scale} times a vector component exceeds 2^62")).cast("long")
        return F.when(F.abs(x.cast("double") * scale) < F.lit(float(LIMIT)), F.floor(x.cast("double") * scale)).otherwise(big)

    return F.transform(vector, floor)


def matrix(column, width: int) -> np.ndarray:
    """An Arrow column of long lists as int64 rows, padded with zeros to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    if len(flat) == len(lengths) * width and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    starts = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(starts, lengths)] = flat
    return out
