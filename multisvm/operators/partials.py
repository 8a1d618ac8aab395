"""Per-partition partial sums, reduced to one vector per key.

The numpy kernels (gradient, k-means) emit one ``(k, r, n, g)`` row per key and
range of ``SPAN`` features per partition. Reducing them is the only data that
reaches the driver in an iteration. Up to ``DRIVER_SUM_LIMIT`` values the
partials are collected and added on the driver (one stage, like the last level
of a tree aggregate); above it they are first summed on Spark by (key, range),
so that one problem over millions of features is summed by as many tasks as it
has ranges, and the driver receives one row a key and range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from multisvm.operators.blocks import SparseRows, feature_block

# Largest number of partial values (partitions x keys x width) added on the driver.
DRIVER_SUM_LIMIT = 4_000_000
# Features of one partial row.
SPAN = 16_384

PARTIAL_SCHEMA = StructType([
    StructField("k", IntegerType(), False),
    StructField("r", IntegerType(), False),
    StructField("n", LongType(), False),
    StructField("g", ArrayType(DoubleType(), False), False),
])
_ARROW_PARTIAL = to_arrow_schema(PARTIAL_SCHEMA)


def features_matrix(arr, dim: int) -> np.ndarray:
    """Arrow list column (fixed width ``dim``) -> float64 ``n x dim`` matrix."""
    block = feature_block(arr, dim)
    return block.toarray() if isinstance(block, SparseRows) else block


def list_column(values: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Rows of a matrix as an Arrow list column."""
    n, width = values.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel(), kind))


def partial_batch(keys, counts, sums: np.ndarray, span: int = SPAN) -> pa.RecordBatch:
    """Rows (k, r, n, g) for the keys a partition saw; n is with range 0."""
    keys = np.asarray(keys, dtype=np.int32)
    counts = np.asarray(counts, dtype=np.int64)
    sums = np.asarray(sums, dtype=np.float64)
    kind = _ARROW_PARTIAL.field("g").type
    columns: list[list[pa.Array]] = [[], [], [], []]
    for r, lo in enumerate(range(0, max(1, sums.shape[1]), span)):
        parts = [pa.array(keys), pa.array(np.full(len(keys), r, np.int32)),
                 pa.array(counts if r == 0 else np.zeros_like(counts)), list_column(sums[:, lo:lo + span]).cast(kind)]
        for column, part in zip(columns, parts):
            column.append(part)
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) if len(c) > 1 else c[0] for c in columns], schema=_ARROW_PARTIAL)


def sum_kernel():
    """Arrow-batch function: add up the partial rows of a partition by (key,
    range), the partition's own ones only."""

    def kernel(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        counts: dict[tuple[int, int], int] = {}
        for batch in batches:
            g = batch.column("g")
            values, ends = g.flatten().to_numpy(zero_copy_only=False), np.cumsum(g.value_lengths().to_numpy(zero_copy_only=False))
            keys = zip(batch.column("k").to_pylist(), batch.column("r").to_pylist())
            for key, n, lo, hi in zip(keys, batch.column("n").to_pylist(), np.append(0, ends), ends):
                if key in sums:
                    sums[key] += values[lo:hi]
                    counts[key] += n
                else:
                    sums[key], counts[key] = values[lo:hi].copy(), n
        for (k, r), g in sorted(sums.items()):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([r], pa.int32()), pa.array([counts[k, r]], pa.int64()),
                 list_column(g[None, :]).cast(_ARROW_PARTIAL.field("g").type)], schema=_ARROW_PARTIAL)

    return kernel


def sum_tasks(n_keys: int, dim: int, n_partitions: int, span: int = SPAN) -> int:
    """Tasks of the Spark-side sum: as many as there are (key, range) pairs, or partitions."""
    return max(1, min(n_keys * -(-dim // span), n_partitions))


def reduce_partials(parts: DataFrame, n_keys: int, dim: int, n_partitions: int,
                    driver_limit: int | None = None, span: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum partial rows by key -> (sums n_keys x dim, counts n_keys).

    When ``n_partitions x n_keys x dim`` is within the limit the partials go
    straight to the driver. Otherwise they are shuffled by (key, range) and
    summed in ``sum_tasks`` tasks, and ``n_keys x dim`` values (the size of the
    model) come back.
    """
    limit = DRIVER_SUM_LIMIT if driver_limit is None else driver_limit
    span = SPAN if span is None else span
    if n_partitions * n_keys * max(dim, 1) > limit:
        parts = parts.repartition(sum_tasks(n_keys, dim, n_partitions, span), "k", "r").mapInArrow(sum_kernel(), PARTIAL_SCHEMA)
    sums = np.zeros((n_keys, dim))
    counts = np.zeros(n_keys, dtype=np.int64)
    tbl = parts.toArrow()
    for batch in tbl.to_batches():
        k, r = batch.column("k").to_numpy(), batch.column("r").to_numpy()
        np.add.at(counts, k, batch.column("n").to_numpy())
        for each in np.unique(r):
            own = np.flatnonzero(r == each)
            lo, hi = int(each) * span, min(dim, (int(each) + 1) * span)
            rows = batch.column("g") if len(own) == len(r) else batch.column("g").take(pa.array(own))
            np.add.at(sums[:, lo:hi], k[own], features_matrix(rows, hi - lo))
    return sums, counts
