"""Reproducible hash buckets.

A row is "in" a fraction ``f`` of the data when the first 8 hex digits of
``md5("<salt>:<key>")`` sort below ``f * 2**32``. MD5 and string comparison
behave the same in every engine, so a split or a mini-batch drawn this way is
the same set of rows whatever the partitioning, and an SQL engine can
reproduce it exactly. The test runs JVM-side inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fraction_threshold(fraction: float) -> str | None:
    """Hex bound for ``fraction`` of the 32-bit space; None means every row."""
    if fraction >= 1.0:
        return None
    bound = max(0, int(round(fraction * 2**32)))
    return format(bound, "08x")


def hash_bucket(salt: str, key: Column) -> Column:
    """First 8 hex digits of md5('<salt>:<key>')."""
    return F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string"))), 1, 8)


def in_fraction(salt: str, key: Column, fraction: float) -> Column:
    """Boolean column: the row falls in ``fraction`` of the hash space."""
    bound = fraction_threshold(fraction)
    if bound is None:
        return F.lit(True)
    return hash_bucket(salt, key) < F.lit(bound)


def hash_int(salt: str, key: Column) -> Column:
    """First 32 bits of md5('<salt>:<key>') as a non-negative long."""
    return F.conv(hash_bucket(salt, key), 16, 10).cast("long")


def bucket_of(seed: int, key: Column, buckets: int) -> Column:
    """Fixed mini-batch bucket of a row: md5('<seed>:bucket:<key>') mod buckets."""
    return (hash_int(f"{seed}:bucket", key) % F.lit(int(buckets))).cast("int")


def bucket_offset(seed: int, t: int, buckets: int) -> int:
    """First bucket of iteration t's run: md5('<seed>:<t>') mod buckets (driver side)."""
    import hashlib

    return int(hashlib.md5(f"{seed}:{t}".encode()).hexdigest()[:8], 16) % buckets


def bucket_run(col: Column | str, offset: int, width: int, buckets: int) -> Column:
    """``(col - offset) mod buckets < width`` written as at most two range tests,
    which the in-memory columnar scan can use to skip cached batches.

    Given a column name the test is built as one SQL expression string (one
    JVM call; it is rebuilt every iteration)."""
    if width >= buckets:
        return F.lit(True)
    end = offset + width
    if isinstance(col, str):
        if end <= buckets:
            return F.expr(f"{col} >= {offset} AND {col} < {end}")
        return F.expr(f"{col} >= {offset} OR {col} < {end - buckets}")
    if end <= buckets:
        return (col >= F.lit(offset)) & (col < F.lit(end))
    return (col >= F.lit(offset)) | (col < F.lit(end - buckets))


def in_fraction_expr(salt: str, col: str, fraction: float) -> Column:
    """:func:`in_fraction` for a column name, as one SQL expression string."""
    bound = fraction_threshold(fraction)
    if bound is None:
        return F.lit(True)
    return F.expr(f"substring(md5(concat('{salt}:', CAST({col} AS STRING))), 1, 8) < '{bound}'")
