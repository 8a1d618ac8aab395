"""Order statistics of a column, exact and without sorting it in one place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 1024


def value_at(rows: DataFrame, col: str, rank: int, times: Column | None = None) -> float:
    """The value of (0-based) ``rank`` among the sorted values of ``col``, each row
    counted ``times`` (a whole number, once if not given); finite values only.

    Each pass counts the rows by equal parts of the range that holds the rank,
    then goes on with that part: a thousandth of the range before, down to one
    value. The driver sees the counts of ``PARTS`` parts."""
    times = F.lit(1) if times is None else times
    rows = rows.select(F.col(col).alias("value"), times.cast("long").alias("times"))
    low, high = rows.agg(F.min("value"), F.max("value")).first()
    while low < high:
        place = F.floor((F.col("value") - F.lit(low)) / F.lit(high - low) * PARTS)
        parts = rows.where(F.col("value").between(low, high)).groupBy(F.least(F.lit(PARTS - 1), place).alias("part"))
        for part in parts.agg(F.sum("times").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).orderBy("part").collect():
            if rank < part.n:
                low, high = part.low, part.high
                break
            rank -= part.n
        else:
            return high
    return low


def quantile(rows: DataFrame, col: str, share: float) -> float:
    """The quantile of ``col`` over all rows, linear between the neighbours as numpy's."""
    at = share * (rows.count() - 1)
    below = value_at(rows, col, math.floor(at))
    return below + (value_at(rows, col, math.ceil(at)) - below) * (at - math.floor(at))
