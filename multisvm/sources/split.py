"""Train/test split by hash of (seed, id): no shuffle, no driver round trip,
the same rows on every run and in every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from multisvm.functions.hashing import in_fraction

SPLIT = "split"


def with_split(df: DataFrame, train_fraction: float = 0.5, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Add ``split`` = 'train' / 'test'."""
    is_train = in_fraction(str(seed), F.col(id_col), train_fraction)
    return df.withColumn(SPLIT, F.when(is_train, F.lit("train")).otherwise(F.lit("test")))


def train_test_split(df: DataFrame, train_fraction: float = 0.5, seed: int = 42,
                     id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Two filters over the same scan; each is pushed into its own read."""
    is_train = in_fraction(str(seed), F.col(id_col), train_fraction)
    return df.where(is_train), df.where(~is_train)


def random_split(df: DataFrame, train_fraction: float = 0.5, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Spark's sampler, as the reference's unseeded ``randomSplit`` (not reproducible
    across partitionings; never used where an oracle compares rows)."""
    a, b = df.randomSplit([train_fraction, 1.0 - train_fraction], seed)
    return a, b
