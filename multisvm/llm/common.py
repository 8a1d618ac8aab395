"""Helpers shared by the operators: tables, words, scratch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from multisvm.session import scratch_path, ship_package

# Word separators of the operators' contracts: space and \x09-\x0D (fixed values).
WHITE = " \t\n\x0b\x0c\r"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """``[^\\x20\\x09-\\x0D]+`` runs of the text as an array (null text: empty)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: a lambda over an array of
    one. The expression stays linear in size, however often the value is used
    and wherever the optimizer moves it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet under the shared checkpoint folder and read
    back: cuts the lineage with files that every executor sees, so a lost
    executor costs a re-read and not the steps before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def workers(spark: SparkSession) -> None:
    """Make the package importable in Python workers."""
    ship_package(spark)


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 (null id: 0): remainder 1 is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)), F.lit(0))
