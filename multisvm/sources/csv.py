"""Labelled CSV: ``d`` numeric fields then the label (last field), no header.
Spaces around values are trimmed by the reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from multisvm.sources.tables import labelled


def csv_schema(num_features: int) -> StructType:
    fields = [StructField(f"f{i}", DoubleType(), True) for i in range(num_features)]
    return StructType(fields + [StructField("label", DoubleType(), True)])


def read_labeled_csv(spark: SparkSession, path: str, num_features: int) -> DataFrame:
    """Read with a fixed schema (no inference pass) into the labelled schema."""
    raw = (
        spark.read.schema(csv_schema(num_features))
        .option("header", "false")
        .option("ignoreLeadingWhiteSpace", "true")
        .option("ignoreTrailingWhiteSpace", "true")
        .option("mode", "FAILFAST")
        .csv(path)
    )
    feats = F.array(*[F.col(f"f{i}") for i in range(num_features)])
    return labelled(raw.select(F.col("label"), feats.alias("features")), None, "label", "features")


def write_labeled_csv(df: DataFrame, path: str, num_features: int,
                      features_col: str = "features", label_col: str = "label") -> None:
    cols = [F.col(features_col)[i].cast("double").alias(f"f{i}") for i in range(num_features)]
    df.select(*cols, F.col(label_col).cast("double").alias("label")).write.mode("errorifexists").csv(path)
