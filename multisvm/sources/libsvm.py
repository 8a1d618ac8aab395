"""LibSVM text (``label index:value ...``), through Spark's built-in source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from multisvm.sources.tables import labelled


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """Read LibSVM files into the labelled schema; ``features`` stays an ML
    (sparse) vector column whose width is kept in the column metadata.

    Pass ``num_features`` on large inputs: without it Spark runs an extra pass
    over the data to find the largest index.
    """
    reader = spark.read.format("libsvm")
    if num_features:
        reader = reader.option("numFeatures", str(int(num_features)))
    return labelled(reader.load(path), None, "label", "features")


def write_libsvm(df: DataFrame, path: str, features_col: str = "features", label_col: str = "label") -> None:
    """Write a labelled frame as LibSVM text (one file per partition)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql.types import ArrayType

    feat = F.col(features_col)
    if isinstance(df.schema[features_col].dataType, ArrayType):
        feat = array_to_vector(feat.cast("array<double>"))
    out = df.select(F.col(label_col).cast("double").alias("label"), feat.alias("features"))
    out.write.format("libsvm").mode("errorifexists").save(path)
