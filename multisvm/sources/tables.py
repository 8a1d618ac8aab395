"""Labelled feature tables: one row per example, ``id long, label int,
features array<float|double>``.

Parquet tables keep their float width (float32 embeddings stay float32 in the
cache and on the Arrow wire; the numpy kernels widen per batch).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, FloatType

ID, LABEL, FEATURES = "id", "label", "features"


def labelled(df: DataFrame, id_col: str | None = "id", label_col: str = "label",
             features_col: str = "features") -> DataFrame:
    """Project any table onto the labelled schema.

    ``features`` stays as it is: an array (dense) or an ML vector column
    (LibSVM; multiplied in bounded blocks in the kernels). Rows without a label
    or without features take no part. What would be lost or merged in silence
    is an error when it is read: a null id, a label that is not a whole number,
    a null or NaN feature (of array columns; the trainer rejects non-finite
    weights in any case).

    Without an id column the id is a hash of label and features: the same
    whatever the file layout, so the hash split and the mini-batches are, too.
    Rows with equal content share an id and fall on the same side.
    """
    label, features = F.col(label_col), F.col(features_col)
    rows = df.where(label.isNotNull() & features.isNotNull())
    if id_col:
        rid = F.coalesce(F.col(id_col).cast("long"), F.raise_error(F.lit(f"null id in column {id_col}")).cast("long"))
    else:
        rid = F.xxhash64(label, features)
    kind = df.schema[label_col].dataType
    if isinstance(kind, (DoubleType, FloatType, DecimalType)):
        whole = F.when(label == F.floor(label), label).otherwise(
            F.raise_error(F.concat(F.lit("label is not a whole number: "), label.cast("string"))).cast(kind))
        label = whole
    if isinstance(df.schema[features_col].dataType, ArrayType):
        bad = F.exists(features, lambda x: x.isNull() | F.isnan(x.cast("double")))
        features = F.when(~bad, features).otherwise(
            F.raise_error(F.lit(f"null or NaN value in {features_col}")).cast(df.schema[features_col].dataType))
    meta = df.schema[features_col].metadata
    return rows.select(rid.alias(ID), label.cast("int").alias(LABEL), features.alias(FEATURES, metadata=meta or {}))


def is_vector(df: DataFrame, col: str = FEATURES) -> bool:
    return not isinstance(df.schema[col].dataType, ArrayType)


def vector_width(df: DataFrame, col: str = FEATURES) -> int | None:
    """Width of an ML vector column from its metadata (the LibSVM source and
    ML transformers record it), or None."""
    meta = df.schema[col].metadata or {}
    width = meta.get("numFeatures") or (meta.get("ml_attr") or {}).get("num_attrs")
    return int(width) if width else None


def dense_array(df: DataFrame, col: str = FEATURES):
    """Column expression: the features as ``array<double>`` (vectors densified JVM-side)."""
    if is_vector(df, col):
        from pyspark.ml.functions import vector_to_array

        return vector_to_array(F.col(col), "float64")
    return F.col(col).cast("array<double>")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's ``embeddings`` table as a labelled frame."""
    return labelled(read_table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")


def from_columns(df: DataFrame, feature_cols: list[str], label_col: str, id_cols: list[str],
                 scale: str | None = "maxabs", labels: list | None = None) -> DataFrame:
    """Numeric columns -> labelled frame.

    * rows with a null label or feature are dropped;
    * string labels become their index among the sorted distinct values of the
      kept rows (pass ``labels`` when they are known to skip that work);
    * one id column is kept as is; several become ``concat_ws(':', ...)`` so
      the hash split sees the same key text in every engine (rows with equal
      keys fall on the same side);
    * ``scale="maxabs"`` divides each feature by its largest absolute value
      over the table, the way LibSVM ``.scale`` inputs are prepared.

    One aggregate before training for the scale factors. String labels are
    numbered on Spark (distinct values, ranked) and joined on the label; the
    label table is broadcast by Spark's own size check, never collected.
    """
    from pyspark.sql.types import StringType

    complete = F.col(label_col).isNotNull()
    for c in feature_cols:
        complete = complete & F.col(c).isNotNull()
    kept = df.where(complete)
    if scale not in ("maxabs", None):
        raise ValueError(f"unknown scale {scale!r}")
    aggs = [F.max(F.abs(F.col(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(feature_cols)]
    stats = kept.agg(*aggs).first() if scale == "maxabs" and aggs else None
    label = F.col(label_col)
    if isinstance(df.schema[label_col].dataType, StringType):
        if labels is None:
            known = kept.select(label_col).distinct()
        else:
            known = df.sparkSession.createDataFrame([(v,) for v in sorted(labels)], f"`{label_col}` string")
        # one row a label after the aggregate: ranked in one small window
        known = known.select(F.col(label_col), (F.row_number().over(Window.orderBy(label_col)) - 1).alias("_label_index"))
        kept = kept.join(known, label_col, "inner" if labels is None else "left")
        label = F.col("_label_index")
    feats = [F.col(c).cast("double") for c in feature_cols]
    if scale == "maxabs":
        feats = [f / F.lit(float(stats[f"m{i}"]) if stats[f"m{i}"] else 1.0) for i, f in enumerate(feats)]
    rid = F.col(id_cols[0]) if len(id_cols) == 1 else F.concat_ws(":", *[F.col(c) for c in id_cols])
    return kept.select(rid.alias(ID), label.cast("int").alias(LABEL), F.array(*feats).alias(FEATURES))


LINEITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a labelled frame: 4 scaled numeric features, class = return flag."""
    return from_columns(read_table(spark, sf_dir, "lineitem"), LINEITEM_FEATURES, "l_returnflag", LINEITEM_KEY)


PART_FEATURES = ["p_size", "p_retailprice", "p_partkey"]


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as a labelled frame: 3 scaled numeric features, class = brand (25 of them)."""
    return from_columns(read_table(spark, sf_dir, "part"), PART_FEATURES, "p_brand", ["p_partkey"])
