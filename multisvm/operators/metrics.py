"""Multiclass evaluation from one ``groupBy(label, prediction).count()``.

Rules kept from the usual multiclass-metrics definitions: only true labels are
listed; precision (and F1) is 0.0 for a label that is never predicted;
false-positive rate is NULL when no row has another label (0/0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from multisvm.sources.tables import LABEL

PREDICTION = "prediction"


def confusion(scored: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    """``label, prediction, n``: map-side combined, at most K x K rows out."""
    return scored.groupBy(F.col(label).alias(LABEL), F.col(prediction).alias(PREDICTION)).agg(
        F.count(F.lit(1)).alias("n")
    )


def metrics_by_label(conf: DataFrame) -> DataFrame:
    """Per true label: counts, precision, recall, false-positive rate, F1."""
    hit = F.col(LABEL) == F.col(PREDICTION)
    zero = F.lit(0).cast("long")
    # Each confusion cell counts once for its true label and once for its predicted label.
    roles = conf.select(
        F.explode(
            F.array(
                F.struct(F.col(LABEL).alias("k"), F.col("n").alias("n_true"),
                         F.when(hit, F.col("n")).otherwise(zero).alias("tp"), zero.alias("fp")),
                F.struct(F.col(PREDICTION).alias("k"), zero.alias("n_true"), zero.alias("tp"),
                         F.when(hit, zero).otherwise(F.col("n")).alias("fp")),
            )
        ).alias("r")
    ).select("r.*")
    per = (
        roles.groupBy("k")
        .agg(F.sum("n_true").alias("n_true"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
        .where(F.col("n_true") > 0)
    )
    # At most K rows here, so the global window is one small partition.
    total = F.sum("n_true").over(Window.partitionBy())
    tp, fp, n_true = (F.col(c).cast("double") for c in ("tp", "fp", "n_true"))
    precision = F.when(F.col("tp") + F.col("fp") == 0, F.lit(0.0)).otherwise(tp / (tp + fp))
    recall = tp / n_true
    others = (total - F.col("n_true")).cast("double")
    fpr = F.when(others == 0.0, F.lit(None).cast("double")).otherwise(fp / others)
    out = per.select(
        F.col("k").alias(LABEL),
        F.col("n_true").alias("n_label"),
        F.col("tp"),
        F.col("fp"),
        precision.alias("precision"),
        recall.alias("recall"),
        fpr.alias("false_positive_rate"),
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r == 0.0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r)))


def accuracy_summary(scored: DataFrame, split: str = "split", label: str = LABEL,
                     prediction: str = PREDICTION) -> DataFrame:
    """One row: train and test accuracy and row counts, in a single aggregate."""
    hit = (F.col(label) == F.col(prediction)).cast("long")
    is_train = F.col(split) == F.lit("train")
    n_train = F.sum(is_train.cast("long"))
    n_test = F.sum((~is_train).cast("long"))
    ok_train = F.sum(F.when(is_train, hit).otherwise(0))
    ok_test = F.sum(F.when(~is_train, hit).otherwise(0))
    agg = scored.agg(
        n_train.alias("n_train"), n_test.alias("n_test"),
        ok_train.alias("correct_train"), ok_test.alias("correct_test"),
    )
    return agg.select(
        "n_train", "n_test", "correct_train", "correct_test",
        F.when(F.col("n_train") > 0, F.col("correct_train").cast("double") / F.col("n_train").cast("double"))
        .alias("train_accuracy"),
        F.when(F.col("n_test") > 0, F.col("correct_test").cast("double") / F.col("n_test").cast("double"))
        .alias("test_accuracy"),
    )
