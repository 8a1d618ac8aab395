"""Bucketed mini-batches: the range test, the batches, and training."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from multisvm.functions.hashing import bucket_of, bucket_offset, bucket_run


@pytest.mark.parametrize("buckets,width", [(16, 4), (16, 15), (7, 3), (8, 8)])
def test_bucket_run_equals_modular_window(spark, buckets, width):
    df = spark.range(buckets).withColumnRenamed("id", "b")
    for offset in range(buckets):
        got = sorted(r.b for r in df.where(bucket_run(F.col("b"), offset, width, buckets)).collect())
        want = sorted(b for b in range(buckets) if (b - offset) % buckets < width)
        assert got == want


def test_bucket_of_matches_python_md5(spark):
    df = spark.range(50).select(F.col("id"), bucket_of(42, F.col("id"), 64).alias("b"))
    for r in df.collect():
        assert r.b == int(hashlib.md5(f"42:bucket:{r.id}".encode()).hexdigest()[:8], 16) % 64
    assert bucket_offset(42, 3, 64) == int(hashlib.md5(b"42:3").hexdigest()[:8], 16) % 64


def test_bucketed_training_equals_numpy_simulation(spark):
    from multisvm import OneVsAll, SGDParams
    from multisvm.sources import embeddings, train_test_split

    train, _ = train_test_split(embeddings(spark, SF_SMALL))
    p = SGDParams(iterations=6, step=40.0, reg=0.01, fraction=0.25, batch_mode="bucket", buckets=32, tol=0.0)
    model = OneVsAll(p).fit(train)
    pdf = train.toPandas()
    x = np.stack(pdf.features.values).astype(np.float64)
    classes = np.array(sorted(set(pdf.label)))
    s = np.where(pdf.label.values[:, None] == classes[None, :], 1.0, -1.0)
    bucket = np.array([int(hashlib.md5(f"42:bucket:{i}".encode()).hexdigest()[:8], 16) % 32 for i in pdf.id])
    w = np.zeros((len(classes), x.shape[1]))
    for t in range(1, 7):
        off = int(hashlib.md5(f"42:{t}".encode()).hexdigest()[:8], 16) % 32
        use = (bucket - off) % 32 < 8
        if not use.any():
            continue
        xb, sb = x[use], s[use]
        act = np.where(sb * (xb @ w.T) < 1.0, sb, 0.0)
        eta = 40.0 / np.sqrt(t)
        w = w * (1 - eta * 0.01) + (-eta) * (-(act.T @ xb) / use.sum())
    assert np.abs(model.weights - w).max() < 1e-12


def test_bucketed_cache_scan_is_pruned(spark):
    """The iteration filter reaches the in-memory scan as a range predicate."""
    import io
    from contextlib import redirect_stdout

    from multisvm.operators.trainer import BUCKET, SGDParams, cache_rows, relayout

    df = spark.range(4000).select(F.col("id"), (F.col("id") % 3).cast("int").alias("label"),
                                  F.array(F.rand(1)).alias("features"))
    p = SGDParams(fraction=0.25, buckets=64)
    cached = cache_rows(df)
    cached.count()
    laid = relayout(cached, 4000, params=p)
    q = laid.where(bucket_run(F.col(BUCKET), 10, p.bucket_width, p.n_buckets))
    buf = io.StringIO()
    with redirect_stdout(buf):
        q.explain()
    plan = buf.getvalue()
    assert "InMemoryTableScan" in plan and f"{BUCKET}" in plan.split("InMemoryTableScan", 1)[1]
    laid.unpersist()


def test_expression_forms_equal_column_forms(spark):
    from multisvm.functions.hashing import in_fraction, in_fraction_expr

    df = spark.range(300).withColumn("b", (F.col("id") % 16).cast("int"))
    for off in (0, 5, 13):
        a = {r.id for r in df.where(bucket_run("b", off, 6, 16)).collect()}
        b = {r.id for r in df.where(bucket_run(F.col("b"), off, 6, 16)).collect()}
        assert a == b and a
    a = {r.id for r in df.where(in_fraction_expr("42:3", "id", 0.3)).collect()}
    b = {r.id for r in df.where(in_fraction("42:3", F.col("id"), 0.3)).collect()}
    assert a == b and 0 < len(a) < 300
