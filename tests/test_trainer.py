"""Trainer against Spark's own SVMWithSGD (the yardstick) and against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, frame
from multisvm.operators.coding import collect_inventory, one_vs_all_code
from multisvm.operators.trainer import SGDParams, fit_coded
from multisvm.sources import embeddings, train_test_split


def _numpy_sgd(x, s, iters, step, reg, tol=0.001):
    w = np.zeros((s.shape[1], x.shape[1]))
    done = np.zeros(s.shape[1], bool)
    first = np.ones(s.shape[1], bool)
    for t in range(1, iters + 1):
        for p in np.flatnonzero(~done):
            y = s[:, p]
            use = y != 0
            act = use & (y * (x @ w[p]) < 1.0)
            g = -(y[act][:, None] * x[act]).sum(0)
            eta = step / np.sqrt(t)
            old = w[p].copy()
            w[p] = old * (1 - eta * reg) + (-eta) * (g / use.sum())
            if not first[p] and np.linalg.norm(w[p] - old) < tol * max(np.linalg.norm(w[p]), 1.0):
                done[p] = True
            first[p] = False
    return w


@pytest.fixture(scope="module")
def train(spark):
    tr, _ = train_test_split(embeddings(spark, SF_SMALL))
    return tr.cache()


def test_all_classes_equal_numpy(train):
    inv = collect_inventory(train)
    code = one_vs_all_code(inv.k)
    res = fit_coded(train, code, inv.classes, inv.dim, SGDParams(iterations=8, step=40.0, reg=0.01))
    pdf = train.toPandas()
    x = np.stack(pdf.features.values).astype(np.float64)
    idx = np.searchsorted(np.array(inv.classes), pdf.label.values)
    w = _numpy_sgd(x, code[idx], 8, 40.0, 0.01)
    assert np.abs(res.weights - w).max() < 1e-12


def test_partitioning_does_not_change_weights(train):
    inv = collect_inventory(train)
    code = one_vs_all_code(inv.k)
    p = SGDParams(iterations=5, step=40.0, reg=0.01, fraction=0.5, seed=3)
    a = fit_coded(train.coalesce(1), code, inv.classes, inv.dim, p).weights
    b = fit_coded(train.repartition(5), code, inv.classes, inv.dim, p).weights
    assert np.abs(a - b).max() < 1e-12


def test_yardstick_svm_with_sgd(spark, train):
    """Full batch: one problem equals pyspark.mllib SVMWithSGD (no intercept)."""
    from pyspark.mllib.classification import SVMWithSGD
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.regression import LabeledPoint

    inv = collect_inventory(train)
    cls = inv.classes[1]
    rows = train.select("label", F.col("features").cast("array<double>").alias("f")).collect()
    rdd = spark.sparkContext.parallelize(
        [LabeledPoint(1.0 if r.label == cls else 0.0, Vectors.dense(r.f)) for r in rows], 2).cache()
    code = one_vs_all_code(inv.k)[:, 1:2]
    for iters, step in ((8, 40.0), (60, 4.0)):
        ref = SVMWithSGD.train(rdd, iterations=iters, step=step, regParam=0.01, miniBatchFraction=1.0)
        ours = fit_coded(train, code, inv.classes, inv.dim, SGDParams(iterations=iters, step=step, reg=0.01))
        assert abs(ref.intercept) == 0.0
        assert np.abs(ours.weights[0] - ref.weights.toArray()).max() < 1e-9


def test_empty_batch_skips_update(spark):
    df = frame(spark, [(i, i % 2, [1.0, float(i)]) for i in range(4)])
    res = fit_coded(df, one_vs_all_code(2), [0, 1], 2,
                    SGDParams(iterations=3, step=1.0, fraction=1e-9, batch_mode="row"))
    assert (res.weights == 0).all() and (res.iterations == 0).all()


@pytest.mark.parametrize("groups", [1, 2])
def test_spark_side_reduction_equals_driver_sum(train, monkeypatch, groups):
    """Above the driver bound a Spark-side level sums groups of partitions first."""
    import multisvm.operators.partials as partials

    inv = collect_inventory(train)
    code = one_vs_all_code(inv.k)
    p = SGDParams(iterations=4, step=40.0, reg=0.01, fraction=0.5, seed=9)
    data = train.repartition(5)
    a = fit_coded(data, code, inv.classes, inv.dim, p).weights
    monkeypatch.setattr(partials, "DRIVER_SUM_LIMIT", groups * inv.k * inv.dim)
    b = fit_coded(data, code, inv.classes, inv.dim, p).weights
    assert np.abs(a - b).max() < 1e-12


def test_problem_blocks_give_the_same_weights(spark, train):
    from multisvm.operators.coding import collect_inventory, one_vs_one_code
    from multisvm.operators.trainer import SGDParams, fit_coded

    inv = collect_inventory(train)
    code, p = one_vs_one_code(inv.k), SGDParams(iterations=4, step=4.0, fraction=0.5)
    whole = fit_coded(train, code, inv.classes, inv.dim, p).weights
    blocks = fit_coded(train, code, inv.classes, inv.dim, p, block_bytes=8 * inv.dim * 7).weights
    assert np.abs(whole - blocks).max() < 1e-12


def test_broadcast_weights_give_the_same_weights(spark, train, monkeypatch):
    import multisvm.operators.trainer as tr
    from multisvm.operators.coding import collect_inventory, one_vs_all_code

    inv = collect_inventory(train)
    code, p = one_vs_all_code(inv.k), tr.SGDParams(iterations=3, fraction=0.5)
    a = tr.fit_coded(train, code, inv.classes, inv.dim, p).weights
    monkeypatch.setattr(tr, "CLOSURE_BYTES", 0)
    assert np.abs(a - tr.fit_coded(train, code, inv.classes, inv.dim, p).weights).max() < 1e-12


def test_sparse_code_kernel_equals_dense_product(spark, train):
    """Grouped-by-class kernel (one-vs-one code) equals the plain all-columns product."""
    import pyarrow as pa

    from multisvm.operators.coding import one_vs_one_code
    from multisvm.operators.trainer import gradient_kernel

    pdf = train.toPandas()
    classes = np.array(sorted(set(pdf.label)))
    x = np.stack(pdf.features.values).astype(np.float64)
    code = one_vs_one_code(len(classes))
    rng = np.random.default_rng(1)
    keys = np.arange(0, code.shape[1], 2)
    w = rng.normal(0, 3, (len(keys), x.shape[1]))
    batch = pa.RecordBatch.from_pydict({
        "label": pa.array(pdf.label.values, pa.int32()),
        "features": pa.array([list(r) for r in pdf.features.values], pa.list_(pa.float32())),
    })
    out = next(gradient_kernel(classes, code, w, keys, x.shape[1])([batch]))
    got = np.stack(out.column("g").to_numpy(zero_copy_only=False))
    y = code[np.searchsorted(classes, pdf.label.values)][:, keys]
    act = np.where(y * (x @ w.T) < 1.0, y, 0.0)
    assert np.array_equal(got, -(act.T @ x))
    assert out.column("n").to_pylist() == list(np.count_nonzero(y, axis=0))


def test_layout_has_more_even_partitions_than_buckets(spark):
    from multisvm.operators.trainer import BUCKET, SGDParams, cache_rows, relayout
    from multisvm.functions.hashing import bucket_run
    from pyspark.sql import functions as F

    n, target = 60_000, 48
    df = spark.range(n).select("id", (F.col("id") % 3).cast("int").alias("label"), F.array(F.lit(1.0)).alias("features"))
    p = SGDParams(fraction=0.25, buckets=16)
    cached = cache_rows(df)
    cached.count()
    laid = relayout(cached, n, params=p, target=target)
    assert laid.rdd.getNumPartitions() == target
    per = laid.groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
    assert len(per) == target and per.max() / per.mean() < 1.3
    batch = laid.where(bucket_run(BUCKET, 3, p.bucket_width, p.n_buckets))
    assert batch.select(F.spark_partition_id().alias("p")).distinct().count() == target
    laid.unpersist()


def test_partition_count_follows_the_size():
    from multisvm.operators.trainer import wanted_partitions

    assert wanted_partitions(10, 100_000_000_000, 1000, 784) > 1_000_000
    assert wanted_partitions(64, 200, 8, 64) == 1


@pytest.mark.parametrize("fraction", [0.25, 0.0001, 0.003])
def test_small_fractions_are_honoured(fraction):
    from multisvm.operators.trainer import SGDParams

    p = SGDParams(fraction=fraction)
    assert abs(p.bucket_width / p.n_buckets / fraction - 1) < 0.02


def test_bucket_batches_learn_like_row_draws(spark):
    from multisvm import ClusterTree, OneVsAll, OneVsOne
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    rows = [(i, i % 4, (rng.normal(0, 0.3, 6) + 3 * np.eye(6)[i % 4]).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    for scheme in (OneVsAll, OneVsOne, ClusterTree):
        for mode in ("bucket", "row"):
            m = scheme(iterations=15, batch_mode=mode).fit(df)
            hit = m.transform(df, labels_only=True).where(F.col("label") == F.col("prediction")).count()
            assert hit >= 396, (scheme.__name__, mode, hit)


def test_what_one_task_reads_is_bounded():
    """A large table of few features is neither gathered in one task nor left in a few partitions."""
    from multisvm.operators.trainer import fits_one_task, wanted_partitions

    assert fits_one_task(300_000, 4, 3, 0.25)
    assert not fits_one_task(3_000_000, 4, 3, 0.25)  # half of lineitem at 1 GB, some 300 MB of rows
    for rows in (3_000_000, 18_000_000, 180_000_000):
        assert rows / wanted_partitions(1, rows, 12, 4) <= 1_500_000
        assert rows / wanted_partitions(12, rows, 12, 4) <= 1_500_000
