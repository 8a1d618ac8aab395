"""Bench: the reference's three programs end to end on the driver's tables.

Each headline query loads ``embeddings`` (``*_lineitem``: the scaled
numeric columns of ``lineitem``, the largest table), splits it 50/50 by hash, trains with
the reference program's hyper-parameters, scores both splits and computes the
test metrics by label plus the train/test accuracy (all results collected).

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_YARDSTICK=0 to skip timing real problems of every scheme with Spark's
SVMWithSGD (the reference trains every binary problem that way, one after
another, on the rows of its classes),
BENCH_EVENT_LOG_DIR to write Spark's event log (stage and task times) there.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    yardstick = os.environ.get("BENCH_YARDSTICK", "1") != "0"
    event_dir = os.environ.get("BENCH_EVENT_LOG_DIR")  # optional: Spark event log for stage/task times

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    builder = SparkSession.builder
    if event_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_dir)
    spark = (
        builder.master(f"local[{cpus}]")
        .appName("multisvm-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from multisvm.operators.metrics import accuracy_summary, confusion, metrics_by_label
    from multisvm.plans.classifiers import OVA_DEFAULTS, OVO_DEFAULTS, TREE_DEFAULTS, trainer_for
    from multisvm.sources import SPLIT, embeddings, lineitem, with_split

    params = {"ova": OVA_DEFAULTS, "ovo": OVO_DEFAULTS, "tree": TREE_DEFAULTS}
    timings: dict[str, float] = {}
    extra: dict[str, object] = {}

    def run(scheme: str, table: str = "embeddings", override=None, suffix: str = "") -> None:
        name = (scheme if table == "embeddings" else f"{scheme}_{table}") + suffix
        p = override or params[scheme]
        start = time.perf_counter()
        data = with_split({"embeddings": embeddings, "lineitem": lineitem}[table](spark, sf_dir))
        train = data.where(F.col(SPLIT) == "train").drop(SPLIT)
        kw = {"kmeans_init": "first_last"} if scheme == "tree" else {}
        model = trainer_for(scheme, p, **kw).fit(train)
        trained = time.perf_counter()
        scored = model.transform(data, keep=["label", SPLIT], labels_only=True).cache()
        by_label = metrics_by_label(confusion(scored.where(F.col(SPLIT) == "test"))).collect()
        summary = accuracy_summary(scored).first()  # reuses the cached scores
        scored.unpersist()
        end = time.perf_counter()
        timings[name] = round(end - start, 3)
        hist = model.fit.history
        extra[f"{name}_train_sec"] = round(trained - start, 3)
        extra[f"{name}_score_eval_sec"] = round(end - trained, 3)
        extra[f"{name}_problems"] = int(model.problems)
        extra[f"{name}_iterations"] = len(hist)
        extra[f"{name}_sec_per_iteration"] = round(sum(hist) / max(len(hist), 1), 4)
        extra[f"{name}_rows"] = int(summary.n_train + summary.n_test)
        # rows entering the gradient kernel per second of iteration time (batch rows x iterations)
        batch_rows = summary.n_train * min(1.0, p.fraction) * len(hist)
        extra[f"{name}_batch_rows_per_sec"] = round(batch_rows / max(sum(hist), 1e-9), 1)
        extra[f"{name}_test_accuracy"] = summary.test_accuracy
        extra[f"{name}_train_accuracy"] = summary.train_accuracy
        extra[f"{name}_labels"] = len(by_label)

    for scheme in ("ova", "ovo", "tree"):
        run(scheme)
    for scheme in ("ova", "ovo", "tree"):
        run(scheme, "lineitem")

    # One binary problem (the first class against the rest), full batch.
    from multisvm.operators.coding import collect_inventory, one_vs_all_code
    from multisvm.operators.trainer import fit_coded
    from multisvm.plans.queries import BINARY_PARAMS, train_rows

    start = time.perf_counter()
    train = train_rows(spark, sf_dir).cache()
    inv = collect_inventory(train)
    res = fit_coded(train, one_vs_all_code(inv.k)[:, :1], inv.classes, inv.dim, BINARY_PARAMS)
    timings["svm_binary"] = round(time.perf_counter() - start, 3)
    extra["svm_binary_iterations"] = len(res.history)
    train.unpersist()

    # LibSVM text in: sparse vectors through the same trainer (40 iterations).
    from multisvm.session import scratch_path
    from multisvm.sources.libsvm import read_libsvm, write_libsvm

    path = scratch_path(spark, "bench-libsvm")
    write_libsvm(embeddings(spark, sf_dir), path)
    start = time.perf_counter()
    model = trainer_for("ova", OVA_DEFAULTS, iterations=40).fit(read_libsvm(spark, path, num_features=64))
    timings["ova_libsvm"] = round(time.perf_counter() - start, 3)
    extra["ova_libsvm_sec_per_iteration"] = round(sum(model.fit.history) / max(1, len(model.fit.history)), 4)

    if yardstick:
        # The reference's way: one SVMWithSGD per binary problem, one after
        # another, each on the rows of its own classes; two real problems of
        # every scheme are timed and scaled by the number of problems.
        from pyspark.mllib.classification import SVMWithSGD
        from pyspark.mllib.linalg import Vectors
        from pyspark.mllib.regression import LabeledPoint

        rows = train_rows(spark, sf_dir).select("label", F.col("features").cast("array<double>").alias("f")).rdd.cache()
        rows.count()

        def one(positive: list[int], negative: list[int] | None, p) -> float:
            pos, neg = set(positive), None if negative is None else set(negative)
            points = rows.filter(lambda r: neg is None or r.label in pos or r.label in neg).map(
                lambda r: LabeledPoint(1.0 if r.label in pos else 0.0, Vectors.dense(r.f))).cache()
            points.count()
            start = time.perf_counter()
            SVMWithSGD.train(points, iterations=p.iterations, step=p.step, regParam=p.reg, miniBatchFraction=p.fraction)
            took = time.perf_counter() - start
            points.unpersist()
            return took

        k = list(inv.classes)
        half = (len(k) + 1) // 2
        problems = {
            "ova": [(k[:1], None), (k[-1:], None)],
            "ovo": [(k[:1], k[1:2]), (k[-2:-1], k[-1:])],
            "tree": [(k[:half], k[half:]), (k[:1], k[1:2])],
        }
        for scheme, parts in problems.items():
            each = [one(a, b, params[scheme]) for a, b in parts]
            extra[f"yardstick_{scheme}_problem_sec"] = [round(x, 3) for x in each]
            extra[f"yardstick_{scheme}_train_estimate_sec"] = round(sum(each) / len(each) * extra[f"{scheme}_problems"], 1)
        extra["yardstick_svm_binary_sec"] = round(one(k[:1], None, BINARY_PARAMS), 3)
        rows.unpersist()

    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {
        "metric": "total_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": m.group(1) if m else sf_dir,
        "cpus": cpus,
        **extra,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
