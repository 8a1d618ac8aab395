"""Command-line driver, one sub-command per program:

    python -m multisvm ova  --input data.libsvm [--format libsvm|csv|parquet] ...
    spark-submit multisvm/__main__.py ovo --input hdfs:///data/mnist8m.scale --num-features 784

Loads the labelled table, splits it by hash, trains with the program's
hyper-parameters (overridable), scores both splits and prints the report the
reference programs print: train and test accuracy, load / split / train /
test seconds, average seconds per classifier, then precision, recall,
false-positive rate and F1 per label (``--json`` prints one JSON object).
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

if __package__ in (None, ""):  # run as a file by spark-submit
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="multisvm", description=__doc__.split("\n\n")[0])
    p.add_argument("scheme", choices=["ova", "ovo", "tree"])
    p.add_argument("--input", required=True, help="table path (file or folder)")
    p.add_argument("--format", default="libsvm", choices=["libsvm", "csv", "parquet"])
    p.add_argument("--num-features", type=int, default=None, help="feature width (LibSVM: saves a pass; CSV: required)")
    p.add_argument("--test-input", default=None, help="separate test table (skips the split)")
    p.add_argument("--id-col", default=None, help="parquet: id column (default: generated)")
    p.add_argument("--label-col", default="label")
    p.add_argument("--features-col", default="features")
    p.add_argument("--train-fraction", type=float, default=0.5)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--iterations", type=int, default=None)
    p.add_argument("--step", type=float, default=None)
    p.add_argument("--reg", type=float, default=None)
    p.add_argument("--batch-fraction", type=float, default=None)
    p.add_argument("--batch-mode", choices=["bucket", "row"], default=None,
                   help="mini-batch draws: fixed buckets (default, scan-pruned) or per-row")
    p.add_argument("--kmeans-init", default="k-means||", choices=["k-means||", "random", "first_last"])
    p.add_argument("--checkpoint", choices=["auto", "yes", "no"], default="auto",
                   help="checkpoint parsed training rows to spark.checkpoint.dir (auto: for libsvm/csv)")
    p.add_argument("--master", default=None, help="only when not launched by spark-submit")
    p.add_argument("--json", action="store_true")
    return p


def load(spark, path: str, args):
    from multisvm.sources import labelled, read_labeled_csv, read_libsvm

    if args.format == "libsvm":
        return read_libsvm(spark, path, args.num_features)
    if args.format == "csv":
        if not args.num_features:
            raise SystemExit("--num-features is required for csv")
        return read_labeled_csv(spark, path, args.num_features)
    return labelled(spark.read.parquet(path), args.id_col, args.label_col, args.features_col)


def main(argv=None) -> dict:
    args = build_parser().parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from multisvm.operators.metrics import accuracy_summary, confusion, metrics_by_label
    from multisvm.plans.classifiers import trainer_for
    from multisvm.session import ship_package
    from multisvm.sources import SPLIT, with_split
    from multisvm.sources.tables import vector_width

    builder = SparkSession.builder.appName(f"multisvm-{args.scheme}")
    if args.master:
        builder = builder.master(args.master)
    spark = builder.getOrCreate()
    ship_package(spark)

    t_load = time.perf_counter()
    data = load(spark, args.input, args)
    if args.test_input:
        test = load(spark, args.test_input, args)
        if args.format == "libsvm" and not args.num_features:
            # one width for both files: the larger of the two that were found
            args.num_features = max(vector_width(data) or 0, vector_width(test) or 0)
            data, test = load(spark, args.input, args), load(spark, args.test_input, args)
        data = data.withColumn(SPLIT, F.lit("train")).unionByName(test.withColumn(SPLIT, F.lit("test")))
    t_split = time.perf_counter()
    if not args.test_input:
        data = with_split(data, args.train_fraction, args.seed)
    t_train = time.perf_counter()
    overrides = {k: v for k, v in {"iterations": args.iterations, "step": args.step, "reg": args.reg,
                                   "fraction": args.batch_fraction, "seed": args.seed,
                                   "batch_mode": args.batch_mode}.items() if v is not None}
    kw = {"kmeans_init": args.kmeans_init} if args.scheme == "tree" else {}
    kw["checkpoint"] = args.checkpoint == "yes" or (args.checkpoint == "auto" and args.format != "parquet")
    model = trainer_for(args.scheme, None, **kw, **overrides).fit(data.where(F.col(SPLIT) == "train"))
    t_test = time.perf_counter()
    scored = model.transform(data, keep=["label", SPLIT], labels_only=True).cache()
    summary = accuracy_summary(scored).first()
    by_label = metrics_by_label(confusion(scored.where(F.col(SPLIT) == "test"))).orderBy("label").collect()
    t_end = time.perf_counter()
    report = {
        "scheme": args.scheme,
        "rows": int(summary.n_train + summary.n_test),
        "classifiers": int(model.problems),
        "train_accuracy": summary.train_accuracy,
        "test_accuracy": summary.test_accuracy,
        "load_sec": round(t_split - t_load, 3),
        "split_sec": round(t_train - t_split, 3),
        "train_sec": round(t_test - t_train, 3),
        "test_sec": round(t_end - t_test, 3),
        "avg_sec_per_classifier": round((t_test - t_train) / max(model.problems, 1), 3),
        "by_label": [r.asDict() for r in by_label],
    }
    scored.unpersist()
    if args.json:
        print(json.dumps(report))
    else:
        for key in ("train_accuracy", "test_accuracy", "load_sec", "split_sec", "train_sec", "test_sec",
                    "avg_sec_per_classifier"):
            print(f"{key}: {report[key]}")
        for metric in ("precision", "recall", "false_positive_rate", "f1"):
            print()
            for r in report["by_label"]:
                print(f"{metric}({r['label']}) = {r[metric]}")
    return report


if __name__ == "__main__":
    main()
