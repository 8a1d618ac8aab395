"""Registered queries: one per operator of the survey's inventory.

Every query reads the driver's parquet tables (``embeddings`` for the
classifiers) and returns a DataFrame; nothing is collected except K-sized
plans and the P x D model. Fixed parameters of the registered queries are the
reference programs' own hyper-parameters; they are listed together below.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from multisvm.operators.clustering import (
    CLUSTER, assign_clusters, class_cluster_counts, class_to_cluster, cluster_class_order, first_last_centres,
    kmeans_fit, lloyd,
)
from multisvm.operators.coding import (
    PairCoding, binarize, class_inventory, code_entries, collect_inventory, one_vs_all_code,
)
from multisvm.operators.metrics import PREDICTION, accuracy_summary, confusion, metrics_by_label
from multisvm.operators.partials import PARTIAL_SCHEMA, SPAN
from multisvm.operators.scoring import MARGINS
from multisvm.operators.trainer import SGDParams, fit_coded, gradient_kernel
from multisvm.plans.classifiers import OVA_DEFAULTS, OVO_DEFAULTS, TREE_DEFAULTS, CodedModel, trainer_for
from multisvm.session import scratch_path, ship_package
from multisvm.sources.csv import read_labeled_csv, write_labeled_csv
from multisvm.sources.libsvm import read_libsvm, write_libsvm
from multisvm.sources.split import SPLIT, with_split
from multisvm.sources.tables import FEATURES, ID, LABEL, dense_array, embeddings, lineitem, part

# Fixed parameters of the registered queries.
SEED = 42
TRAIN_FRACTION = 0.5
PARAMS = {"ova": OVA_DEFAULTS, "ovo": OVO_DEFAULTS, "tree": TREE_DEFAULTS}
BINARY_PARAMS = SGDParams(iterations=250, step=4.0, reg=0.01, fraction=1.0)  # full batch: equals SVMWithSGD
# One-vs-all with per-row mini-batch draws (the default is bucketed draws).
ROW_BATCH_PARAMS = dataclasses.replace(OVA_DEFAULTS, batch_mode="row")
KMEANS_TOL = 1e-4
DIGITS = 6

_MODELS: dict[tuple, CodedModel] = {}


def rounded(col) -> F.Column:
    """Round to DIGITS and fold -0.0 into 0.0 (the oracle does the same)."""
    return F.round(col, DIGITS) + F.lit(0.0)


TABLES = {"embeddings": embeddings, "lineitem": lineitem, "part": part}


def labelled_split(spark: SparkSession, sf_dir: str, table: str = "embeddings") -> DataFrame:
    return with_split(TABLES[table](spark, sf_dir), TRAIN_FRACTION, SEED)


def train_rows(spark: SparkSession, sf_dir: str, table: str = "embeddings") -> DataFrame:
    return labelled_split(spark, sf_dir, table).where(F.col(SPLIT) == "train").drop(SPLIT)


def kmeans_iterations() -> int:
    return TREE_DEFAULTS.iterations  # the reference passes its iteration count to k-means


def table_state(spark: SparkSession, sf_dir: str, table: str) -> tuple:
    """(path, length, modification time) of the table's files: a model is kept
    for these data, not for a path."""
    state = []
    for name in sorted(TABLES[table](spark, sf_dir).inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        state.append((name, found.getLen(), found.getModificationTime()))
    return tuple(state)


def fitted(spark: SparkSession, sf_dir: str, scheme: str, table: str = "embeddings",
           params: SGDParams | None = None) -> CodedModel:
    """Train once per (scheme, table's files, parameters) and keep the P x D model."""
    params = params or PARAMS[scheme]
    key = (scheme, table_state(spark, sf_dir, table), params)
    if key not in _MODELS:
        kw = {}
        if scheme == "tree":
            kw = {"kmeans_init": "first_last", "kmeans_iterations": kmeans_iterations(), "kmeans_tol": KMEANS_TOL}
        _MODELS[key] = trainer_for(scheme, params, **kw).fit(train_rows(spark, sf_dir, table))
    return _MODELS[key]


def weights_frame(spark: SparkSession, weights: np.ndarray, extra: dict[str, list] | None = None) -> DataFrame:
    """Model as long rows (problem, feature, weight) plus per-problem columns:
    one Arrow row a problem on the driver, exploded on Spark."""
    extra = extra or {}
    width = weights.shape[1]
    table = pa.table({
        "problem": pa.array(np.arange(len(weights), dtype=np.int32)),
        **{c: pa.array(v, pa.int32()) for c, v in extra.items()},
        "ws": pa.ListArray.from_arrays(np.arange(len(weights) + 1, dtype=np.int32) * width, pa.array(weights.ravel())),
    })
    long = spark.createDataFrame(table).select("problem", *extra, F.posexplode("ws").alias("feature", "w"))
    return long.select("problem", *extra, "feature", rounded(F.col("w")).alias("weight"))


# ---------------------------------------------------------------- sources

def q_train_test_split(spark, sf_dir):
    return labelled_split(spark, sf_dir).select(ID, LABEL, SPLIT)


def _by_feature(df: DataFrame, *keys: str) -> DataFrame:
    """One scan: count, sum and sum of squares by label and feature index."""
    long = df.select(*keys, LABEL, F.posexplode(dense_array(df)).alias("feature", "v"))
    return long.groupBy(*keys, LABEL, "feature").agg(
        F.count(F.lit(1)).alias("n_rows"),
        rounded(F.sum("v")).alias("sum_values"),
        rounded(F.sum(F.col("v") * F.col("v"))).alias("sum_squares"),
    )


def q_load_libsvm(spark, sf_dir):
    """Write the embeddings as LibSVM text to the shared folder, read it back."""
    path = scratch_path(spark, "libsvm")
    write_libsvm(embeddings(spark, sf_dir), path)
    return _by_feature(read_libsvm(spark, path, num_features=64))


def q_load_labeled_csv(spark, sf_dir):
    """Same round trip through the labelled CSV source (64 fields + label)."""
    path = scratch_path(spark, "csv")
    write_labeled_csv(embeddings(spark, sf_dir), path, 64)
    return _by_feature(read_labeled_csv(spark, path, 64))


def q_load_separate_test(spark, sf_dir):
    """Separate train and test files, read with one width."""
    data, parts = labelled_split(spark, sf_dir), []
    for name in ("train", "test"):
        path = scratch_path(spark, f"libsvm-{name}")
        write_libsvm(data.where(F.col(SPLIT) == name), path)
        parts.append(read_libsvm(spark, path, num_features=64).withColumn(SPLIT, F.lit(name)))
    return _by_feature(parts[0].unionByName(parts[1]), SPLIT)


# ---------------------------------------------------------------- coding

def q_class_inventory(spark, sf_dir):
    return class_inventory(train_rows(spark, sf_dir))


def _binarized(spark, sf_dir, scheme, nodes=(), table="embeddings") -> DataFrame:
    """Targets of every problem, from the table of classes."""
    train = train_rows(spark, sf_dir, table)
    classes = class_inventory(train).select(LABEL, "class_index")
    k = classes.count()
    n_entries = sum(len(n["pos_classes"]) + len(n["neg_classes"]) for n in nodes) if scheme == "tree" else k * k
    return binarize(train, code_entries(classes, k, scheme, nodes), n_entries).select(ID, LABEL, "problem", "y")


def q_binarize_one_vs_rest(spark, sf_dir):
    return _binarized(spark, sf_dir, "ova")


def q_binarize_pair(spark, sf_dir):
    return _binarized(spark, sf_dir, "ovo")


def q_part_binarize_pair(spark, sf_dir):
    return _binarized(spark, sf_dir, "ovo", table="part")


def q_binarize_class_set(spark, sf_dir):
    return _binarized(spark, sf_dir, "tree", fitted(spark, sf_dir, "tree").nodes)


def q_filter_class_set(spark, sf_dir):
    """Rows of the classes on the root's positive side (cluster 1)."""
    model = fitted(spark, sf_dir, "tree")
    members = model.nodes[0]["pos_classes"]
    return train_rows(spark, sf_dir).where(F.col(LABEL).isin(members)).select(ID, LABEL)


# ---------------------------------------------------------------- training

def q_svm_gradient_step(spark, sf_dir):
    """Sub-gradient of every one-vs-all problem at fixed weights that put rows on
    both sides of the hinge, summed by Spark."""
    train = train_rows(spark, sf_dir)
    inv = collect_inventory(train)
    code = one_vs_all_code(inv.k)
    keys = np.arange(inv.k)
    weights = ((np.arange(inv.k)[:, None] * 7 + np.arange(inv.dim)[None, :] * 3) % 11 - 5) * 0.6
    kernel = gradient_kernel(np.asarray(inv.classes), code, weights, keys, inv.dim)
    ship_package(spark)
    parts = train.select(LABEL, FEATURES).mapInArrow(kernel, PARTIAL_SCHEMA)
    return (
        parts.select(F.col("k").alias("problem"), "n", "r", F.posexplode("g").alias("at", "v"))
        .withColumn("feature", F.col("r") * SPAN + F.col("at"))
        .groupBy("problem", "feature")
        .agg(rounded(F.sum("v")).alias("grad"), F.sum("n").alias("n_rows"))
    )


def q_svm_binary(spark, sf_dir):
    """One binary SVM (first class against the rest), full batch."""
    train = train_rows(spark, sf_dir)
    inv = collect_inventory(train)
    code = one_vs_all_code(inv.k)[:, :1]
    res = fit_coded(train, code, inv.classes, inv.dim, BINARY_PARAMS)
    return weights_frame(spark, res.weights).drop("problem")


def q_train_ova(spark, sf_dir):
    m = fitted(spark, sf_dir, "ova")
    return weights_frame(spark, m.weights, {"label": m.classes})


def _train_ovo_query(table="embeddings"):
    def q(spark, sf_dir):
        m = fitted(spark, sf_dir, "ovo", table)
        pos, neg = PairCoding(len(m.classes)).pairs()
        return weights_frame(spark, m.weights, {
            "pos_label": [m.classes[p] for p in pos],
            "neg_label": [m.classes[n] for n in neg],
        })
    return q


def q_train_tree(spark, sf_dir):
    m = fitted(spark, sf_dir, "tree")
    return weights_frame(spark, m.weights).withColumnRenamed("problem", "node")


# ---------------------------------------------------------------- scoring

def scored(spark, sf_dir, scheme: str, split: str | None = None, table: str = "embeddings",
           keep: tuple[str, ...] = (LABEL, SPLIT)) -> DataFrame:
    """Score the labelled rows; a split filter goes below the (opaque) Arrow
    scoring step so the other split is never scored, and only the columns in
    ``keep`` pass through it."""
    m = fitted(spark, sf_dir, scheme, table)
    rows = labelled_split(spark, sf_dir, table)
    if split is not None:
        rows = rows.where(F.col(SPLIT) == split)
    return m.transform(rows, keep=keep, labels_only=True)


def q_ova_margins(spark, sf_dir):
    m = fitted(spark, sf_dir, "ova")
    df = m.margins(labelled_split(spark, sf_dir), keep=[ID])
    return df.select(ID, F.posexplode(MARGINS).alias("problem", "m")).select(
        ID, "problem", rounded(F.col("m")).alias("margin"))


def _score_query(scheme, table="embeddings"):
    def q(spark, sf_dir):
        return scored(spark, sf_dir, scheme, table=table, keep=(ID, LABEL, SPLIT))
    return q


def _votes_query(table="embeddings"):
    def q(spark, sf_dir):
        m = fitted(spark, sf_dir, "ovo", table)
        votes = m.margins(labelled_split(spark, sf_dir, table), keep=[ID], emit_margins=False)
        classes = F.array(*[F.lit(int(c)) for c in m.classes])
        return votes.select(ID, F.posexplode("votes").alias("pos", "votes")).select(
            ID, F.element_at(classes, F.col("pos") + 1).alias("class"), F.col("votes").cast("long").alias("votes"))
    return q


# ---------------------------------------------------------------- clustering

def _lloyd_centres(spark, sf_dir) -> np.ndarray:
    key = ("lloyd", table_state(spark, sf_dir, "embeddings"), kmeans_iterations(), KMEANS_TOL)
    if key not in _MODELS:
        train = train_rows(spark, sf_dir)
        _MODELS[key] = lloyd(train, first_last_centres(train), kmeans_iterations(), KMEANS_TOL)[0]
    return _MODELS[key]


def q_kmeans_lloyd(spark, sf_dir):
    c = _lloyd_centres(spark, sf_dir)
    return weights_frame(spark, c).withColumnsRenamed({"problem": CLUSTER, "weight": "centre"})


def q_kmeans_parallel(spark, sf_dir):
    """Centres of k-means from the k-means|| start (no SQL: its draws are Spark's)."""
    c = kmeans_fit(train_rows(spark, sf_dir), 2, kmeans_iterations(), SEED, "k-means||", KMEANS_TOL)
    return weights_frame(spark, c).withColumnsRenamed({"problem": CLUSTER, "weight": "centre"})


def _assigned(spark, sf_dir) -> DataFrame:
    return assign_clusters(train_rows(spark, sf_dir), _lloyd_centres(spark, sf_dir), [ID, LABEL])


def q_kmeans_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select(ID, CLUSTER)


def q_kmeans_cost(spark, sf_dir):
    return _assigned(spark, sf_dir).agg(rounded(F.sum("distance")).alias("cost"), F.count(F.lit(1)).alias("n_rows"))


def q_class_cluster_counts(spark, sf_dir):
    return class_cluster_counts(_assigned(spark, sf_dir))


def q_class_to_cluster(spark, sf_dir):
    return class_to_cluster(class_cluster_counts(_assigned(spark, sf_dir)))


def q_cluster_class_order(spark, sf_dir):
    return cluster_class_order(class_to_cluster(class_cluster_counts(_assigned(spark, sf_dir))))


def q_tree_layout(spark, sf_dir):
    m = fitted(spark, sf_dir, "tree")
    rows = [(n["node"], n["pos_child"], n["neg_child"], n["pos_label"], n["neg_label"],
             len(n["pos_classes"]), len(n["neg_classes"])) for n in m.nodes]
    return spark.createDataFrame(
        rows, "node int, pos_child int, neg_child int, pos_label int, neg_label int, n_pos int, n_neg int")


# ---------------------------------------------------------------- evaluation

def _confusion_query(scheme):
    def q(spark, sf_dir):
        return confusion(scored(spark, sf_dir, scheme, "test"))
    return q


def _by_label_query(scheme):
    def q(spark, sf_dir):
        return metrics_by_label(confusion(scored(spark, sf_dir, scheme, "test")))
    return q


def _summary_query(scheme, table="embeddings"):
    def q(spark, sf_dir):
        return accuracy_summary(scored(spark, sf_dir, scheme, table=table))
    return q


def q_lineitem_train_ova(spark, sf_dir):
    m = fitted(spark, sf_dir, "ova", "lineitem")
    return weights_frame(spark, m.weights, {"label": m.classes})


def q_lineitem_train_ova_row_batches(spark, sf_dir):
    m = fitted(spark, sf_dir, "ova", "lineitem", ROW_BATCH_PARAMS)
    return weights_frame(spark, m.weights, {"label": m.classes})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "train_test_split": q_train_test_split,
    "load_libsvm": q_load_libsvm,
    "load_labeled_csv": q_load_labeled_csv,
    "load_separate_test": q_load_separate_test,
    "class_inventory": q_class_inventory,
    "binarize_one_vs_rest": q_binarize_one_vs_rest,
    "binarize_pair": q_binarize_pair,
    "binarize_class_set": q_binarize_class_set,
    "filter_class_set": q_filter_class_set,
    "svm_gradient_step": q_svm_gradient_step,
    "svm_binary": q_svm_binary,
    "train_ova": q_train_ova,
    "ova_margins": q_ova_margins,
    "score_ova": _score_query("ova"),
    "ova_confusion_matrix": _confusion_query("ova"),
    "ova_metrics_by_label": _by_label_query("ova"),
    "ova_metrics_summary": _summary_query("ova"),
    "train_ovo": _train_ovo_query(),
    "ovo_votes": _votes_query(),
    "score_ovo": _score_query("ovo"),
    "ovo_confusion_matrix": _confusion_query("ovo"),
    "ovo_metrics_by_label": _by_label_query("ovo"),
    "ovo_metrics_summary": _summary_query("ovo"),
    "kmeans_lloyd": q_kmeans_lloyd,
    "kmeans_parallel": q_kmeans_parallel,
    "kmeans_assign": q_kmeans_assign,
    "kmeans_cost": q_kmeans_cost,
    "class_cluster_counts": q_class_cluster_counts,
    "class_to_cluster": q_class_to_cluster,
    "cluster_class_order": q_cluster_class_order,
    "tree_layout": q_tree_layout,
    "train_tree": q_train_tree,
    "score_tree": _score_query("tree"),
    "tree_confusion_matrix": _confusion_query("tree"),
    "tree_metrics_by_label": _by_label_query("tree"),
    "tree_metrics_summary": _summary_query("tree"),
    # The one-vs-all program on the largest driver table (scaled numeric columns).
    "lineitem_train_ova": q_lineitem_train_ova,
    "lineitem_ova_metrics_summary": _summary_query("ova", "lineitem"),
    "lineitem_train_ova_row_batches": q_lineitem_train_ova_row_batches,
    "lineitem_ovo_metrics_summary": _summary_query("ovo", "lineitem"),
    "lineitem_tree_metrics_summary": _summary_query("tree", "lineitem"),
    # Many classes: the 25 brands of part, 300 pairs and a tree of 24 nodes.
    "part_binarize_pair": q_part_binarize_pair,
    "part_train_ovo": _train_ovo_query("part"),
    "part_ovo_votes": _votes_query("part"),
    "part_score_ovo": _score_query("ovo", "part"),
    "part_score_tree": _score_query("tree", "part"),
    # The survey's generic names (EVL-1..8, SNK-1/2) for the flagship one-vs-all program.
    "confusion_matrix": _confusion_query("ova"),
    "metrics_by_label": _by_label_query("ova"),
    "metrics_summary": _summary_query("ova"),
}
