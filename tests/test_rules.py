"""Hand-made cases for the decision rules (survey section 4.1, Q1-Q8)."""

import numpy as np

from conftest import frame
from multisvm.operators.clustering import class_cluster_counts, class_to_cluster, cluster_class_order
from multisvm.operators.coding import class_inventory, class_pairs, tree_layout
from multisvm.operators.metrics import confusion, metrics_by_label
from multisvm.plans.classifiers import CodedModel


def _model(scheme, classes, weights, **kw):
    return CodedModel(scheme, classes, np.zeros((len(classes), weights.shape[0])), weights, **kw)


def test_zero_vector_ova_picks_lowest_class(spark):
    df = frame(spark, [(0, 2, [0.0, 0.0])])
    m = _model("ova", [0, 1, 2], np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]))
    assert m.transform(df).first().prediction == 0


def test_zero_margin_is_positive_in_ovo_and_tree(spark):
    df = frame(spark, [(0, 1, [0.0, 0.0])])
    ovo = _model("ovo", [0, 1], np.array([[1.0, 1.0]]), pairs=class_pairs(2))
    assert ovo.transform(df).first().prediction == 0
    nodes = tree_layout([5], [7])
    tree = _model("tree", [5, 7], np.array([[3.0, -2.0]]), nodes=nodes)
    assert tree.transform(df).first().prediction == 5


def test_vote_cycle_goes_to_lowest_label(spark):
    # 3 classes, pairs (0,1) (0,2) (1,2): 0 beats 1, 2 beats 0, 1 beats 2 -> one vote each.
    df = frame(spark, [(0, 0, [1.0])])
    w = np.array([[1.0], [-1.0], [1.0]])
    m = _model("ovo", [4, 5, 6], w, pairs=class_pairs(3))
    row = m.transform(df).first()
    assert row.votes == [1, 1, 1]
    assert row.prediction == 4


def test_label_gap_gives_three_classes(spark):
    df = frame(spark, [(i, lab, [1.0]) for i, lab in enumerate([0, 1, 3, 3])])
    rows = class_inventory(df).orderBy("label").collect()
    assert [(r.label, r.class_index, r.n_rows) for r in rows] == [(0, 0, 1), (1, 1, 1), (3, 2, 2)]


def _c2c(spark, assignments):
    df = spark.createDataFrame(assignments, "label int, cluster int")
    return class_to_cluster(class_cluster_counts(df))


def test_cluster_tie_goes_to_lower_cluster(spark):
    rows = _c2c(spark, [(0, 0), (0, 1), (0, 0), (0, 1)]).collect()
    assert (rows[0].cluster, rows[0].err) == (0, 4)


def test_pure_class_error_is_count_squared_and_sorts_last(spark):
    assign = [(1, 1)] * 5 + [(2, 1)] * 4 + [(2, 0)] * 1 + [(3, 1)] * 3 + [(3, 0)] * 2
    c2c = _c2c(spark, assign)
    got = {r.label: (r.cluster, r.err) for r in c2c.collect()}
    assert got == {1: (1, 25), 2: (1, 1), 3: (1, 4)}
    order = [r.label for r in cluster_class_order(c2c).where("cluster = 1").orderBy("position").collect()]
    assert order == [2, 3, 1]


def test_equal_error_keeps_label_order(spark):
    assign = [(7, 0)] * 3 + [(7, 1)] + [(4, 0)] * 2 + [(4, 1)]
    order = [r.label for r in cluster_class_order(_c2c(spark, assign)).orderBy("position").collect()]
    assert order == [4, 7]


def _by_label(spark, pairs):
    df = spark.createDataFrame(pairs, "label int, prediction int")
    return {r.label: r for r in metrics_by_label(confusion(df)).collect()}


def test_never_predicted_label_has_zero_precision_and_f1(spark):
    m = _by_label(spark, [(0, 1), (1, 1), (1, 1)])
    assert m[0].precision == 0.0 and m[0].f1 == 0.0 and m[0].recall == 0.0
    assert m[1].precision == 2 / 3 and m[1].recall == 1.0


def test_predicted_only_label_is_not_listed(spark):
    m = _by_label(spark, [(0, 2), (1, 1)])
    assert sorted(m) == [0, 1]
    assert m[0].false_positive_rate == 0.0


def test_single_class_false_positive_rate_is_null(spark):
    m = _by_label(spark, [(3, 3), (3, 3)])
    assert m[3].false_positive_rate is None
    assert m[3].precision == 1.0 and m[3].f1 == 1.0


def test_metrics_match_hand_computation(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (2, 2), (2, 2), (2, 1)]
    m = _by_label(spark, pairs)
    # label 2: tp 2, fp 0, n 4 -> precision 1, recall .5; others = 4, fp 0 -> fpr 0
    assert (m[2].precision, m[2].recall, m[2].false_positive_rate) == (1.0, 0.5, 0.0)
    assert m[1].fp == 2 and m[1].false_positive_rate == 2 / 6
    p, r = 2 / 4, 2 / 2
    assert m[1].f1 == 2.0 * p * r / (p + r)


def test_metrics_equal_the_multiclass_yardstick(spark):
    """Spark's own MulticlassMetrics on random predictions, one class never predicted."""
    import random

    from pyspark.mllib.evaluation import MulticlassMetrics
    from multisvm.operators.metrics import accuracy_summary, confusion, metrics_by_label

    rng = random.Random(1)
    rows = [(rng.choice([0, 1, 1, 2, 4]), rng.choice([0, 1, 2, 2]), "test") for _ in range(300)]
    scored = spark.createDataFrame(rows, "label int, prediction int, split string")
    want = MulticlassMetrics(scored.rdd.map(lambda r: (float(r.prediction), float(r.label))))
    for r in metrics_by_label(confusion(scored)).collect():
        k = float(r.label)
        assert abs(r.precision - want.precision(k)) < 1e-12 and abs(r.recall - want.recall(k)) < 1e-12
        assert abs(r.false_positive_rate - want.falsePositiveRate(k)) < 1e-12 and abs(r.f1 - want.fMeasure(k)) < 1e-12
    assert abs(accuracy_summary(scored).first().test_accuracy - want.accuracy) < 1e-12


def test_an_identifier_is_not_taken_for_a_label(spark, monkeypatch):
    import pytest
    from pyspark.sql import functions as F
    from multisvm.operators import coding

    monkeypatch.setattr(coding, "MAX_CLASSES", 5)
    df = spark.range(9).select("id", F.col("id").cast("int").alias("label"), F.array(F.lit(1.0)).alias("features"))
    with pytest.raises(ValueError):
        coding.collect_inventory(df)
