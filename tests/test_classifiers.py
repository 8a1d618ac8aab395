"""Separable blobs: all three schemes learn them (accuracy claims belong here,
not on the weak-signal driver tables)."""

import math

import pytest

from conftest import frame
from multisvm import ClusterTree, OneVsAll, OneVsOne, SGDParams
from multisvm.operators.metrics import accuracy_summary
from multisvm.sources import with_split


@pytest.fixture(scope="module")
def blobs(spark):
    # 4 classes at the corners of a square, 50 rows each, plus a constant-1 feature.
    centres = [(3.0, 3.0), (-3.0, 3.0), (-3.0, -3.0), (3.0, -3.0)]
    rows = []
    for c, (cx, cy) in enumerate(centres):
        for i in range(50):
            a = 2 * math.pi * i / 50
            r = 0.3 + 0.5 * ((i * 7) % 11) / 11
            rows.append((c * 50 + i, c, [cx + r * math.cos(a), cy + r * math.sin(a), 1.0]))
    return with_split(frame(spark, rows)).cache()


@pytest.mark.parametrize("cls", [OneVsAll, OneVsOne, ClusterTree])
def test_blobs_are_learned(blobs, cls):
    params = SGDParams(iterations=40, step=1.0, reg=0.001, fraction=1.0)
    model = cls(params).fit(blobs.where("split = 'train'"))
    acc = accuracy_summary(model.transform(blobs)).first()
    assert acc.train_accuracy == 1.0 and acc.test_accuracy == 1.0


def test_tree_plan_separates_clusters(blobs):
    tree = ClusterTree(SGDParams(iterations=20, step=1.0, reg=0.001))
    centres, triples, nodes, classes = tree.plan(blobs)
    assert classes == [0, 1, 2, 3] and len(nodes) == 3
    assert sorted(nodes[0]["pos_classes"] + nodes[0]["neg_classes"]) == [0, 1, 2, 3]
    assert all(err > 0 for _, _, err in triples)


def test_prediction_independent_of_partitioning(blobs):
    m = OneVsOne(SGDParams(iterations=10, step=1.0, reg=0.001)).fit(blobs)
    a = {r.id: r.prediction for r in m.transform(blobs.coalesce(1)).collect()}
    b = {r.id: r.prediction for r in m.transform(blobs.repartition(7)).collect()}
    assert a == b


def test_ovo_votes_sum_to_pair_count(blobs):
    from pyspark.sql import functions as F

    m = OneVsOne(SGDParams(iterations=5, step=1.0, reg=0.001)).fit(blobs)
    out = m.transform(blobs).select(F.aggregate("votes", F.lit(0), lambda a, v: a + v).alias("s"))
    assert {r.s for r in out.collect()} == {6}


def test_kmeans_spark_ml_init_also_works(blobs):
    tree = ClusterTree(SGDParams(iterations=10, step=1.0, reg=0.001), kmeans_init="k-means||")
    model = tree.fit(blobs)
    assert model.centres.shape == (2, 3) and len(model.nodes) == 3


def test_streaming_scoring(spark, blobs, tmp_path):
    from multisvm.streaming import score_stream

    m = OneVsAll(SGDParams(iterations=20, step=1.0, reg=0.001)).fit(blobs)
    src = str(tmp_path / "in")
    blobs.select("id", "label", "features").write.parquet(src)
    stream = spark.readStream.schema("id long, label int, features array<double>").parquet(src)
    q = (score_stream(m, stream, keep=["id", "label"]).writeStream.format("memory")
         .queryName("scored_blobs").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT count(*) AS n, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS ok FROM scored_blobs").first()
    assert got.n == 200 and got.ok == 200


def test_ovo_transform_without_margins(blobs):
    m = OneVsOne(SGDParams(iterations=5, step=1.0, reg=0.001)).fit(blobs)
    full = {r.id: r.prediction for r in m.transform(blobs).collect()}
    lean = m.transform(blobs, keep=["id"], margins=False)
    assert lean.columns == ["id", "votes", "prediction"]
    assert {r.id: r.prediction for r in lean.collect()} == full


@pytest.mark.parametrize("scheme", [OneVsAll, OneVsOne, ClusterTree])
def test_labels_decoded_in_the_kernel_equal_the_column_decoders(blobs, scheme):
    m = scheme(SGDParams(iterations=3, step=1.0, reg=0.001)).fit(blobs)
    full = {r.id: r.prediction for r in m.transform(blobs).collect()}
    lean = m.transform(blobs, keep=["id"], labels_only=True)
    assert lean.columns == ["id", "prediction"]
    assert {r.id: r.prediction for r in lean.collect()} == full
