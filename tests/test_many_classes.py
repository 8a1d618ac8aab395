"""Many classes and features: codes without matrices, scoring in tiles, sums by
feature range, steps inside one task."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import functions as F

from conftest import SF_SMALL, frame
from multisvm import ClusterTree, OneVsAll, OneVsOne, SGDParams
from multisvm.operators import coding, partials, scoring, trainer
from multisvm.operators.blocks import SparseRows
from multisvm.operators.clustering import assign_clusters, first_last_centres, kmeans_fit, lloyd
from multisvm.operators.coding import (
    MatrixCoding, OneVsAllCoding, PairCoding, TreeCoding, class_inventory, class_pairs, code_entries, code_table, collect_inventory,
    one_vs_all_code, one_vs_one_code, tree_code, tree_layout,
)
from multisvm.operators.scoring import ProblemBlocks, best_problem, count_votes, pair_votes, score_kernel, tree_links, walk_tree
from multisvm.operators.trainer import State, fit_coded, hinge_sums
from multisvm.sources import embeddings, train_test_split


@pytest.mark.parametrize("k", [1, 2, 3, 7, 12])
def test_codings_equal_their_matrices(k):
    nodes = tree_layout(list(range(k // 3)), list(range(k // 3, k)))
    classes = list(range(k))
    for code, want in ((OneVsAllCoding(k), one_vs_all_code(k)), (PairCoding(k), one_vs_one_code(k)), (TreeCoding(nodes, classes), tree_code(nodes, classes))):
        assert np.array_equal(code.matrix(), want) and (code.k, code.p) == want.shape
        assert np.array_equal(MatrixCoding(want).matrix(), want)
    pairs = PairCoding(k)
    assert list(zip(*map(list, pairs.pairs()))) == class_pairs(k)
    for lo in range(pairs.p + 1):
        for hi in range(lo, pairs.p + 1):
            flat = [(p, n + i) for p, n, a, b in pairs.runs(lo, hi) for i in range(b - a)]
            assert flat == class_pairs(k)[lo:hi]


def test_code_entries_on_spark_equal_the_code(spark):
    labels = [-70_000, -3, 0, 5, 65_535, 65_536, 2_000_000_000]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(labels * 3)], "id long, label int")
    classes = class_inventory(df)
    assert [(r.label, r.class_index, r.n_rows) for r in classes.orderBy("label").collect()] == [(c, i, 3) for i, c in enumerate(labels)]
    nodes = tree_layout([0, -70_000, 65_536], [5, 2_000_000_000, 65_535, -3])
    for scheme, code in (("ova", OneVsAllCoding(7)), ("ovo", PairCoding(7)), ("tree", TreeCoding(nodes, labels))):
        got = code_entries(classes, 7, scheme, nodes if scheme == "tree" else ())
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, code_table(spark, code, labels).collect())), scheme
    one = spark.createDataFrame([(0, 4)], "id long, label int")
    assert code_entries(class_inventory(one), 1, "ovo").count() == 0 and code_entries(class_inventory(one), 1, "tree").count() == 0


def test_a_thousand_classes_pairwise_within_a_gigabyte():
    """499,500 problems: entries, one step's sums and the update."""
    code, dim = PairCoding(1000), 64
    rng = np.random.default_rng(0)
    x, index = rng.normal(size=(400, dim)), rng.integers(0, 1000, 400)
    tracemalloc.start()
    state = State(code.p, dim)
    for keys in trainer.problem_blocks(state.active(), dim):
        grad, used = np.zeros((len(keys), dim)), np.zeros(len(keys), dtype=np.int64)
        hinge_sums(x, index, code, keys, state.weights[keys], grad, used)
        state.update(1, keys, grad, used, SGDParams(step=2.0, reg=0.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000_000
    pos, neg = code.pairs()
    counts = np.bincount(index, minlength=1000)
    total = np.zeros((1000, dim))
    np.add.at(total, index, x)
    for j in rng.integers(0, code.p, 50):  # weights are zero, so every row is inside the hinge
        n = counts[pos[j]] + counts[neg[j]]
        want = 2.0 * (total[pos[j]] - total[neg[j]]) / n if n else np.zeros(dim)
        assert np.allclose(state.weights[j], want)


def _batch(x):
    return pa.RecordBatch.from_pydict({"id": pa.array(np.arange(len(x))), "features": pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))})


def test_two_hundred_classes_are_scored_in_tiles(spark):
    """19,900 pairs: under 200 MB beside the input, under 1 MB in the closure, and the labels of plain votes."""
    k, dim, n = 200, 64, 10_000
    rng = np.random.default_rng(1)
    weights, x = rng.normal(size=(k * (k - 1) // 2, dim)), rng.normal(size=(n, dim))
    blocks = ProblemBlocks(spark, weights)
    schema = pa.schema([("id", pa.int64()), ("prediction", pa.int32())])
    plan = (np.arange(k) * 3, None, None)
    kernel = score_kernel(blocks, ["id"], "ovo", plan, k, schema, labels=True)
    assert len(CloudPickleSerializer().dumps(kernel)) < 1_000_000
    batch = _batch(x)
    next(iter(kernel([batch.slice(0, 1)])))  # the weights are read once
    tracemalloc.start()
    out = [b.column("prediction").to_numpy() for b in kernel([batch])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000
    pos, neg = PairCoding(k).pairs()
    some = slice(0, 300)
    assert np.array_equal(np.concatenate(out)[some], 3 * pair_votes(x[some] @ weights.T, pos, neg, k).argmax(axis=1))


@pytest.mark.parametrize("sparse", [False, True])
def test_tiles_and_blocks_do_not_change_results(spark, sparse):
    rng = np.random.default_rng(2)
    k, dim, n = 9, 7, 80
    dense = np.round(8 * rng.normal(size=(n, dim)) * (rng.random((n, dim)) < 0.6)) / 8  # sums are exact in any order
    dense[:5] = 0.0
    x = dense
    if sparse:
        r, c = np.nonzero(dense)
        x = SparseRows(np.concatenate([[0], np.cumsum((dense != 0).sum(axis=1))]), c, dense[r, c], n, dim)
    pos, neg = PairCoding(k).pairs()
    nodes = tree_layout([4, 0, 7], [1, 2, 3, 5, 6, 8])
    for block_bytes in (8 * dim, 8 * dim * 4, None):
        pairs, each, tree = (np.round(8 * rng.normal(size=(p, dim))) / 8 for p in (len(pos), k, k - 1))
        each[3] = each[1]  # ties go to the lower class
        for tile in (1, 3, 100):
            votes = count_votes(x, ProblemBlocks(spark, pairs, block_bytes), k, tile)
            assert np.array_equal(votes, pair_votes(dense @ pairs.T, pos, neg, k))
            assert np.array_equal(best_problem(x, ProblemBlocks(spark, each, block_bytes), tile), (dense @ each.T).argmax(axis=1))
        margins, want = dense @ tree.T, []
        for i in range(n):
            at = 0
            while True:
                side = "pos" if margins[i, at] >= 0 else "neg"
                if nodes[at][f"{side}_child"] < 0:
                    want.append(nodes[at][f"{side}_label"])
                    break
                at = nodes[at][f"{side}_child"]
        assert walk_tree(x, ProblemBlocks(spark, tree, block_bytes), *tree_links(nodes)).tolist() == want


def test_tree_rows_meet_only_the_nodes_on_their_path(spark, monkeypatch):
    nodes, n = tree_layout(list(range(0, 256)), list(range(256, 512))), 1000
    products = []
    plain = ProblemBlocks.at
    monkeypatch.setattr(ProblemBlocks, "at", lambda self, x, problems: products.append(len(problems)) or plain(self, x, problems))
    rng = np.random.default_rng(3)
    labels = walk_tree(rng.normal(size=(n, 4)), ProblemBlocks(spark, rng.normal(size=(511, 4))), *tree_links(nodes))
    assert sum(products) == 9 * n and len(set(labels)) > 100  # 512 leaves, 511 nodes


def test_broadcast_models_score_alike(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, i % 6, (rng.normal(0, 0.4, 6) + 3 * np.eye(6)[i % 6]).tolist()) for i in range(240)]
    df = frame(spark, rows)
    for scheme in (OneVsAll, OneVsOne, ClusterTree):
        m = scheme(iterations=8, step=1.0).fit(df)
        plain = {r.id: r.prediction for r in m.transform(df, keep=["id"], labels_only=True).collect()}
        monkeypatch.setattr(trainer, "CLOSURE_BYTES", 0)
        monkeypatch.setattr(scoring, "MODEL_BLOCK_BYTES", 8 * 6 * 2)
        m._blocks = None
        assert any(hasattr(p, "value") for p in m.blocks(spark).parts)
        assert {r.id: r.prediction for r in m.transform(df, keep=["id"], labels_only=True).collect()} == plain
        full = {r.id: (len(r.margins), r.prediction) for r in m.transform(df).collect()}
        assert {i: p for i, (_, p) in full.items()} == plain and {n for n, _ in full.values()} == {m.problems}
        monkeypatch.undo()


def test_one_vs_one_of_sixty_classes(spark):
    """1,770 problems, trained and scored end to end, in tasks and by tiles."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3, (60, 12))
    rows = [(i, 7 * (i % 60), (centres[i % 60] + rng.normal(0, 0.3, 12)).tolist()) for i in range(1800)]
    df = frame(spark, rows)
    m = OneVsOne(iterations=12, step=1.0, reg=0.001, fraction=0.5).fit(df)
    assert m.problems == 1770
    out = m.transform(df, keep=["id", "label"], labels_only=True).toPandas().sort_values("id")
    assert (out.label == out.prediction).mean() > 0.98
    x = np.array([r[2] for r in rows])
    votes = pair_votes(x @ m.weights.T, *PairCoding(60).pairs(), 60)
    assert (out.prediction.to_numpy() == 7 * votes.argmax(axis=1)).all()


def test_a_model_too_large_for_the_driver_is_refused(spark, monkeypatch):
    from multisvm.plans import classifiers

    monkeypatch.setattr(classifiers, "MODEL_BYTES", 8 * 2 * 14)
    df = frame(spark, [(i, i % 6, [1.0, float(i)]) for i in range(30)])
    with pytest.raises(ValueError, match="15 problems of 2 features"):
        OneVsOne(iterations=1).fit(df)
    assert OneVsAll(iterations=1).fit(df).problems == 6


@pytest.fixture(scope="module")
def train(spark):
    return train_test_split(embeddings(spark, SF_SMALL))[0].cache()


@pytest.mark.parametrize("fraction", [1.0, 0.25])
@pytest.mark.parametrize("scheme", ["ova", "ovo", "tree"])
def test_steps_in_a_task_equal_a_job_an_iteration(train, scheme, fraction):
    inv = collect_inventory(train)
    nodes = tree_layout(list(inv.classes[:4]), list(inv.classes[4:]))
    code = {"ova": OneVsAllCoding(inv.k), "ovo": PairCoding(inv.k), "tree": TreeCoding(nodes, inv.classes)}[scheme]
    p = SGDParams(iterations=14, step=30.0, reg=0.01, fraction=fraction, buckets=64, tol=0.3)
    a = fit_coded(train.repartition(3), code, inv.classes, inv.dim, p, in_task=True)
    b = fit_coded(train.repartition(3), code, inv.classes, inv.dim, p, in_task=False)
    assert np.abs(a.weights - b.weights).max() < 1e-11 and len(a.history) == len(b.history)
    assert np.array_equal(a.iterations, b.iterations) and np.array_equal(a.converged, b.converged)
    c = trainer.fit_in_task(train.withColumn("_bucket", trainer.bucket_of(p.seed, F.col("id"), p.n_buckets)), code, inv.classes, inv.dim, p, seconds=0.0)
    assert np.abs(a.weights - c.weights).max() < 1e-12 and len(c.history) == len(a.history)  # one step a job


def test_steps_in_a_task_on_sparse_rows(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(6)
    rows = [(i, i % 3, Vectors.sparse(40, {i % 3: 2.0, 3 + i % 37: float(rng.normal())})) for i in range(90)]
    df = spark.createDataFrame(rows, ["id", "label", "features"]).withColumn("label", F.col("label").cast("int"))
    p = SGDParams(iterations=6, step=2.0, reg=0.01)
    a, b = (fit_coded(df.repartition(2), PairCoding(3), [0, 1, 2], 40, p, in_task=t).weights for t in (True, False))
    assert np.abs(a - b).max() < 1e-12 and np.abs(a).max() > 0


def test_one_wide_problem_is_summed_by_feature_range(spark, train, monkeypatch):
    assert partials.sum_tasks(1, 1_000_000, 10_000) == 62 and partials.sum_tasks(1, 64, 10_000) == 1 and partials.sum_tasks(45, 64, 8) == 8
    dim, parts = 1000, 12
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(parts, dim)), np.arange(parts) % 2
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "id long, label int, features array<double>").repartition(parts)
    code = one_vs_all_code(2)[:, :1]
    whole = fit_coded(df, code, [0, 1], dim, SGDParams(iterations=3), in_task=False).weights
    monkeypatch.setattr(partials, "SPAN", 64)
    monkeypatch.setattr(partials, "DRIVER_SUM_LIMIT", 0)
    tasks = []
    plain = partials.sum_tasks
    monkeypatch.setattr(partials, "sum_tasks", lambda *a: tasks.append(plain(*a)) or tasks[-1])
    ranges = fit_coded(df, code, [0, 1], dim, SGDParams(iterations=3), in_task=False).weights
    assert np.abs(whole - ranges).max() < 1e-12 and tasks == [min(16, df.rdd.getNumPartitions())] * 3


def test_lloyd_in_a_task_equals_a_job_an_iteration(train):
    start = first_last_centres(train)
    a, n = lloyd(train.repartition(3), start, 50, in_task=True)
    b, m = lloyd(train.repartition(3), start, 50, in_task=False)
    assert np.abs(a - b).max() < 1e-12 and n == m > 1


def test_spark_kmeans_start_is_as_good_as_lloyd(train):
    """k-means|| draws its own start; its cost is bounded by Lloyd's."""
    def cost(centres):
        return assign_clusters(train, centres, ["id"]).agg(F.sum("distance")).first()[0]

    own = cost(lloyd(train, first_last_centres(train), 500)[0])
    assert cost(kmeans_fit(train, 2, 500, 42, "k-means||")) < 1.02 * own
