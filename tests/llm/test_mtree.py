import math
import random

from helpers import with_clashes
from multisvm.llm import mtree
from multisvm.llm.mtree import top_k

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k):
    ok = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    asked = {(i, v) for i, v in ok if any(i == q[0] for q in queries)}
    out = []
    for q, a in asked:
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def random_rows(seed, n, dim):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [round((x + rng.gauss(0, 0.2)) * 8) / 64 for x in c]))
    rows += [(n + i, rows[3][1]) for i in range(40)]  # a frequent vector: ties
    rows += [rows[0], rows[0]]
    rows += [(5000, None), (None, rows[1][1]), (5001, [None] * dim), (5002, [float("nan")] * dim), (5003, [float("inf")] * dim),
             (5004, []), (5005, rows[2][1][:2]), (5006, [0.0] * dim)]
    return rows


def test_equal_to_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD", 150)
    monkeypatch.setattr(mtree, "BLOCK", 16)
    monkeypatch.setattr(mtree, "SEEDS", 30)
    rows = random_rows(1, 500, 7)
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    asked = df.where("vec_id % 10 = 0 or vec_id > 4999")
    got = sorted(tuple(r) for r in top_k(df, asked, k=5).collect())
    assert got == brute(rows, [r for r in rows if r[0] is not None and (r[0] % 10 == 0 or r[0] > 4999)], 5)


def test_fewer_rows_than_k_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], SCHEMA)
    assert sorted(tuple(r) for r in top_k(df, df).collect()) == [(1, 1, 2, 128 * 256), (2, 1, 1, 128 * 256)]
    none = spark.createDataFrame([], SCHEMA)
    assert top_k(none, none).count() == 0 and top_k(df, none).count() == 0 and top_k(df.limit(1), df.limit(1)).count() == 0


def test_pages_are_passed_over():
    """On clustered vectors the search computes few of the distances."""
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.round(rng.normal(0, 400, (40, 1, 8)) + rng.normal(0, 4, (40, 100, 8))).reshape(-1, 8)
    tree = mtree.MTree(x, [[i] for i in range(len(x))], float((x**2).sum(axis=1).max()), page=32)
    opened = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            opened.append(np.size(key))
            return super().__getitem__(key)

    tree.vectors = tree.vectors.view(Counted)
    query = x[17]
    got = tree.search(query, 17, 5, -np.inf)
    scores = x @ query
    want = sorted((-int(s), i) for i, s in enumerate(scores) if i != 17)[:5]
    assert [(-s, i) for s, i in got] == want
    assert sum(opened) < 0.7 * len(x)


def test_far_shards_are_skipped():
    """On clustered vectors most (query, pivot) pairs are ruled out, and none that holds an answer."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1000, (30, 10))
    centres *= 2000 / np.linalg.norm(centres, axis=1)[:, None]
    x = np.round((centres[:, None, :] + rng.normal(0, 5, (30, 60, 10))).reshape(-1, 10))
    longest = float((x**2).sum(axis=1).max())
    points = mtree.lifted(x, longest)
    pivots = mtree.far_points(points[::3], 30)
    to = mtree.apart(points, pivots)
    own = to.argmin(axis=1)
    radius = np.array([to[own == p, p].max() for p in range(len(pivots))])
    scores = x[::7] @ x.T
    start = np.sort(scores, axis=1)[:, -6].astype(float)
    asks = mtree.within(x[::7], start, pivots, radius, longest)
    assert asks.mean() < 0.2
    for i, row in enumerate(scores):
        assert asks[i, np.unique(own[row >= start[i]])].all()


def test_exact_beyond_doubles_and_longs(spark):
    import pytest

    rng = random.Random(9)
    big = [(i, [math.floor(rng.gauss(0, 1) * 2**10) * 2.0**9, float(rng.randint(0, 3)), 0.0]) for i in range(80)]
    rows = big + [(500, [0.0, 0.0, 2.0**40])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [r for r in big if r[0] % 4 == 0]
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 4 = 0 and vec_id < 100")).collect())
    assert got == brute(rows, asked, 5)
    with pytest.raises(Exception, match="exceeds 2\\^62"):
        top_k(spark.createDataFrame([(1, [1e17])], "vec_id long, embedding array<double>"), df).collect()


def test_queries_meet_the_trees_without_a_broadcast(spark):
    """The queries sent outgrow the table they come from; a broadcast would pass them through the driver."""
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = top_k(df, df.where("vec_id % 50 = 0"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, rows[::50], 5)
