import math
import random

import numpy as np
import pytest

from helpers import with_clashes
from multisvm.llm import hard_negatives as hn
from multisvm.llm.hard_negatives import Shard, best_of, hard_negatives, inside_of

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, asked, k=5, low=80, high=100):
    ok = {(i, tuple(math.floor(256 * x) for x in v), c) for i, v, c in rows
          if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, a, c in ok:
        if not asked(i):
            continue
        scores = [(-sum(x * y for x, y in zip(a, b)), j, d) for j, b, d in ok if j != i]
        for p, j, _ in sorted(s for s in scores if s[2] == c)[:k]:
            fit = sorted(s for s in scores if s[2] != c and low * -p <= 100 * -s[0] <= high * -p)[:k]
            out += [(i, j, r, m, -p, -s) for r, (s, m, _) in enumerate(fit, 1)]
    return sorted(out)


def sample(seed, n, dim, labels=4, spread=0.5):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    rows = []
    for i in range(n):
        c = rng.randrange(labels)
        rows.append((i, [round((x + rng.gauss(0, spread)) * 16) / 64 for x in centres[c]], c if rng.random() < 0.8 else rng.randrange(labels)))
    return rows


def test_equal_to_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAST_ROWS", 60)
    monkeypatch.setattr(hn, "BLOCK", 16)
    monkeypatch.setattr(hn, "SEEDS", 40)
    rows = sample(1, 400, 11)
    rows += [(1000 + i, rows[3][1], i % 2) for i in range(60)]  # a frequent vector: ties
    rows += [rows[0], rows[0], (5, rows[6][1], 3), (7, [-x for x in rows[7][1]], rows[7][2])]  # repeated rows, ids of two rows
    rows += [(2000, None, 1), (None, rows[1][1], 1), (2002, rows[1][1], None), (2003, [None] * 11, 1), (2004, [float("nan")] * 11, 1),
             (2005, [float("-inf")] * 11, 1), (2006, [], 1), (2007, rows[2][1][:2], 1), (2008, [0.0] * 11, 2)]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    asked = df.where("vec_id % 10 = 0 or vec_id > 1990 or vec_id in (5, 7)")
    got = sorted(tuple(r) for r in hard_negatives(df, asked).collect())
    want = brute(rows, lambda i: i % 10 == 0 or i > 1990 or i in (5, 7))
    assert got == want and len(want) > 500


@pytest.mark.parametrize("size", [1.0, 2.0**20, 2.0**30])
def test_exact_at_every_size(spark, size):
    """Scores that doubles hold, that longs hold, and products beyond both (few
    enough to sum to a long)."""
    rows = [(i, [math.floor(x * 64) * size / 256 for x in v], c) for i, v, c in sample(2, 120, 3)]
    if size == 2.0**30:  # one far component that no anchor shares
        rows = [(i, [*v[:2], 0.0, 0.0], c) for i, v, c in sample(2, 120, 3)] + [(999, [0.0, 0.0, 0.0, 2.0**34], 0)]
    got = sorted(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[::9], SCHEMA)).collect())
    ids = {r[0] for r in rows[::9]}
    assert got == brute(rows, lambda i: i in ids) and got


def test_other_parameters(spark):
    rows = sample(3, 90, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in hard_negatives(df, df.where("vec_id < 20"), 3, 3, 35, 117).collect())
    assert got == brute(rows, lambda i: i < 20, 3, 35, 117)


def test_empty_tables_and_no_partners(spark):
    none = spark.createDataFrame([], SCHEMA)
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.5, 0.5], 1)], SCHEMA)
    assert hard_negatives(none, none).count() == 0 and hard_negatives(df, none).count() == 0
    assert hard_negatives(df, df).count() == 0  # no positives
    with pytest.raises(Exception, match="exceeds 2\\^62"):
        hard_negatives(spark.createDataFrame([(1, [1e30], 0)], SCHEMA), df).collect()


def test_bounds_pass_over_most_of_the_columns():
    """With few large components in an anchor, few candidates reach the last ones."""
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(0, 40, (5000, 64)))
    query = np.round(rng.normal(0, 40, 64) * (np.arange(64) < 8) * 20 + rng.normal(0, 2, 64))
    for make in (lambda: best_of(5, None), lambda: inside_of([[0.8 * float((x @ query).max()), float((x @ query).max()) - 1]], 5)):
        left = []
        undecided = make()

        def counted(lower, upper, undecided=undecided, left=left):
            left.append(len(lower))
            return undecided(lower, upper)

        rows, score = Shard(x).scan(query, np.ones(len(x), bool), counted)
        assert (score == x[rows] @ query).all() and left[1] < 0.2 * left[0]
