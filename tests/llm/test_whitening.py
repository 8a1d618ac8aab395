import math
import random

import numpy as np
import pytest

from helpers import with_clashes
from multisvm.llm import charpoly, whitening
from multisvm.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>"


def vectors(rows, width):
    """(id, integers) of the rows that take part."""
    ok = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, [math.floor(64 * float(np.float32(x))) + 1_000_000 for x in v] + [1_000_000] * (width - len(v))) for i, v in ok]


def brute(rows, width, count=32):
    """{(id, component): (n, deviation, whitened up to sign, explained)} by LAPACK."""
    ok = vectors(rows, width)
    n, x = len(ok), np.array([v for _, v in ok], dtype=object).reshape(len(ok), width)
    sums = x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    centred = ((n * x - sums) / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    k = int((e > 1e-9 * e[0]).sum())
    return ok, n, deviation, centred @ u[:, :k] / np.sqrt(e[:k]), e[:k] / (centred**2).sum() * n


def check(df, rows, width):
    got = {}
    for r in whiten(df).collect():
        got.setdefault(r.component, []).append(r)
    ok, n, deviation, z, explained = brute(rows, width)
    assert sorted(got) == list(range(1, len(explained) + 1))
    for c, have in got.items():
        assert sorted((r.vec_id, int(r.deviation)) for r in have) == sorted((i, d) for (i, _), d in zip(ok, deviation))
        assert {r.n for r in have} == {n} and len({r.identity_error for r in have}) == 1 and have[0].identity_error < 1e-9
        assert all(abs(r.explained / explained[c - 1] - 1) < 1e-9 for r in have)
        alone = all(abs(e / explained[c - 1] - 1) > 1e-6 for i, e in enumerate(explained) if i != c - 1)
        if alone:  # a component of its own, up to sign
            a, b = (np.array([v for _, v in sorted(pairs)]) for pairs in ([(r.vec_id, r.whitened) for r in have], [(i, v) for (i, _), v in zip(ok, z[:, c - 1])]))
            assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7


def sample(seed, n, width):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 0.125) * (1 + j / 3) + 0.3 * (j == 2) for j in range(width)]) for i in range(n)]


def test_equal_to_lapack(spark):
    rows = sample(1, 300, 9)
    extra = [(1000, None), (1001, [None] * 9), (1002, [float("nan")] * 9), (1003, [float("inf")] * 9), (1004, [0.5, 0.25]), (1005, [])]
    check(with_clashes(spark.createDataFrame(rows + extra, SCHEMA)).repartition(5), rows + extra, 9)


def test_more_dimensions_than_components(spark):
    rows = sample(2, 200, 40)
    check(spark.createDataFrame(rows, SCHEMA), rows, 40)


def test_repeated_rows_count_and_null_ids_stay(spark):
    rows = sample(3, 50, 3)
    df = spark.createDataFrame(rows + rows[:5] + [(None, [0.5, 0.5, -2.0])], SCHEMA)
    out = whiten(df).collect()
    assert len(out) == 56 * 3 and {r.n for r in out} == {56} and sum(r.vec_id is None for r in out) == 3
    assert all(r.identity_error < 1e-9 for r in out)


def test_equal_eigenvalues_and_missing_directions(spark):
    """A copied and a constant direction have no component; equal eigenvalues
    give unit covariance all the same."""
    rows = [(i, [float(x), float(y), float(x), 0.7]) for i, (x, y) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)] * 3)]
    rows += [(100 + i, [0.0, y, 0.0, 0.7]) for i, y in enumerate([2.0**0.5 * 1, -(2.0**0.5)])]
    out = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in out} == {1, 2} and out[0].identity_error < 1e-9
    square = [(i, v) for i, v in enumerate([[1.0, 1.0], [1.0, -1.0], [-1.0, 1.0], [-1.0, -1.0]])]
    out = whiten(spark.createDataFrame(square, SCHEMA)).collect()
    assert len(out) == 8 and out[0].identity_error < 1e-12 and all(abs(r.explained - 0.5) < 1e-12 for r in out)


def test_empty_constant_and_single(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5])]):
        out = whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.count() == 0 and out.columns[:2] == ["vec_id", "component"]


def test_large_components_stay_exact(spark):
    """Components near 2^50: sums of many limbs, deviations beyond a long."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-(1 << 50), 1 << 50)) for _ in range(3)]) for i in range(60)]
    out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = np.array([[64 * int(c) for c in v] for _, v in rows], dtype=object)
    want = dict(zip(range(60), ((60 * x - x.sum(axis=0)) ** 2).sum(axis=1)))
    assert {(r.vec_id, int(r.deviation)) for r in out} == set(want.items()) and out[0].identity_error < 1e-9
    with pytest.raises(Exception, match="exceeds 2\\^62"):
        whiten(spark.createDataFrame([(1, [1e30])], SCHEMA)).collect()


def test_scatter_is_exact_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "CHUNK", 8)
    monkeypatch.setattr(whitening, "FLUSH", 16)
    rng = random.Random(7)
    x = [[rng.randint(-(1 << 45), 1 << 45) for _ in range(4)] for _ in range(100)]
    cells, sums = whitening.scatter(spark.createDataFrame([(v,) for v in x], "x array<long>").repartition(3), 100, 4, 1 << 45)
    a = np.array(x, dtype=object)
    assert cells == (100 * (a.T @ a) - np.outer(a.sum(axis=0), a.sum(axis=0))).tolist() and sums == a.sum(axis=0).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_polynomial_and_roots(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-9, 10, (12, 6)).astype(object)
    if seed == 3:
        x[:, 4] = x[:, 1]
    a = (x.T @ x).tolist()
    primes = charpoly.primes_for(charpoly.coefficient_bits(sum(a[i][i] for i in range(6)), 6))
    poly = [charpoly.chinese_remainder([(p, int(charpoly.polynomial_mod(a, p)[k])) for p in primes]) for k in range(7)]
    for at in (0, 3, -7):  # det(xI - A) by minors
        m = [[at * (i == j) - a[i][j] for j in range(6)] for i in range(6)]
        assert sum(c * at**k for k, c in enumerate(poly)) == det(m)
    trace = sum(a[i][i] for i in range(6))
    large = charpoly.scaled(poly, 60)
    found = [charpoly.refine(large, low, high) / 2**60 for low, high, m in charpoly.isolate(large, 6, trace << 60) if m == 1]
    want = np.linalg.eigvalsh(np.array(a, dtype=float))[::-1]
    assert np.allclose(found, want[: len(found)], rtol=1e-9) and len(found) == (5 if seed == 3 else 6)


def det(m):
    return sum((-1) ** j * m[0][j] * det([r[:j] + r[j + 1:] for r in m[1:]]) for j in range(len(m))) if m else 1
