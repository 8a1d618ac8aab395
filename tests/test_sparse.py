"""Sparse (LibSVM) features: numpy sparse rows against dense products, and
training on sparse input against a dense numpy reference."""

import os
import tempfile

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from multisvm.operators.blocks import SparseRows, feature_block, squared_distances, t_product


def _random_sparse(rng, n, dim, density):
    dense = rng.normal(size=(n, dim)) * (rng.random((n, dim)) < density)
    indptr = np.concatenate([[0], np.cumsum((dense != 0).sum(axis=1))])
    rows, cols = np.nonzero(dense)
    return dense, SparseRows(indptr, cols, dense[rows, cols], n, dim)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 12), st.integers(1, 5), st.floats(0.0, 0.6), st.integers(0, 999))
def test_sparse_rows_products(n, dim, p, density, seed):
    rng = np.random.default_rng(seed)
    dense, sp = _random_sparse(rng, n, dim, density)
    w = rng.normal(size=(dim, p))
    coef = rng.normal(size=(n, p))
    assert np.allclose(sp @ w, dense @ w, atol=1e-12)
    assert np.allclose(t_product(coef, sp), coef.T @ dense, atol=1e-12)
    pick = rng.integers(0, n, size=min(n, 7))
    assert np.array_equal(sp[pick].toarray(), dense[pick])
    c = rng.normal(size=(3, dim))
    assert np.allclose(squared_distances(sp, c), squared_distances(dense, c), atol=1e-9)


def test_vector_struct_with_dense_and_sparse_rows():
    vtype = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())),
                       ("values", pa.list_(pa.float64()))])
    arr = pa.array([
        {"type": 0, "size": 4, "indices": [1, 3], "values": [2.0, -1.0]},
        {"type": 1, "size": None, "indices": None, "values": [1.0, 0.0, 0.0, 5.0]},
        {"type": 0, "size": 4, "indices": [], "values": []},
    ], vtype)
    block = feature_block(arr, 4)
    got = block.toarray() if isinstance(block, SparseRows) else block
    assert got.tolist() == [[0.0, 2.0, 0.0, -1.0], [1.0, 0.0, 0.0, 5.0], [0.0, 0.0, 0.0, 0.0]]


def test_training_on_sparse_libsvm_equals_dense_numpy(spark):
    from multisvm.operators.coding import collect_inventory, one_vs_one_code
    from multisvm.operators.trainer import SGDParams, fit_coded
    from multisvm.sources import read_libsvm

    rng = np.random.default_rng(5)
    n, dim, k = 300, 200, 4
    labels = rng.integers(0, k, size=n)
    dense = np.round(rng.normal(size=(n, dim)) * (rng.random((n, dim)) < 0.04), 3)
    dense[np.arange(n), labels] += 1.5  # some signal
    path = os.path.join(tempfile.mkdtemp(prefix="multisvm-sparse-"), "data.libsvm")
    with open(path, "w") as f:
        for i in range(n):
            nz = np.flatnonzero(dense[i])
            f.write(f"{labels[i]} " + " ".join(f"{j + 1}:{dense[i, j]}" for j in nz) + "\n")
    df = read_libsvm(spark, path, num_features=dim)
    inv = collect_inventory(df)
    assert inv.dim == dim and inv.classes == (0, 1, 2, 3)
    code = one_vs_one_code(k)
    res = fit_coded(df.repartition(3), code, inv.classes, dim, SGDParams(iterations=6, step=5.0, reg=0.01))
    # dense numpy reference of the same rule
    y_all = code[labels]
    w = np.zeros((code.shape[1], dim))
    for t in range(1, 7):
        eta = 5.0 / np.sqrt(t)
        for p in range(code.shape[1]):
            y = y_all[:, p]
            use = y != 0
            act = use & (y * (dense @ w[p]) < 1.0)
            g = -(y[act][:, None] * dense[act]).sum(0)
            w[p] = w[p] * (1 - eta * 0.01) + (-eta) * (g / use.sum())
    assert np.abs(res.weights - w).max() < 1e-9

    from multisvm import OneVsAll
    model = OneVsAll(SGDParams(iterations=20, step=1.0, reg=0.01, fraction=1.0)).fit(df)
    scored = model.transform(df).toPandas()
    margins = np.stack(scored.margins.values)
    assert margins.shape == (n, k)


def test_sparse_products_stay_within_their_memory():
    """Many problems, rows like scaled images: temporaries do not grow with them."""
    import tracemalloc

    rng = np.random.default_rng(3)
    _, sp = _random_sparse(rng, 3000, 784, 0.19)
    w, coef = rng.normal(size=(784, 45)), rng.normal(size=(3000, 45))
    for product in (lambda: sp @ w, lambda: t_product(coef, sp)):
        tracemalloc.start()
        product()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60_000_000


def test_very_sparse_wide_rows():
    rng = np.random.default_rng(4)
    dense, sp = _random_sparse(rng, 50, 5000, 0.002)
    assert sp._thin()
    w, coef = rng.normal(size=(5000, 7)), rng.normal(size=(50, 7))
    assert np.allclose(sp @ w, dense @ w) and np.allclose(t_product(coef, sp), coef.T @ dense)
