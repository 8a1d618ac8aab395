"""Feature blocks: the features of one Arrow batch, dense or sparse.

An ``array<...>`` column becomes a dense float64 matrix. A vector column
(LibSVM input) arrives as ``struct<type, size, indices, values>`` and becomes
:class:`SparseRows` (compressed rows in plain numpy), unless it is dense
enough that a BLAS product is cheaper. Kernels only use three operations:
``x @ w`` (margins), ``x.T @ coef`` via :func:`t_product` (sub-gradients,
per-cluster sums) and ``x[rows]`` (group rows by class). Sparse products work
through blocks of bounded size, dense ones where that pays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Above this fraction of non-zeros a sparse batch is densified for BLAS.
DENSIFY_ABOVE = 0.3
# Products of sparser batches: values of a temporary, and the fraction of
# non-zeros below which no dense block is made.
BLOCK_VALUES = 2_000_000
THIN = 0.01


class SparseRows:
    """Compressed sparse rows: ``indptr`` (n+1), ``indices`` / ``values`` (nnz)."""

    __slots__ = ("indptr", "indices", "values", "shape")

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, values: np.ndarray, n: int, dim: int):
        self.indptr = np.asarray(indptr, dtype=np.int64)
        self.indices = np.asarray(indices, dtype=np.int64)
        self.values = np.asarray(values, dtype=np.float64)
        self.shape = (n, dim)

    def __len__(self) -> int:
        return self.shape[0]

    def row_ids(self) -> np.ndarray:
        return np.repeat(np.arange(self.shape[0]), np.diff(self.indptr))

    def _dense_blocks(self):
        """(first row, last row, dense block) of at most ``BLOCK_VALUES`` values."""
        n, dim = self.shape
        step = max(1, BLOCK_VALUES // max(1, dim))
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            a, b = self.indptr[lo], self.indptr[hi]
            block = np.zeros((hi - lo, dim))
            block[np.repeat(np.arange(hi - lo), np.diff(self.indptr[lo:hi + 1])), self.indices[a:b]] = self.values[a:b]
            yield lo, hi, block

    def _thin(self) -> bool:
        """So few non-zeros that dense blocks would be mostly zeros."""
        return len(self.values) < THIN * self.shape[0] * self.shape[1]

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        """(n x dim) @ (dim x p) -> n x p, in memory of ``BLOCK_VALUES`` values
        beside the result, whatever p."""
        n, p = self.shape[0], w.shape[1]
        out = np.zeros((n, p))
        if not self._thin():
            for lo, hi, block in self._dense_blocks():
                out[lo:hi] = block @ w
            return out
        rows = np.flatnonzero(np.diff(self.indptr))
        step = max(1, BLOCK_VALUES // max(1, len(self.values)))
        for lo in range(0, p if len(rows) else 0, step):
            contrib = self.values[:, None] * w[self.indices, lo:lo + step]
            out[rows, lo:lo + step] = np.add.reduceat(contrib, self.indptr[rows], axis=0)
        return out

    def t_product(self, coef: np.ndarray) -> np.ndarray:
        """coef.T @ X: (n x p) -> p x dim, in the same memory."""
        p, dim = coef.shape[1], self.shape[1]
        out = np.zeros((p, dim))
        if not self._thin():
            for lo, hi, block in self._dense_blocks():
                out += coef[lo:hi].T @ block
            return out
        row_ids = self.row_ids()
        for j in range(p if len(self.values) else 0):
            out[j] = np.bincount(self.indices, weights=coef[row_ids, j] * self.values, minlength=dim)
        return out

    def __getitem__(self, rows) -> "SparseRows":
        rows = np.asarray(rows, dtype=np.int64)
        starts, ends = self.indptr[rows], self.indptr[rows + 1]
        lengths = ends - starts
        indptr = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(starts - indptr[:-1], lengths) + np.arange(indptr[-1])
        return SparseRows(indptr, self.indices[take], self.values[take], len(rows), self.shape[1])

    def squared_norms(self) -> np.ndarray:
        return np.bincount(self.row_ids(), weights=self.values ** 2, minlength=self.shape[0])

    def toarray(self) -> np.ndarray:
        out = np.zeros(self.shape)
        out[self.row_ids(), self.indices] = self.values
        return out


def _list_matrix(arr, dim: int) -> np.ndarray:
    n = len(arr)
    if n == 0:
        return np.zeros((0, dim))
    flat = arr.flatten()
    if len(flat) != n * dim or flat.null_count:
        raise ValueError(f"expected {dim} features per row, none of them null")
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, dim)


def _vector_rows(arr: pa.StructArray, dim: int) -> SparseRows:
    """ML vector struct (type 0 sparse / 1 dense) -> SparseRows."""
    n = len(arr)
    kinds = arr.field("type").to_numpy(zero_copy_only=False)
    values_list = arr.field("values")
    lengths = np.asarray(values_list.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    indptr = np.concatenate([[0], np.cumsum(lengths)])
    values = np.asarray(values_list.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    row_of = np.repeat(np.arange(n), lengths)
    dense_nz = (kinds == 1)[row_of]
    indices = np.empty(len(values), dtype=np.int64)
    indices[~dense_nz] = arr.field("indices").flatten().to_numpy(zero_copy_only=False)
    indices[dense_nz] = (np.arange(len(values)) - indptr[row_of])[dense_nz]
    if len(indices) and (indices.max() >= dim or indices.min() < 0):
        raise ValueError(f"feature index outside 0..{dim - 1}")
    return SparseRows(indptr, indices, values, n, dim)


def feature_block(arr, dim: int):
    """Arrow feature column -> dense ``n x dim`` matrix or :class:`SparseRows`."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_struct(arr.type):
        rows = _vector_rows(arr, dim)
        if len(rows.values) > DENSIFY_ABOVE * max(1, rows.shape[0] * dim):
            return rows.toarray()
        return rows
    return _list_matrix(arr, dim)


def t_product(coef: np.ndarray, x) -> np.ndarray:
    """coef.T @ x for a dense matrix or sparse rows."""
    if isinstance(x, SparseRows):
        return x.t_product(coef)
    return coef.T @ x


def squared_distances(x, centres: np.ndarray) -> np.ndarray:
    """n x k squared Euclidean distances. Dense rows: summed term by term (no
    norm trick, so near-ties fall the way a plain SQL sum decides them);
    sparse rows: |x|^2 - 2 x.c + |c|^2."""
    if isinstance(x, SparseRows):
        d = x.squared_norms()[:, None] - 2.0 * (x @ centres.T) + (centres ** 2).sum(axis=1)[None, :]
        return np.maximum(d, 0.0)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
