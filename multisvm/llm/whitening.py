"""Embedding whitening by an exact characteristic polynomial.

Components become integers, so the scatter matrix n * sum(x x') - S S' is an
integer matrix and everything up to its eigenvalues is exact.

1. One pass adds up the products of the integers (in limbs of 20 bits whose
   sums of products float64 holds exactly); tasks' partial sums are added on
   Spark by matrix cell in limbs of 31 bits, and D x D numbers come back.
2. The characteristic polynomial is computed modulo as many 31-bit primes as
   its largest coefficient needs (Hessenberg reduction, a row a prime on
   Spark); every coefficient is put together by Chinese remainders, also there.
3. All roots are real, so sign changes of the shifted polynomial count the
   roots above a point exactly; bisection isolates the largest ones.
4. Every isolated root is refined to 120 bits below the trace and its component
   is found by inverse iteration on the null space of (scatter - root), in
   fixed-point numbers of 320 bits: one Spark row a root. Roots that 2^-120 of
   the trace does not separate share a space, of which an orthonormal basis is
   taken; roots of exactly zero have no whitened value and give no component.
5. A pass over the rows measures the covariance of the whitened vectors, and a
   last one emits them.

The rows are read in three narrow passes without a shuffle; what is gathered
has the size of a D x D matrix. The polynomial has D coefficients of about 40 D
bits, so the method is meant for some hundreds of dimensions at most.

Defined cases: rows whose vector is null or holds null or non-finite entries
are dropped, rows without an id stay; shorter vectors count as padded with
zeros; repeated rows count as often as they stand; a component of a vector
times ``scale`` beyond 2^62 is an error; a constant or single row has no
component of positive variance and gives no rows, as does an empty table; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from multisvm.llm import charpoly
from multisvm.llm.common import workers
from multisvm.llm.vectors import integers, matrix, whole_vectors

LIMB = 20  # bits of a factor: products of two, a chunk of rows added up, are exact in float64
CHUNK = 1 << 12  # rows multiplied at once
FLUSH = 1 << 20  # rows after which sums leave int64
CELL = 31  # bits of a limb of a sum
OUTPUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """n, the sums S of the integers (less ``offset``), and the components:
    eigenvalues of the covariance (falling), unit vectors, shares of its trace."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray  # components x D
    explained: np.ndarray


def _limbs(x: np.ndarray, count: int) -> list[np.ndarray]:
    """x = sum of parts * 2^(20 i); all but the last in 0 .. 2^20 - 1."""
    parts = []
    for _ in range(count - 1):
        parts.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return parts + [x.astype(np.float64)]


def scatter_kernel(width: int, limbs: int, cells: int):
    """Arrow-batch function: a task's sums of products x_i x_j (i <= j) and sums
    x_i (j = -1), as limbs of 31 bits."""

    def kernel(batches):
        total = np.zeros((width, width), dtype=object)
        sums = np.zeros(width, dtype=object)
        part = {(a, b): np.zeros((width, width), np.int64) for a in range(limbs) for b in range(a, limbs)}
        part_sums = np.zeros((limbs, width), np.int64)
        held = 0

        def flush() -> None:
            nonlocal total, sums
            for (a, b), m in part.items():
                own = (m if a == b else m + m.T).astype(object)
                total = total + own * (1 << LIMB * (a + b))
                m[:] = 0
            for a in range(limbs):
                sums = sums + part_sums[a].astype(object) * (1 << LIMB * a)
            part_sums[:] = 0

        seen = False
        for batch in batches:
            x = matrix(batch.column(0), width)
            for lo in range(0, len(x), CHUNK):
                seen = True
                pieces = _limbs(x[lo:lo + CHUNK], limbs)
                for (a, b), m in part.items():
                    m += (pieces[a].T @ pieces[b]).astype(np.int64)
                for a, piece in enumerate(pieces):
                    part_sums[a] += piece.sum(axis=0).astype(np.int64)
                held += len(pieces[0])
                if held > FLUSH:
                    flush()
                    held = 0
        if not seen:
            return
        flush()
        i, j = np.triu_indices(width)
        values = [*total[i, j], *sums]
        i, j = np.concatenate([i, np.arange(width)]), np.concatenate([j, np.full(width, -1)])
        columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32())]
        for c in range(cells):
            last = c == cells - 1
            columns.append(pa.array([v >> CELL * c if last else (v >> CELL * c) & ((1 << CELL) - 1) for v in values], pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *[f"c{c}" for c in range(cells)]])

    return kernel


def scatter(rows: DataFrame, n: int, width: int, largest: int) -> tuple[list[list[int]], list[int]]:
    """(n * sum(x x') - S S', S) of the column ``x``, exact."""
    limbs = max(1, -(-(largest.bit_length() + 1) // LIMB))
    cells = -(-(2 * largest.bit_length() + n.bit_length() + 2) // CELL) + 1
    names = [f"c{c}" for c in range(cells)]
    schema = "i int, j int, " + ", ".join(f"{c} long" for c in names)
    parts = rows.select("x").mapInArrow(scatter_kernel(width, limbs, cells), schema)
    found = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]).collect()  # D x D numbers
    products, sums = [[0] * width for _ in range(width)], [0] * width
    for r in found:
        value = sum(r[c] << CELL * k for k, c in enumerate(names))
        if r.j < 0:
            sums[r.i] = value
        else:
            products[r.i][r.j] = products[r.j][r.i] = value
    return [[n * products[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)], sums


def polynomial(spark, rows: list[list[int]]) -> list[int]:
    """Characteristic polynomial (constant first): a Spark row a prime, then
    one a coefficient."""
    dim = len(rows)
    primes = charpoly.primes_for(charpoly.coefficient_bits(sum(rows[i][i] for i in range(dim)), dim))
    sent = [[str(x) for x in r] for r in rows]

    def residues(batches):
        own = None
        for batch in batches:
            for p in batch.column(0).to_pylist():
                own = own or [[int(x) for x in r] for r in sent]
                c = charpoly.polynomial_mod(own, p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(dim + 1), pa.int32()), pa.array(np.full(dim + 1, p), pa.int64()), pa.array(c)], names=["k", "p", "r"])

    def together(table: pa.Table) -> pa.Table:
        value = charpoly.chinese_remainder(list(zip(table.column("p").to_pylist(), table.column("r").to_pylist())))
        return pa.table({"k": table.column("k").slice(0, 1), "value": pa.array([str(value)])})

    tasks = min(len(primes), max(1, spark.sparkContext.defaultParallelism))
    parts = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(residues, "k int, p long, r long")
    found = parts.groupBy("k").applyInArrow(together, "k int, value string").collect()  # D + 1 numbers
    value = {r.k: int(r.value) for r in found}
    return [value[k] for k in range(dim + 1)]


def components(spark, rows: list[list[int]], poly: list[int], count: int) -> tuple[list[int], np.ndarray, int]:
    """(roots * 2^bits falling, unit vectors, bits) of the ``count`` largest
    positive roots: a Spark row a root."""
    trace = sum(rows[i][i] for i in range(len(rows)))
    bits = max(0, charpoly.ROOT_BITS - trace.bit_length())
    large = charpoly.scaled(poly, bits)
    intervals = charpoly.isolate(large, count, trace << bits)
    if not intervals:
        return [], np.zeros((0, len(rows))), bits
    sent, coefficients = [[str(x) for x in r] for r in rows], [str(c) for c in large]

    def solve(batches):
        own = exact = None
        for batch in batches:
            for at, low, high, m in zip(*[c.to_pylist() for c in batch.columns]):
                own = own or [[int(x) for x in r] for r in sent]
                exact = exact or [int(c) for c in coefficients]
                root = charpoly.refine(exact, int(low), int(high)) if m == 1 else int(high)
                vectors = charpoly.null_vectors(own, bits, root, m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at] * m, pa.int32()), pa.array([str(root)] * m), pa.array(list(vectors), pa.list_(pa.float64()))], names=["at", "root", "v"])

    listed = [(i, str(low), str(high), m) for i, (low, high, m) in enumerate(intervals)]
    tasks = min(len(listed), max(1, spark.sparkContext.defaultParallelism))
    asked = spark.createDataFrame(listed, "at int, low string, high string, m int").repartition(tasks)
    found = sorted(asked.mapInArrow(solve, "at int, root string, v array<double>").collect(), key=lambda r: r.at)[:count]
    return [int(r.root) for r in found], np.array([r.v for r in found]), bits


def fit(rows: DataFrame, n: int, width: int, largest: int, count: int) -> Whitening:
    spark = rows.sparkSession
    cells, sums = scatter(rows, n, width, largest)
    trace = sum(cells[i][i] for i in range(width))
    if trace == 0:
        return Whitening(n, sums, np.zeros(0), np.zeros((0, width)), np.zeros(0))
    roots, vectors, bits = components(spark, cells, polynomial(spark, cells), count)
    values = np.array([r / (n * n << bits) for r in roots])
    return Whitening(n, sums, values, vectors, np.array([r / (trace << bits) for r in roots]))


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """x - S / n as doubles, from exact n x - S."""
    largest = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    if model.n * largest + max(map(abs, model.sums), default=0) < 1 << 62:
        return (model.n * x - np.array(model.sums, dtype=np.int64)) / model.n
    exact = x.astype(object) * model.n - np.array(model.sums, dtype=object)
    return (exact / model.n).astype(np.float64)


def _deviation(x: np.ndarray, model: Whitening) -> pa.Array:
    """sum of (n x - S)^2 = n^2 x.x - 2 n x.S + S.S, exact."""
    largest = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    each = model.n * largest + max(map(abs, model.sums), default=0)
    if len(model.sums) * each * each < 1 << 62:
        value = ((model.n * x - np.array(model.sums, dtype=np.int64)) ** 2).sum(axis=1)
        return pa.array(value).cast(pa.decimal128(38, 0))
    if len(model.sums) * largest * largest < 1 << 62:
        square = (x * x).sum(axis=1).astype(object)
    else:
        square = (x.astype(object) ** 2).sum(axis=1)
    cross = x.astype(object) @ np.array(model.sums, dtype=object)
    value = model.n**2 * square - 2 * model.n * cross + sum(s * s for s in model.sums)
    return pa.array([int(v) for v in value], pa.decimal128(38, 0))


def whiten(df: DataFrame, count: int = 32, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector and component (the ``count`` first, numbered from 1 by
    falling eigenvalue): vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    workers(spark)
    rows = whole_vectors(df, vector_col)
    # an offset of all integers cancels out of everything below
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), integers(F.col(f"`{vector_col}`"), scale).alias("x"))
    ends = F.array_max("x"), F.array_min("x")
    n, width, high, low = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(ends[0]), F.min(ends[1])).first()
    model = fit(rows, n, width, max(abs(high or 0), abs(low or 0)), count) if n and width else None
    if model is None or len(model.eigenvalues) == 0:
        return spark.createDataFrame([], OUTPUT)
    project = model.vectors.T / np.sqrt(model.eigenvalues)[None, :]
    k = project.shape[1]

    def moments(batches):
        sums, products, seen = np.zeros(k), np.zeros((k, k)), False
        for batch in batches:
            z = _centred(matrix(batch.column(0), width), model) @ project
            sums, products, seen = sums + z.sum(axis=0), products + z.T @ z, seen or len(z) > 0
        if seen:
            i, j = np.indices((k, k)).reshape(2, -1)
            i, j = np.concatenate([i, np.arange(k)]), np.concatenate([j, np.full(k, -1)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([products.ravel(), sums]))], names=["i", "j", "s"])

    found = rows.select("x").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # k x k numbers
    mean, second = np.zeros(k), np.zeros((k, k))
    for r in found:
        if r.j < 0:
            mean[r.i] = r.s / n
        else:
            second[r.i, r.j] = r.s / n
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())

    def emit(batches):
        for batch in batches:
            x = matrix(batch.column(1), width)
            z = _centred(x, model) @ project
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _deviation(x, model), pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], names=["vec_id", "deviation", "z"])

    wide = rows.select("vec_id", "x").mapInArrow(emit, "vec_id long, deviation decimal(38,0), z array<double>")
    long = wide.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(float(e)) for e in model.explained]), F.col("at"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       explained.alias("explained"), F.lit(error).alias("identity_error"))
