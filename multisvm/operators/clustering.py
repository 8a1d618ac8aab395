"""k-means for the cluster tree, and the class -> cluster map built from it.

Two ways to fit the centres:

* ``kmeans_fit(..., init="k-means||")`` uses ``pyspark.ml.clustering.KMeans``
  (seeded; the centres depend on the partitioning, as Spark documents);
* ``lloyd(...)`` runs Lloyd iterations from explicit starting centres (by
  default the rows with the lowest and highest id). Each iteration is one job:
  a vectorized kernel assigns rows to the nearest centre and emits per-cluster
  partial sums; the driver divides. A set small enough for one task is gathered
  there and iterated in one job (:func:`lloyd_steps`). Same stop rule as Spark's
  k-means: stop once no centre moved more than ``tol``. Reproducible, so SQL can
  check it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from multisvm.operators.blocks import feature_block, squared_distances, t_product
from multisvm.operators.partials import PARTIAL_SCHEMA, partial_batch, reduce_partials
from multisvm.operators.trainer import fetch, fits_one_task, gathered, shared
from multisvm.session import ship_package
from multisvm.sources.tables import FEATURES, ID, LABEL

CLUSTER = "cluster"


def lloyd_kernel(sent, k: int, dim: int):
    """Arrow-batch function: partial sums and counts by nearest centre (``sent``:
    the centres or a broadcast of them)."""

    def kernel(batches):
        centres = fetch(sent)
        sums = np.zeros((k, dim))
        counts = np.zeros(k, dtype=np.int64)
        seen = False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            seen = True
            x = feature_block(batch.column(FEATURES), dim)
            nearest = np.argmin(squared_distances(x, centres), axis=1)
            sums += t_product(np.eye(k)[nearest], x)
            counts += np.bincount(nearest, minlength=k)
        if seen:
            yield partial_batch(np.arange(k), counts, sums)

    return kernel


def first_last_centres(data: DataFrame) -> np.ndarray:
    """Features of the rows with the lowest and the highest id (one aggregate)."""
    row = data.agg(
        F.min_by(FEATURES, ID).alias("lo"),
        F.max_by(FEATURES, ID).alias("hi"),
    ).first()
    return np.array([_dense(row.lo), _dense(row.hi)], dtype=np.float64)


def _dense(v) -> np.ndarray:
    return np.asarray(v.toArray() if hasattr(v, "toArray") else v, dtype=np.float64)


def moved_centres(centres: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """(means, largest squared move); an empty cluster keeps its centre."""
    new, filled = centres.copy(), counts > 0
    new[filled] = sums[filled] / counts[filled][:, None]
    return new, float(((new - centres) ** 2).sum(axis=1).max())


def lloyd_steps(sent, max_iter: int, tol: float):
    """Arrow-batch function for the gathered rows of a small set: all iterations.
    Emits the centres as partial rows whose count is the iterations run."""

    def kernel(batches):
        now, done = fetch(sent), 0
        held = [feature_block(b.column(FEATURES), now.shape[1]) for b in batches if b.num_rows]
        while held and done < max_iter:
            sums, counts = np.zeros_like(now), np.zeros(len(now), dtype=np.int64)
            for x in held:
                nearest = np.argmin(squared_distances(x, now), axis=1)
                sums += t_product(np.eye(len(now))[nearest], x)
                counts += np.bincount(nearest, minlength=len(now))
            now, moved = moved_centres(now, sums, counts)
            done += 1
            if moved <= tol * tol:
                break
        yield partial_batch(np.arange(len(now)), np.full(len(now), done), now)

    return kernel


def lloyd(data: DataFrame, centres: np.ndarray, max_iter: int, tol: float = 1e-4,
          cache: bool = True, n_rows: int | None = None, in_task: bool | None = None) -> tuple[np.ndarray, int]:
    """Lloyd iterations from ``centres``; returns (centres, iterations run).
    ``in_task``: gather the rows in one task (None: if they fit)."""
    ship_package(data.sparkSession)
    centres = np.array(centres, dtype=np.float64)
    k, dim = centres.shape
    order = [ID] if ID in data.columns else []
    data = data.select(*order, FEATURES)
    if cache:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if in_task is None:
            in_task = fits_one_task(data.count() if n_rows is None else n_rows, dim, k)
        if in_task:
            one = gathered(data, FEATURES) if order else data.coalesce(1)
            found = reduce_partials(one.mapInArrow(lloyd_steps(shared(data.sparkSession, centres, centres.nbytes), max_iter, tol), PARTIAL_SCHEMA), k, dim, 1)
            return found[0], int(found[1][0])
        data = data.select(FEATURES)
        n_parts = data.rdd.getNumPartitions()
        done = 0
        for it in range(max_iter):
            sent = shared(data.sparkSession, centres, centres.nbytes)
            parts = data.mapInArrow(lloyd_kernel(sent, k, dim), PARTIAL_SCHEMA)
            sums, counts = reduce_partials(parts, k, dim, n_parts)
            if sent is not centres:
                sent.unpersist()
            centres, moved = moved_centres(centres, sums, counts)
            done = it + 1
            if moved <= tol * tol:
                break
        return centres, done
    finally:
        if cache:
            data.unpersist()


def kmeans_fit(data: DataFrame, k: int = 2, max_iter: int = 20, seed: int | None = 42,
               init: str = "first_last", tol: float = 1e-4, cache: bool = True, n_rows: int | None = None) -> np.ndarray:
    """Centres (k x D). ``init``: 'first_last' (k = 2, Lloyd, reproducible) or
    'k-means||' / 'random' (Spark ML)."""
    if init == "first_last":
        if k != 2:
            raise ValueError("first_last init gives exactly two centres")
        return lloyd(data, first_last_centres(data), max_iter, tol, cache=cache, n_rows=n_rows)[0]
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feat = F.col(FEATURES)
    if isinstance(data.schema[FEATURES].dataType, ArrayType):
        feat = array_to_vector(feat.cast("array<double>"))
    vec = data.select(feat.alias("v"))
    est = KMeans(k=k, maxIter=max_iter, tol=tol, initMode=init, featuresCol="v")
    if seed is not None:
        est = est.setSeed(seed)
    model = est.fit(vec)
    return np.array([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])


def assign_clusters(df: DataFrame, centres: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """``keep`` + nearest ``cluster`` (ties: lower index) + its squared ``distance``."""
    ship_package(df.sparkSession)
    centres = np.asarray(centres, dtype=np.float64)
    dim = centres.shape[1]
    keep = list(keep)
    schema = StructType([df.schema[c] for c in keep] + [
        StructField(CLUSTER, IntegerType(), False),
        StructField("distance", DoubleType(), False),
    ])
    arrow_schema = to_arrow_schema(schema)
    sent = shared(df.sparkSession, centres, centres.nbytes)

    def kernel(batches):
        centres = fetch(sent)
        for batch in batches:
            x = feature_block(batch.column(FEATURES), dim)
            d = squared_distances(x, centres) if len(x) else np.zeros((0, len(centres)))
            nearest = np.argmin(d, axis=1) if len(x) else np.zeros(0, dtype=np.int64)
            best = d[np.arange(len(x)), nearest] if len(x) else np.zeros(0)
            cols = [batch.column(c) for c in keep] + [
                pa.array(nearest.astype(np.int32), pa.int32()),
                pa.array(best.astype(np.float64), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow_schema)

    return df.select(*keep, FEATURES).mapInArrow(kernel, schema)


def class_cluster_counts(assigned: DataFrame) -> DataFrame:
    """Rows per (class, cluster): one map-side-combined aggregate for all classes."""
    return assigned.groupBy(LABEL, CLUSTER).agg(F.count(F.lit(1)).alias("n"))


def class_to_cluster(counts: DataFrame) -> DataFrame:
    """Per class: its majority cluster (tie -> lower cluster) and an error equal
    to the square of its smallest observed cluster count. A class seen in one
    cluster only gets count squared (its "least popular" cluster is the same
    one), so it sorts after the split classes."""
    best = F.max(F.struct(F.col("n"), (-F.col(CLUSTER)).alias("neg_cluster")))
    return counts.groupBy(LABEL).agg(best.alias("best"), F.min("n").alias("least")).select(
        F.col(LABEL),
        (-F.col("best.neg_cluster")).cast("int").alias(CLUSTER),
        (F.col("least") * F.col("least")).cast("long").alias("err"),
    )


def cluster_class_order(c2c: DataFrame) -> DataFrame:
    """Position of each class inside its cluster: by error, then label (K rows)."""
    w = Window.partitionBy(CLUSTER).orderBy("err", LABEL)
    return c2c.select(CLUSTER, (F.row_number().over(w) - 1).cast("int").alias("position"), LABEL)
