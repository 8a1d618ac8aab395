"""One distributed trainer for every binary problem of a code matrix.

Each iteration is one Spark job over the cached training rows. A vectorized
kernel (``mapInArrow``) takes an Arrow batch, looks up each row's targets in
the code matrix, computes all margins with one matmul and adds the hinge
sub-gradients of every still-active problem; the per-partition sums are
reduced by :mod:`multisvm.operators.partials`. The driver then applies the
update below to the P x D weights. Only the model crosses the wire, so P
problems cost one pass per iteration instead of P.

Update per problem (mini-batch sub-gradient descent with an L2 penalty, no
intercept), t = 1, 2, ...::

    g_t = sum over batch rows with y * (w . x) < 1 of  -y * x
    eta = step / sqrt(t)
    w_t = w_{t-1} * (1 - eta * reg) - eta * g_t / n_t
    stop once |w_t - w_{t-1}| < tol * max(|w_t|, 1)   (from the second update)

``n_t`` is the number of batch rows the problem uses. The batch of iteration t
is a run of hash buckets or a hash draw of every row (see :class:`SGDParams`;
all rows at fraction 1), chosen JVM-side before any row goes to Python.

A set small enough for one task (``fits_one_task``) needs no sums across tasks:
its rows are gathered in one and the steps run there, many a job
(:func:`steps_kernel`), with the same sums and the same update but without a
job an iteration. A job comes back after ``TASK_SECONDS`` with the state, so a
lost executor costs at most that.
"""

from __future__ import annotations

import copy
import math
import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from multisvm.functions.hashing import bucket_of, bucket_offset, bucket_run, in_fraction_expr
from multisvm.operators.blocks import SparseRows, feature_block, t_product
from multisvm.operators.coding import Coding, as_coding
from multisvm.operators import partials
from multisvm.operators.partials import PARTIAL_SCHEMA, features_matrix, list_column, partial_batch, reduce_partials
from multisvm.session import ship_package
from multisvm.sources.tables import FEATURES, ID, LABEL


# Weights that one job's tasks hold; the problems of a larger model are trained
# in blocks of this size, one job a block and iteration.
BLOCK_BYTES = 128 * 1024 * 1024
# Weights above this travel as a broadcast that is dropped after its iteration
# (smaller ones ride in the task closure).
CLOSURE_BYTES = 1024 * 1024
# Values of a kernel's temporaries: rows x problems at a time.
STEP_VALUES = 4_000_000
# Weights of single classes' problems that a task keeps sorted out (see hinge_sums).
KEPT_BYTES = 64 * 1024 * 1024
# A training set of at most so many values, and multiplications of a step, is
# trained inside one task; it returns its state after so many seconds. The rows
# all go to that task: some 100 bytes for four values.
ONE_TASK_VALUES = 4_000_000
ONE_TASK_WORK = 100_000_000
TASK_SECONDS = 30.0


def problem_blocks(keys: np.ndarray, dim: int, block_bytes: int | None = None) -> list[np.ndarray]:
    """The problems in blocks whose weights fit ``block_bytes``."""
    each = max(1, (BLOCK_BYTES if block_bytes is None else block_bytes) // (8 * max(1, dim)))
    return [keys[i:i + each] for i in range(0, len(keys), each)]


# Column holding a row's fixed mini-batch bucket (bucketed batches only).
BUCKET = "_bucket"

# Rows per partition below which the training cache is merged (fewer, shorter
# tasks per iteration) and above which a too-narrow input is spread out.
MIN_ROWS_PER_PARTITION = 16_384
# Feature values of one cached partition (what a task of an iteration may read, at most).
MAX_VALUES_PER_PARTITION = 4_000_000
# Slots (parts of a bucket) dealt to each partition, so that all get the same share.
SLOTS_PER_PARTITION = 64


def wanted_partitions(current: int, n_rows: int, cores: int, dim: int = 1) -> int:
    """Partition count fit for iterating: spread an input too narrow for its
    rows or their size, merge tiny partitions, otherwise keep the file splits."""
    wanted = max(1, min(cores, math.ceil(n_rows / MIN_ROWS_PER_PARTITION)))
    wanted = max(wanted, math.ceil(n_rows * max(1, dim) / MAX_VALUES_PER_PARTITION))
    if current < wanted:
        return wanted
    if n_rows < current * MIN_ROWS_PER_PARTITION and current > wanted:
        return wanted
    return current


def cache_rows(df: DataFrame, storage_level: StorageLevel = StorageLevel.MEMORY_AND_DISK,
               checkpoint: bool = False) -> DataFrame:
    """Persist the training rows (lazily: the first action fills the cache).

    Lost cached blocks are recomputed from the (short, fixed) source lineage;
    pass ``StorageLevel.DISK_ONLY`` when the rows exceed cluster memory.
    ``checkpoint=True`` first writes the rows to ``spark.checkpoint.dir``
    (reliable checkpoint): lost blocks are then re-read from there instead of
    re-parsing an expensive source such as LibSVM or CSV text.
    """
    if checkpoint:
        from multisvm.session import checkpoint_dir

        checkpoint_dir(df.sparkSession)  # the cluster's setting; a local folder only when unset
        df = df.checkpoint(eager=True)
    return df.persist(storage_level)


def bucket_partition(bucket, key, buckets: int, target: int):
    """Partition of a row: buckets are cut into slots by a hash of the key, and
    slots dealt out in turn. Any run of buckets then falls evenly on all
    partitions, also where there are more partitions than buckets."""
    parts = max(1, -(-SLOTS_PER_PARTITION * target // buckets))
    slot = bucket.cast("long") * parts + F.pmod(F.xxhash64(key), F.lit(parts))
    return F.pmod(slot, F.lit(target)).cast("int")


def relayout(cached: DataFrame, n_rows: int,
             storage_level: StorageLevel = StorageLevel.MEMORY_AND_DISK,
             params: "SGDParams | None" = None, dim: int = 1, target: int | None = None) -> DataFrame:
    """Re-partition an already cached (and filled) training set if its layout
    is unfit for iterating; the new cache is filled from the old one, then the
    old one is released. Each iteration runs one task per partition.

    With bucketed mini-batches the rows get their bucket, every bucket is dealt
    over the partitions (``bucket_partition``: one shuffle from the cache, each
    row placed exactly) and partitions are sorted by bucket, so an iteration's
    range test skips most cached batches in every task. The number of
    partitions follows from the rows and their width (or ``target``).
    """
    current = cached.rdd.getNumPartitions()
    target = target or wanted_partitions(current, n_rows, cached.sparkSession.sparkContext.defaultParallelism, dim)
    if params is not None and params.bucketed:
        with_b = cached.withColumn(BUCKET, bucket_of(params.seed, F.col(ID), params.n_buckets))
        if target > 1:
            with_b = with_b.repartitionById(target, bucket_partition(F.col(BUCKET), F.col(ID), params.n_buckets, target))
        else:
            with_b = with_b.coalesce(1)
        moved = with_b.sortWithinPartitions(BUCKET).persist(storage_level)
    elif target == current:
        return cached
    else:
        moved = (cached.repartition(target) if target > current else cached.coalesce(target)).persist(storage_level)
    moved.count()
    cached.unpersist()
    return moved


@dataclass(frozen=True)
class SGDParams:
    """Hyper-parameters. ``batch_mode``:

    * 'bucket' (default): each row has a fixed bucket (md5 of seed and id, mod
      ``buckets``); iteration t takes a run of ``round(fraction * buckets)``
      consecutive buckets from a hashed offset. With the cache laid out by
      bucket, the in-memory scan skips the other buckets' batches, so an
      iteration reads about ``fraction`` of the data and hashes nothing
      (20M cached rows: 0.18 s vs 2.2 s for per-row md5 draws).
    * 'row': each row is drawn into iteration t's batch independently
      (md5 of seed, t, id) -- the per-row Bernoulli draw of Spark's sampler,
      at the cost of hashing every cached row every iteration.

    Both give every row the same inclusion probability ``fraction``.
    """

    iterations: int = 100
    step: float = 1.0
    reg: float = 0.01
    fraction: float = 1.0
    seed: int = 42
    tol: float = 0.001
    batch_mode: str = "bucket"
    buckets: int = 1024

    @property
    def bucketed(self) -> bool:
        return self.batch_mode == "bucket" and self.fraction < 1.0

    @property
    def n_buckets(self) -> int:
        """``buckets``, doubled until rounding to whole buckets changes the
        fraction by 2 % at most."""
        n, f = self.buckets, self.fraction
        while f > 0 and abs(max(1, round(f * n)) / (n * f) - 1) > 0.02 and n < 1 << 30:
            n *= 2
        return n

    @property
    def bucket_width(self) -> int:
        return max(1, min(self.n_buckets, int(round(self.fraction * self.n_buckets))))


@dataclass
class FitResult:
    weights: np.ndarray  # P x D
    iterations: np.ndarray  # updates applied per problem
    converged: np.ndarray  # bool per problem
    history: list = field(default_factory=list)  # seconds per iteration


def fits_one_task(n_rows: int, dim: int, per_row: int, fraction: float = 1.0) -> bool:
    """The rows, and a step's products of a fraction of them with ``per_row``
    vectors each, are small enough for one task."""
    return n_rows * dim <= ONE_TASK_VALUES and min(fraction, 1.0) * n_rows * dim * per_row <= ONE_TASK_WORK


def trains_in_task(n_rows: int, dim: int, code: Coding, params: SGDParams) -> bool:
    """``fits_one_task`` with the model's size (per-row draws hash every row
    JVM-side and stay there)."""
    per_row = code.p if code.dense else min(code.p, code.k)
    drawn = params.bucketed or params.fraction >= 1.0
    return drawn and 8 * code.p * dim <= BLOCK_BYTES and fits_one_task(n_rows, dim, per_row, params.fraction)


def gathered(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the rows in one partition, in an order (of the id's hash)
    that no layout of the input changes."""
    rows = rows.select(F.xxhash64(ID).alias("_order"), *columns)
    return rows.repartition(1).sortWithinPartitions("_order").select(*columns)


class State:
    """Weights and progress of every problem."""

    def __init__(self, p: int, dim: int):
        self.weights = np.zeros((p, dim))
        self.iterations = np.zeros(p, dtype=np.int64)
        self.converged = np.zeros(p, dtype=bool)
        self.updated_once = np.zeros(p, dtype=bool)

    def active(self) -> np.ndarray:
        return np.flatnonzero(~self.converged)

    def update(self, t: int, keys: np.ndarray, grad: np.ndarray, used: np.ndarray, params: SGDParams) -> None:
        """The update of iteration t for problems ``keys``; a problem without a
        row in the batch keeps its weights."""
        some = used > 0
        at = np.flatnonzero(some)
        eta = params.step / math.sqrt(t)
        step = max(1, STEP_VALUES // max(1, self.weights.shape[1]))
        for lo in range(0, len(at), step):
            part = at[lo:lo + step]
            own = keys[part]
            old = self.weights[own]
            new = old * (1.0 - eta * params.reg) + (-eta) * (grad[part] / used[part][:, None].astype(float))
            finite = np.isfinite(new).all(axis=1)
            if not finite.all():
                raise ValueError(f"problem {own[~finite][0]}: weights are not finite after iteration {t}; check the features")
            self.weights[own] = new
            self.iterations[own] += 1
            size = np.sqrt(np.einsum("ij,ij->i", new, new))
            new -= old
            moved = np.sqrt(np.einsum("ij,ij->i", new, new))
            self.converged[own] = self.updated_once[own] & (moved < params.tol * np.maximum(size, 1.0))
            self.updated_once[own] = True


def class_index(labels: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Position of each label in the sorted classes, -1 where absent."""
    at = np.clip(np.searchsorted(classes, labels), 0, len(classes) - 1)
    return np.where(classes[at] == labels, at, -1)


def hinge_sums(x, index: np.ndarray, code: Coding, keys: np.ndarray, w: np.ndarray, grad: np.ndarray, used: np.ndarray,
               kept: dict | None = None) -> None:
    """Add the rows' hinge sub-gradients for problems ``keys`` (weights ``w``) to
    ``grad`` and their row counts to ``used``.

    With a dense code (one-vs-all) rows are multiplied by all problems. With
    zeros in the code (one-vs-one, tree) rows are grouped by class and each
    group is multiplied only by the problems that class takes part in: K-1 of
    K(K-1)/2 for one-vs-one, the nodes on its path for the tree. Temporaries
    hold ``STEP_VALUES`` values at most beside the rows. ``kept`` keeps classes'
    weights for the next batch.
    """
    n = len(index)
    if code.dense:
        step = max(1, STEP_VALUES // max(1, len(keys)))
        w_t = np.ascontiguousarray(w.T) if isinstance(x, SparseRows) else w.T
        for lo in range(0, n, step):
            part = x if n <= step else x[np.arange(lo, min(n, lo + step))]
            y = code.signs(index[lo:lo + step], keys)
            active = np.where(y * (part @ w_t) < 1.0, y, 0.0)
            grad -= t_product(active, part)
            used += np.count_nonzero(y, axis=0)
        return
    kept = {} if kept is None else kept
    order = np.argsort(index, kind="stable")
    present, starts = np.unique(index[order], return_index=True)
    for c, lo, hi in zip(present, starts, [*starts[1:], n]):
        if c < 0:
            continue
        if c not in kept:
            cols, y = code.entries(int(c))
            if len(keys) != code.p:
                at = np.searchsorted(keys, cols)
                own = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == cols)
                cols, y = at[own], y[own]
            found = cols, y.astype(float), np.ascontiguousarray(w[cols].T)
            if (len(kept) + 1) * found[2].nbytes <= KEPT_BYTES:
                kept[c] = found
        else:
            found = kept[c]
        cols, y, w_t = found
        if len(cols) == 0:
            continue
        step = max(1, STEP_VALUES // len(cols))
        for a in range(lo, hi, step):
            rows = x[order[a:min(hi, a + step)]]
            active = np.where(y[None, :] * (rows @ w_t) < 1.0, y[None, :], 0.0)
            grad[cols] -= t_product(active, rows)
        used[cols] += hi - lo


def shared(spark, value, size: int):
    """``value`` itself if it fits a closure, else a broadcast of it (one copy an
    executor's disk, read once a worker); ``fetch`` gives it back in a task."""
    return value if size <= CLOSURE_BYTES else spark.sparkContext.broadcast(value)


def fetch(sent):
    return sent.value if hasattr(sent, "unpersist") else sent


def gradient_kernel(classes: np.ndarray, code, weights, keys, dim: int, span: int | None = None):
    """Arrow-batch function: partial hinge sub-gradients for problems ``keys``.

    ``code`` is a :class:`Coding` or a K x P matrix, ``weights`` is len(keys) x D;
    those and ``keys`` may be broadcasts.
    """
    classes, code = np.asarray(classes, dtype=np.int64), as_coding(code)
    span = partials.SPAN if span is None else span

    def kernel(batches):
        w, own = fetch(weights), fetch(keys)
        grad = np.zeros((len(own), dim))
        used = np.zeros(len(own), dtype=np.int64)
        kept: dict = {}
        seen = False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            seen = True
            labels = batch.column(LABEL).to_numpy(zero_copy_only=False).astype(np.int64)
            hinge_sums(feature_block(batch.column(FEATURES), dim), class_index(labels, classes), code, own, w, grad, used, kept)
        if seen:
            yield partial_batch(np.arange(len(own)), used, grad, span)

    return kernel


STATE_SCHEMA = StructType([
    StructField("k", IntegerType(), False),
    StructField("iterations", LongType(), False),
    StructField("converged", BooleanType(), False),
    StructField("updated_once", BooleanType(), False),
    StructField("g", ArrayType(DoubleType(), False), False),
])
_ARROW_STATE = to_arrow_schema(STATE_SCHEMA)


def steps_kernel(classes: np.ndarray, code: Coding, state, dim: int, params: SGDParams, first: int, seconds: float):
    """Arrow-batch function for the gathered rows of a small set: iterations
    from ``first`` on, until all are done, everything converged or ``seconds``
    have gone. Rows out: one a problem, and k = -1 with each step's seconds."""
    classes = np.asarray(classes, dtype=np.int64)

    def kernel(batches):
        held = [(feature_block(b.column(FEATURES), dim), b.column(LABEL).to_numpy(zero_copy_only=False).astype(np.int64),
                 b.column(BUCKET).to_numpy(zero_copy_only=False) if params.bucketed else None) for b in batches if b.num_rows]
        if not held:
            return
        x = np.concatenate([b.toarray() if isinstance(b, SparseRows) else b for b, _, _ in held])
        index = class_index(np.concatenate([b for _, b, _ in held]), classes)
        if params.bucketed:  # a batch of an iteration is then one or two slices
            bucket = np.concatenate([b for _, _, b in held])
            order = np.argsort(bucket, kind="stable")
            x, index, bucket = x[order], index[order], bucket[order]
        del held
        now: State = copy.deepcopy(fetch(state))  # a retried task starts from the same state
        began, took, t = time.perf_counter(), [], first
        while t <= params.iterations and len(keys := now.active()) and (t == first or time.perf_counter() - began < seconds):
            start = time.perf_counter()
            slices = [slice(0, len(index))]
            if params.bucketed:
                offset, width, buckets = bucket_offset(params.seed, t, params.n_buckets), params.bucket_width, params.n_buckets
                runs = [(offset, min(buckets, offset + width)), (0, max(0, offset + width - buckets))] if width < buckets else [(0, buckets)]
                slices = [slice(*np.searchsorted(bucket, run)) for run in runs]
            grad, used = np.zeros((len(keys), dim)), np.zeros(len(keys), dtype=np.int64)
            w, kept = now.weights[keys], {}
            for rows in slices:
                if rows.stop > rows.start:
                    hinge_sums(x[rows], index[rows], code, keys, w, grad, used, kept)
            now.update(t, keys, grad, used, params)
            took.append(time.perf_counter() - start)
            t += 1
        kind = _ARROW_STATE.field("g").type
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([False]), pa.array([False]),
             list_column(np.array([took])).cast(kind)], schema=_ARROW_STATE)
        step = max(1, STEP_VALUES // max(1, dim))
        for lo in range(0, len(now.weights), step):
            part = now.weights[lo:lo + step]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(lo, lo + len(part)), pa.int32()), pa.array(now.iterations[lo:lo + step]), pa.array(now.converged[lo:lo + step]),
                 pa.array(now.updated_once[lo:lo + step]), list_column(part).cast(kind)], schema=_ARROW_STATE)

    return kernel


def fit_in_task(data: DataFrame, code: Coding, classes, dim: int, params: SGDParams, seconds: float = TASK_SECONDS) -> FitResult:
    """Train on a small set, many steps a job."""
    state, history, t = State(code.p, dim), [], 1
    rows = gathered(data, LABEL, FEATURES, *([BUCKET] if params.bucketed else []))
    while t <= params.iterations and len(state.active()):
        sent = shared(data.sparkSession, state, state.weights.nbytes)
        out = rows.mapInArrow(steps_kernel(classes, code, sent, dim, params, t, seconds), STATE_SCHEMA).toArrow()
        if sent is not state:
            sent.unpersist()
        k = out.column("k").to_numpy()
        if len(k) == 0:
            break  # no rows, no update
        mine = np.flatnonzero(k >= 0)
        took = out.column("g")[int(np.flatnonzero(k < 0)[0])].as_py()
        state.weights[k[mine]] = features_matrix(out.column("g").take(pa.array(mine)), dim)
        for name in ("iterations", "converged", "updated_once"):
            getattr(state, name)[k[mine]] = out.column(name).to_numpy()[mine]
        history += took
        t += len(took)
    return FitResult(state.weights, state.iterations, state.converged, history)


def fit_coded(train: DataFrame, code, classes, dim: int, params: SGDParams, cache: bool = True,
              block_bytes: int | None = None, in_task: bool | None = None) -> FitResult:
    """Train every column of ``code`` at once on ``train`` (id, label, features).

    A model larger than ``block_bytes`` (``BLOCK_BYTES``) is trained in blocks
    of problems; they do not depend on each other, so the weights are the same.
    ``in_task``: gather the rows in one task and run the steps there (None: if
    they are one partition and ``trains_in_task`` says so).
    """
    code = as_coding(code)
    spark = train.sparkSession
    ship_package(spark)
    if params.bucketed and BUCKET not in train.columns:
        train = train.withColumn(BUCKET, bucket_of(params.seed, F.col(ID), params.n_buckets))
    data = train.select(ID, LABEL, FEATURES, *([BUCKET] if params.bucketed else []))
    if cache:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_parts = data.rdd.getNumPartitions()
        if in_task is None:
            in_task = block_bytes is None and n_parts == 1 and trains_in_task(data.count(), dim, code, params)
        if in_task:
            return fit_in_task(data, code, classes, dim, params)
        state, history = State(code.p, dim), []
        for t in range(1, params.iterations + 1):
            keys = state.active()
            if len(keys) == 0:
                break
            start = time.perf_counter()
            batch = data
            if params.bucketed:
                offset = bucket_offset(params.seed, t, params.n_buckets)
                batch = data.where(bucket_run(BUCKET, offset, params.bucket_width, params.n_buckets))
            elif params.fraction < 1.0:
                batch = data.where(in_fraction_expr(f"{params.seed}:{t}", ID, params.fraction))
            batch = batch.select(LABEL, FEATURES)  # all that goes to Python
            for block in problem_blocks(keys, dim, block_bytes):
                own = state.weights[block]
                size = own.nbytes + block.nbytes
                sent, sent_keys = shared(spark, own, size), shared(spark, block, size)
                parts = batch.mapInArrow(gradient_kernel(classes, code, sent, sent_keys, dim), PARTIAL_SCHEMA)
                state.update(t, block, *reduce_partials(parts, len(block), dim, n_parts), params)
                for b in (sent, sent_keys):
                    if b is not own and b is not block:
                        b.unpersist()
            history.append(time.perf_counter() - start)
    finally:
        if cache:
            data.unpersist()
    return FitResult(state.weights, state.iterations, state.converged, history)
