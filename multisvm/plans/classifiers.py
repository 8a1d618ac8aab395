"""The three multiclass classifiers: one trainer, three code matrices, three
decoders.

``fit`` plans the code on the driver from K-sized facts (class list, class ->
cluster map), trains every binary problem together with :func:`fit_coded`, and
returns a model whose ``transform`` adds ``margins`` and ``prediction`` to any
labelled frame (batch or streaming). The driver holds the model (P x D weights);
one larger than ``MODEL_BYTES`` is refused before anything is trained.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from multisvm.functions.decode import argmax_label, tree_walk, vote_winner
from multisvm.operators.clustering import (
    CLUSTER, assign_clusters, class_cluster_counts, class_to_cluster, kmeans_fit,
)
from multisvm.operators.coding import (
    Coding, OneVsAllCoding, PairCoding, TreeCoding, class_pairs, collect_inventory, tree_layout,
)
from multisvm.operators.metrics import PREDICTION
from multisvm.operators.scoring import MARGINS, VOTES, ProblemBlocks, score
from multisvm.operators.trainer import FitResult, SGDParams, cache_rows, fit_coded, relayout, trains_in_task
from multisvm.sources.tables import FEATURES, ID, LABEL

# Hyper-parameters of the three reference programs (iterations, step, reg, batch fraction).
OVA_DEFAULTS = SGDParams(iterations=250, step=4.0, reg=0.01, fraction=0.25)
OVO_DEFAULTS = SGDParams(iterations=400, step=4.0, reg=1e-5, fraction=0.5)
TREE_DEFAULTS = SGDParams(iterations=500, step=4.0, reg=1e-6, fraction=0.5)

# Largest model: the driver holds its weights and one block of gradients (one-vs-one
# of 1,000 classes over 64 features is 256 MB, of 5,000 classes 6.4 GB).
MODEL_BYTES = 8 * 1024**3


@dataclass
class CodedModel:
    """Weights of every binary problem plus what the decoder needs."""

    scheme: str
    classes: list[int]
    code: np.ndarray | Coding
    weights: np.ndarray
    fit: FitResult | None = None
    nodes: list[dict] = field(default_factory=list)
    centres: np.ndarray | None = None
    class_clusters: list[tuple[int, int, int]] = field(default_factory=list)
    pairs: list[tuple[int, int]] | None = None  # one-vs-one: must be all pairs in order, as :func:`class_pairs` lists them
    _blocks: tuple | None = field(default=None, repr=False, compare=False)

    def __post_init__(self):
        if self.pairs is not None and self.pairs != class_pairs(len(self.classes)):
            raise ValueError("pairs must be those of class_pairs, in its order")

    @property
    def problems(self) -> int:
        return self.weights.shape[0]

    def blocks(self, spark) -> ProblemBlocks:
        """The weights as tasks get them, sent once an application."""
        key = spark.sparkContext.applicationId
        if self._blocks is None or self._blocks[0] != key:
            self._blocks = (key, ProblemBlocks(spark, self.weights))
        return self._blocks[1]

    def margins(self, df: DataFrame, keep=(ID, LABEL), emit_margins: bool = True) -> DataFrame:
        """``keep`` + margins (+ per-class ``votes`` for one-vs-one)."""
        return score(df, self.blocks(df.sparkSession), keep, self.scheme, self.classes, self.nodes, margins=emit_margins, votes=self.scheme == "ovo")

    def decode(self) -> Column:
        if len(self.classes) == 1:
            return F.lit(int(self.classes[0]))
        if self.scheme == "ova":
            return argmax_label(F.col(MARGINS), self.classes)
        if self.scheme == "ovo":
            return vote_winner(F.col(VOTES), self.classes)
        if self.scheme == "tree":
            return tree_walk(F.col(MARGINS), self.nodes)
        raise ValueError(self.scheme)

    def transform(self, df: DataFrame, keep=None, margins: bool = True, labels_only: bool = False) -> DataFrame:
        """``keep`` columns + margins (+ votes) + prediction (int).

        ``margins=False`` drops the one-vs-one margin array from the output
        (K(K-1)/2 doubles per row). ``labels_only`` decodes inside the scoring
        kernel: a row's prediction is all that comes back, for every scheme."""
        keep = list(keep) if keep is not None else [c for c in df.columns if c != FEATURES]
        if labels_only:
            return score(df, self.blocks(df.sparkSession), keep, self.scheme, self.classes, self.nodes, labels=True)
        scored = self.margins(df, keep, emit_margins=margins or self.scheme != "ovo")
        return scored.withColumn(PREDICTION, self.decode().cast("int"))


class _Trainer:
    scheme = ""
    defaults = SGDParams()

    def __init__(self, params: SGDParams | None = None, storage_level: StorageLevel | None = None,
                 checkpoint: bool = False, **overrides):
        base = params or self.defaults
        self.params = SGDParams(**{**base.__dict__, **overrides})
        self.storage_level = storage_level or StorageLevel.MEMORY_AND_DISK
        self.checkpoint = checkpoint

    def problems(self, k: int) -> Coding:
        """The code of this scheme, or one of as many problems and entries."""
        raise NotImplementedError

    def _prepare(self, df: DataFrame):
        """Persist the rows; the class inventory is the action that fills the
        cache (one read of the source), then re-lay out only if needed.
        Returns (rows, inventory, whether a task holds them all)."""
        cached = cache_rows(df.select(ID, LABEL, FEATURES), self.storage_level, self.checkpoint)
        try:
            inv = collect_inventory(cached)
            code, n = self.problems(inv.k), sum(inv.counts)
            if 8 * code.p * inv.dim > MODEL_BYTES:
                raise ValueError(f"{code.p} problems of {inv.dim} features need {8 * code.p * inv.dim >> 20} MB of weights, over {MODEL_BYTES >> 20} MB")
            if trains_in_task(n, inv.dim, code, self.params):
                return cached, inv, True
            return relayout(cached, n, self.storage_level, self.params, inv.dim), inv, False
        except Exception:
            cached.unpersist()
            raise


class OneVsAll(_Trainer):
    """One problem per class against all others; predict the largest margin."""

    scheme = "ova"
    defaults = OVA_DEFAULTS

    def problems(self, k):
        return OneVsAllCoding(k)

    def fit(self, df: DataFrame) -> CodedModel:
        data, inv, in_task = self._prepare(df)
        try:
            code = self.problems(inv.k)
            res = fit_coded(data, code, inv.classes, inv.dim, self.params, cache=False, in_task=in_task)
            return CodedModel("ova", list(inv.classes), code, res.weights, res)
        finally:
            data.unpersist()


class OneVsOne(_Trainer):
    """One problem per pair of classes; each votes, most votes wins (ties: lowest label)."""

    scheme = "ovo"
    defaults = OVO_DEFAULTS

    def problems(self, k):
        return PairCoding(k)

    def fit(self, df: DataFrame) -> CodedModel:
        data, inv, in_task = self._prepare(df)
        try:
            code = self.problems(inv.k)
            res = fit_coded(data, code, inv.classes, inv.dim, self.params, cache=False, in_task=in_task)
            return CodedModel("ovo", list(inv.classes), code, res.weights, res)
        finally:
            data.unpersist()


class ClusterTree(_Trainer):
    """k-means (k = 2) groups the classes; a tree of K-1 SVMs separates the
    groups, then halves each group's class list (ordered by cluster error).

    ``kmeans_init``: 'k-means||' (default, Spark ML, seeded) or 'first_last'
    (Lloyd from the lowest- and highest-id rows: reproducible in any engine).
    k-means runs at most ``kmeans_iterations`` (default: the SVM iteration
    count, as in the reference) iterations."""

    scheme = "tree"
    defaults = TREE_DEFAULTS

    def __init__(self, params: SGDParams | None = None, kmeans_init: str = "k-means||",
                 kmeans_iterations: int | None = None, kmeans_tol: float = 1e-4,
                 storage_level: StorageLevel | None = None, checkpoint: bool = False, **overrides):
        super().__init__(params, storage_level, checkpoint, **overrides)
        self.kmeans_init = kmeans_init
        self.kmeans_iterations = kmeans_iterations
        self.kmeans_tol = kmeans_tol

    def problems(self, k):
        return OneVsAllCoding(max(1, k - 1))  # nodes of the tree, before it is laid out

    def plan(self, data: DataFrame, cached: bool = False, n_rows: int | None = None) -> tuple[np.ndarray, list[tuple[int, int, int]], list[dict], list[int]]:
        """Centres, class -> (cluster, err) map and node layout (no SVM trained yet)."""
        iters = self.kmeans_iterations or self.params.iterations
        centres = kmeans_fit(data, 2, iters, self.params.seed, self.kmeans_init, self.kmeans_tol, cache=not cached, n_rows=n_rows)
        assigned = assign_clusters(data, centres, [LABEL])
        c2c = class_to_cluster(class_cluster_counts(assigned)).collect()  # K rows
        triples = sorted((int(r[LABEL]), int(r[CLUSTER]), int(r.err)) for r in c2c)
        order = sorted(triples, key=lambda t: (t[2], t[0]))
        side1 = [c for c, cl, _ in order if cl == 1]
        side0 = [c for c, cl, _ in order if cl == 0]
        classes = sorted(c for c, _, _ in triples)
        return centres, triples, tree_layout(side1, side0), classes

    def fit(self, df: DataFrame) -> CodedModel:
        data, inv, in_task = self._prepare(df)
        try:
            centres, triples, nodes, classes = self.plan(data, cached=True, n_rows=sum(inv.counts))
            assert tuple(classes) == inv.classes
            code = TreeCoding(nodes, classes)
            res = fit_coded(data, code, inv.classes, inv.dim, self.params, cache=False, in_task=in_task)
            return CodedModel("tree", classes, code, res.weights, res, nodes=nodes,
                              centres=centres, class_clusters=triples)
        finally:
            data.unpersist()


def trainer_for(scheme: str, params: SGDParams | None = None, **kw) -> _Trainer:
    return {"ova": OneVsAll, "ovo": OneVsOne, "tree": ClusterTree}[scheme](params, **kw)
