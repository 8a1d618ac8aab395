"""Scoring: margins, votes and predictions of every row, in tiles.

The model (P x D weights) is cut into blocks of problems (:class:`ProblemBlocks`).
A model of up to a megabyte rides in the task closure; the blocks of a larger
one are broadcast, one copy an executor, and read once by each of its workers.
Each Arrow batch is worked off in tiles of rows and problems, so that nothing
of rows x problems is held: one-vs-all keeps a running best problem,
one-vs-one running votes, and the tree multiplies each row only by the nodes on
its path. Margins, if asked for, leave in batches of a tile's size; the
decoders in :mod:`multisvm.functions.decode` run JVM-side on them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from multisvm.operators.blocks import SparseRows, feature_block
from multisvm.operators.coding import PairCoding
from multisvm.operators.partials import list_column
from multisvm.operators.trainer import STEP_VALUES, fetch, shared
from multisvm.session import ship_package
from multisvm.sources.tables import FEATURES

MARGINS = "margins"
VOTES = "votes"
PREDICTION = "prediction"

# Weights of one block of problems.
MODEL_BLOCK_BYTES = 16 * 1024 * 1024
# Problems of a tile; its rows follow from STEP_VALUES.
TILE_PROBLEMS = 2048


class ProblemBlocks:
    """P x D weights in blocks of consecutive problems, in the closure or as
    broadcasts. Lives as long as the model; dropped broadcasts are cleaned up
    by Spark."""

    def __init__(self, spark: SparkSession, weights: np.ndarray, block_bytes: int | None = None):
        weights = np.asarray(weights, dtype=np.float64)
        self.p, self.dim = weights.shape
        self.size = max(1, (MODEL_BLOCK_BYTES if block_bytes is None else block_bytes) // (8 * max(1, self.dim)))
        self.parts = [shared(spark, np.ascontiguousarray(weights[lo:lo + self.size]), weights.nbytes) for lo in range(0, self.p, self.size)]

    def tiles(self, problems: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first problem, weights) of runs of at most ``problems``."""
        for i, part in enumerate(self.parts):
            w = fetch(part)
            for lo in range(0, len(w), problems):
                yield i * self.size + lo, w[lo:lo + problems]

    def _by_block(self, problems: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray, np.ndarray]]:
        """(where, weights, problems inside them) of each block that is asked for."""
        block = problems // self.size
        for i in np.unique(block):
            where = slice(None) if len(self.parts) == 1 else np.flatnonzero(block == i)
            yield where, fetch(self.parts[i]), problems[where] - i * self.size

    def at(self, x, problems: np.ndarray) -> np.ndarray:
        """Margin of each row of ``x`` in its own problem: one product a row."""
        out = np.zeros(len(problems))
        if isinstance(x, SparseRows):
            rows = x.row_ids()
            for where, w, own in self._by_block(problems[rows]):
                np.add.at(out, rows[where], x.values[where] * w[own, x.indices[where]])
            return out
        step = max(1, STEP_VALUES // max(1, self.dim))
        for lo in range(0, len(problems), step):
            for where, w, own in self._by_block(problems[lo:lo + step]):
                out[lo:lo + step][where] = np.einsum("ij,ij->i", x[lo:lo + step][where], w[own])
        return out


def margin_tile(x, blocks: ProblemBlocks) -> np.ndarray:
    """n x P margins, for a few rows."""
    out = np.zeros((x.shape[0], blocks.p))
    for lo, w in blocks.tiles(TILE_PROBLEMS):
        out[:, lo:lo + len(w)] = x @ w.T
    return out


def best_problem(x, blocks: ProblemBlocks, tile: int = TILE_PROBLEMS) -> np.ndarray:
    """Problem of the largest margin (ties: the first), kept while tiles pass."""
    n = x.shape[0]
    best, at = np.full(n, -np.inf), np.zeros(n, np.int64)
    for lo, w in blocks.tiles(tile):
        m = x @ w.T
        j = m.argmax(axis=1)
        value = m[np.arange(n), j]
        better = value > best
        best[better], at[better] = value[better], lo + j[better]
    return at


def count_votes(x, blocks: ProblemBlocks, k: int, tile: int = TILE_PROBLEMS) -> np.ndarray:
    """n x k votes of all pairs, added up while tiles pass: margin >= 0 is a vote
    for the pair's lower class. Pairs are numbered by their lower class, so a
    tile is a few runs of one class against consecutive others."""
    votes, pairs = np.zeros((x.shape[0], k), np.int32), PairCoding(k)
    for lo, w in blocks.tiles(tile):
        won = x @ w.T >= 0.0
        for p, n, a, b in pairs.runs(lo, lo + len(w)):
            own = won[:, a - lo:b - lo]
            votes[:, p] += own.sum(axis=1, dtype=np.int32)
            votes[:, n:n + b - a] += ~own
    return votes


def pair_votes(margins: np.ndarray, pos: np.ndarray, neg: np.ndarray, k: int) -> np.ndarray:
    """n x k votes from margins in hand, for pairs in any order: pair j goes to
    class index ``pos[j]`` when its margin is >= 0, else to ``neg[j]``."""
    n = margins.shape[0]
    winner = np.where(margins >= 0.0, pos[None, :], neg[None, :])
    flat = (np.arange(n)[:, None] * k + winner).ravel()
    return np.bincount(flat, minlength=n * k).reshape(n, k).astype(np.int32)


def walk_tree(x, blocks: ProblemBlocks, child: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels: all rows go down the tree together, a level a step, each
    multiplied by the node it is at (margin >= 0: the positive side). ``child``
    and ``label`` hold (negative, positive) of every node, child -1 at a leaf."""
    n = x.shape[0]
    at, out, rows = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    while len(rows):
        here = at[rows]
        side = (blocks.at(x[rows] if len(rows) < n else x, here) >= 0.0).astype(np.int64)
        down = child[here, side]
        done = down < 0
        out[rows[done]] = label[here, side][done]
        rows = rows[~done]
        at[rows] = down[~done]
    return out


def tree_links(nodes: Sequence[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(child, label) arrays of :func:`walk_tree`."""
    child = np.array([[n["neg_child"], n["pos_child"]] for n in nodes], dtype=np.int64)
    return child, np.array([[n["neg_label"], n["pos_label"]] for n in nodes], dtype=np.int64)


def score_kernel(blocks: ProblemBlocks, keep: Sequence[str], scheme: str, plan, k: int, arrow_schema: pa.Schema, features: str = FEATURES,
                 margins: str | None = None, votes: bool = False, labels: bool = False):
    """Arrow-batch function behind :func:`score`. ``plan`` gives the class list
    and the tree's links (an object or a broadcast)."""
    widest = max(1, blocks.p if margins else min(blocks.p, TILE_PROBLEMS), k if scheme == "ovo" else 1)
    tile_rows = max(1, STEP_VALUES // widest)
    tile = max(1, min(TILE_PROBLEMS, blocks.p))

    def predict(x, counted, names, child, label) -> np.ndarray:
        if k == 1:
            return np.full(x.shape[0], names[0])
        if scheme == "ova":
            return names[best_problem(x, blocks, tile)]
        if scheme == "ovo":
            return names[counted.argmax(axis=1)]
        return walk_tree(x, blocks, child, label)

    def rows(block, lo: int, hi: int):
        return block[np.arange(lo, hi)] if isinstance(block, SparseRows) else block[lo:hi]

    def kernel(batches):
        links = fetch(plan)
        for batch in batches:
            block = feature_block(batch.column(features), blocks.dim)
            for lo in range(0, max(batch.num_rows, 1), tile_rows):
                part = batch.slice(lo, tile_rows)
                x = block if part.num_rows == batch.num_rows else rows(block, lo, lo + part.num_rows)
                cols = [part.column(c) for c in keep]
                if margins:
                    cols.append(list_column(margin_tile(x, blocks)).cast(arrow_schema.field(margins).type))
                counted = count_votes(x, blocks, k, tile) if scheme == "ovo" and (votes or labels) else None
                if votes:
                    cols.append(list_column(counted).cast(arrow_schema.field(VOTES).type))
                if labels:
                    cols.append(pa.array(predict(x, counted, *links).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(cols, schema=arrow_schema)

    return kernel


def score(df: DataFrame, blocks: ProblemBlocks, keep: Sequence[str], scheme: str, classes: Sequence[int], nodes: Sequence[dict] = (),
          features: str = FEATURES, margins: bool = False, votes: bool = False, labels: bool = False, out: str = MARGINS) -> DataFrame:
    """``keep`` columns plus, as asked for: ``out`` = array of w_p . x for every
    problem p, ``votes`` (one-vs-one: the vote count of each class) and
    ``prediction``, decoded in the task. Margins are the only output with an
    entry a problem; without them memory does not grow with rows x problems."""
    spark = df.sparkSession
    ship_package(spark)
    keep, k = list(keep), len(classes)
    fields = [df.schema[c] for c in keep]
    if margins:
        fields.append(StructField(out, ArrayType(DoubleType(), True), True))
    if votes:
        fields.append(StructField(VOTES, ArrayType(IntegerType(), True), True))
    if labels:
        fields.append(StructField(PREDICTION, IntegerType(), True))
    schema = StructType(fields)
    plan = (np.asarray(classes, dtype=np.int64), *(tree_links(nodes) if nodes else (None, None)))
    plan = shared(spark, plan, 8 * k + 32 * len(nodes))
    kernel = score_kernel(blocks, keep, scheme, plan, k, to_arrow_schema(schema), features, out if margins else None, votes, labels)
    return df.select(*keep, features).mapInArrow(kernel, schema)


def with_margins(df: DataFrame, weights: np.ndarray, keep: Sequence[str], features: str = FEATURES, out: str = MARGINS) -> DataFrame:
    """``keep`` columns plus ``out`` = array of w_p . x for every problem p."""
    blocks = ProblemBlocks(df.sparkSession, weights)
    return score(df, blocks, keep, "margins", [], features=features, margins=True, out=out)
