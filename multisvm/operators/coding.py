"""Class coding: which rows are positive (+1), negative (-1) or unused (0) in
each binary problem.

All three multiclass schemes are one K x P matrix over {-1, 0, +1}:

* one-vs-all: P = K, +1 on the diagonal, -1 elsewhere;
* one-vs-one: P = K(K-1)/2, column (p, n) has +1 at p, -1 at n;
* cluster tree: P = K-1, one column per node, +1 for classes on the node's
  positive side, -1 on its negative side, 0 for classes not under it.

The trainer asks a :class:`Coding` for the problems of a class, so no K x P
matrix is made: pairs follow from arithmetic, a tree holds its paths. The data
side of "binarize" generates the code's entries on Spark from the table of
classes (``code_entries``) and joins them by label.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from multisvm.sources.tables import FEATURES, ID, LABEL, is_vector, vector_width

# A code table above this many non-zero entries is joined by shuffle, with salted labels.
BROADCAST_MAX_ENTRIES = 2_000_000
# Parts of a class's rows in that join.
SALTS = 32


# The class list (16 bytes a class) and the model are planned on the driver; a
# column with more distinct values than this is taken for an identifier. The
# table of classes itself (``class_inventory``) has no bound.
MAX_CLASSES = 20_000_000
# Classes ranked in one window: labels are ints, so there are at most 2^16 groups.
LABEL_GROUP_BITS = 16


@dataclass(frozen=True)
class Inventory:
    classes: tuple[int, ...]
    counts: tuple[int, ...]
    dim: int

    @property
    def k(self) -> int:
        return len(self.classes)


def class_inventory(df: DataFrame) -> DataFrame:
    """Distinct labels present, their row counts and a dense 0-based index.

    The reference takes 0..max(label); using the labels actually present is the
    same when there are no gaps and never trains an empty problem. The table
    stays on Spark: labels are ranked inside groups of 2^16 neighbouring
    values, and only the groups (2^16 at most, as labels are ints) are counted
    up in one small window.
    """
    per = df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n_rows"))
    per = per.withColumn("_group", F.shiftright(F.col(LABEL).cast("int"), LABEL_GROUP_BITS))
    groups = per.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_group").orderBy(LABEL)) - 1
    return per.withColumn("_nth", nth).join(F.broadcast(groups), "_group").select(
        F.col(LABEL),
        (F.col("_before") + F.col("_nth")).cast("int").alias("class_index"),
        F.col("n_rows"),
    )


def collect_inventory(df: DataFrame) -> Inventory:
    """K rows to the driver (as Arrow): classes, counts and the (fixed) feature width.

    Array features: width from ``size`` in the same aggregate. Vector
    features: width from the column metadata, else from one row.
    """
    vector = is_vector(df)
    aggs = [F.count(F.lit(1)).alias("n")]
    if not vector:
        aggs += [F.min(F.size(FEATURES)).alias("dmin"), F.max(F.size(FEATURES)).alias("dmax")]
    found = df.groupBy(LABEL).agg(*aggs).limit(MAX_CLASSES + 1).toArrow()
    if not found.num_rows:
        raise ValueError("no labelled rows")
    if found.num_rows > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} distinct labels; is {LABEL} an identifier?")
    labels = found.column(LABEL).to_numpy()
    order = np.argsort(labels)
    if vector:
        dim = vector_width(df)
        if dim is None:
            first = df.select(FEATURES).first()[0]
            dim = int(first.size)
    else:
        dmin, dim = int(found.column("dmin").to_numpy().min()), int(found.column("dmax").to_numpy().max())
        if dmin != dim:
            raise ValueError(f"feature vectors differ in length ({dmin}..{dim}); densify to a fixed width first")
    return Inventory(tuple(labels[order].tolist()), tuple(found.column("n").to_numpy()[order].tolist()), int(dim))


def one_vs_all_code(k: int) -> np.ndarray:
    return np.where(np.eye(k, dtype=bool), 1.0, -1.0)


def class_pairs(k: int) -> list[tuple[int, int]]:
    """Index pairs (p, n), p < n, in the order problems are numbered."""
    return [(p, n) for p in range(k) for n in range(p + 1, k)]


def one_vs_one_code(k: int) -> np.ndarray:
    pairs = class_pairs(k)
    m = np.zeros((k, len(pairs)))
    for j, (p, n) in enumerate(pairs):
        m[p, j] = 1.0
        m[n, j] = -1.0
    return m


def halve(classes: list[int]) -> tuple[list[int], list[int]]:
    """Split an ordered class list; the first half takes the extra class."""
    cut = (len(classes) + 1) // 2
    return classes[:cut], classes[cut:]


def tree_layout(side1: list[int], side0: list[int]) -> list[dict]:
    """Lay out the K-1 nodes of the cluster tree before any training.

    ``side1``/``side0`` are the ordered classes of cluster 1 and cluster 0.
    Node 0 separates them; every other node halves its ordered list. The
    positive child of node ``i`` is ``i + 1``, the negative child is
    ``i + len(positive classes)``; a side with one class is a leaf (child -1,
    label set). If a cluster holds no class, the root halves the full list.
    """
    side1, side0 = list(side1), list(side0)
    k = len(side1) + len(side0)
    if k < 2:
        return []
    if not side1 or not side0:
        side1, side0 = halve(side1 + side0)
    nodes: list[dict | None] = [None] * (k - 1)

    def place(idx: int, pos: list[int], neg: list[int]) -> None:
        pos_child = idx + 1 if len(pos) > 1 else -1
        neg_child = idx + len(pos) if len(neg) > 1 else -1
        nodes[idx] = {
            "node": idx,
            "pos_classes": pos,
            "neg_classes": neg,
            "pos_child": pos_child,
            "neg_child": neg_child,
            "pos_label": pos[0] if len(pos) == 1 else -1,
            "neg_label": neg[0] if len(neg) == 1 else -1,
        }
        if pos_child >= 0:
            place(pos_child, *halve(pos))
        if neg_child >= 0:
            place(neg_child, *halve(neg))

    place(0, side1, side0)
    assert all(n is not None for n in nodes), "tree layout left a slot empty"
    return nodes  # type: ignore[return-value]


def tree_code(nodes: list[dict], classes: list[int]) -> np.ndarray:
    index = {c: i for i, c in enumerate(classes)}
    m = np.zeros((len(classes), len(nodes)))
    for j, n in enumerate(nodes):
        for c in n["pos_classes"]:
            m[index[c], j] = 1.0
        for c in n["neg_classes"]:
            m[index[c], j] = -1.0
    return m


class Coding:
    """A K x P code over {-1, 0, +1}, asked for the entries of one class. ``dense``:
    no zeros, every row takes part in every problem."""

    k: int
    p: int
    dense = False

    def entries(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Problems that class index ``c`` takes part in (ascending) and its signs there."""
        raise NotImplementedError

    def signs(self, index: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Signs (float) of rows with these class indices in problems ``keys``; 0 for index -1."""
        raise NotImplementedError

    def matrix(self) -> np.ndarray:
        out = np.zeros((self.k, self.p))
        for c in range(self.k):
            problems, y = self.entries(c)
            out[c, problems] = y
        return out


class OneVsAllCoding(Coding):
    dense = True

    def __init__(self, k: int):
        self.k = self.p = k

    def entries(self, c):
        return np.arange(self.p), np.where(np.arange(self.p) == c, 1, -1).astype(np.int8)

    def signs(self, index, keys):
        y = np.where(index[:, None] == keys[None, :], 1.0, -1.0)
        y[index < 0] = 0.0
        return y


class PairCoding(Coding):
    """One-vs-one without its matrix: pair (p, n), p < n, is problem
    ``first(p) + n - p - 1``, and class c is in K - 1 of them."""

    def __init__(self, k: int):
        self.k, self.p = k, k * (k - 1) // 2

    def first(self, c):
        """Number of the pair (c, c + 1)."""
        return c * self.k - c * (c + 1) // 2

    def entries(self, c):
        below = np.arange(c, dtype=np.int64)
        as_negative = self.first(below) + (c - below - 1)
        as_positive = self.first(c) + np.arange(self.k - 1 - c, dtype=np.int64)
        return np.concatenate([as_negative, as_positive]), np.repeat(np.array([-1, 1], np.int8), [c, self.k - 1 - c])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Class indices (positive, negative) of every problem."""
        return np.triu_indices(self.k, 1)

    def runs(self, lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
        """Problems lo..hi-1 as (positive class, first negative class, from, to)."""
        p = int(np.searchsorted(self.first(np.arange(self.k, dtype=np.int64)), lo, side="right")) - 1
        while lo < hi:
            end = min(hi, self.first(p) + self.k - 1 - p)
            if end > lo:
                yield p, p + 1 + lo - self.first(p), lo, end
            lo, p = max(lo, end), p + 1


class TreeCoding(Coding):
    """The nodes on every class's path (K x depth entries)."""

    def __init__(self, nodes: list[dict], classes: Sequence[int]):
        self.k, self.p = len(classes), len(nodes)
        index = {c: i for i, c in enumerate(classes)}
        paths: list[list[tuple[int, int]]] = [[] for _ in classes]
        for j, n in enumerate(nodes):
            for side, y in (("pos_classes", 1), ("neg_classes", -1)):
                for c in n[side]:
                    paths[index[c]].append((j, y))
        self.paths = [(np.array([j for j, _ in p], dtype=np.int64), np.array([y for _, y in p], dtype=np.int8)) for p in paths]

    def entries(self, c):
        return self.paths[c]


class MatrixCoding(Coding):
    """A code given as a matrix."""

    def __init__(self, code: np.ndarray):
        self.code = np.asarray(code).astype(np.int8)
        self.k, self.p = self.code.shape
        self.dense = bool(np.all(self.code != 0))

    def entries(self, c):
        problems = np.flatnonzero(self.code[c])
        return problems, self.code[c, problems]

    def signs(self, index, keys):
        return np.where((index >= 0)[:, None], self.code[np.maximum(index, 0)][:, keys], 0).astype(float)


def as_coding(code) -> Coding:
    return code if isinstance(code, Coding) else MatrixCoding(code)


def code_table(spark: SparkSession, code, classes: Sequence[int]) -> DataFrame:
    """Non-zero entries of a code as ``label, problem, y``: one row a class on the
    driver, its entries as arrays."""
    code = as_coding(code)
    rows = [(int(c), *(x.tolist() for x in code.entries(i))) for i, c in enumerate(classes)]
    sent = spark.createDataFrame(rows, "label int, problems array<int>, signs array<int>")
    return sent.select("label", F.explode(F.arrays_zip("problems", "signs")).alias("e")).select(
        "label", F.col("e.problems").alias("problem"), F.col("e.signs").alias("y"))


def code_entries(classes: DataFrame, k: int, scheme: str, nodes: Sequence[dict] = ()) -> DataFrame:
    """Non-zero entries ``label, problem, y`` generated on Spark from the table
    of classes (``label, class_index``): no entry is listed on the driver.

    A tree's nodes (K - 1 rows) cover runs of the ordered class list, so each
    is sent as the run it splits."""
    if scheme in ("ova", "ovo"):
        other = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("other")
        both = classes.select(LABEL, F.col("class_index").alias("own"), other)
        if scheme == "ova":
            return both.select(LABEL, F.col("other").alias("problem"), F.when(F.col("own") == F.col("other"), 1).otherwise(-1).alias("y"))
        low, high = F.least("own", "other").cast("long"), F.greatest("own", "other").cast("long")
        problem = (low * k - F.floor(low * (low + 1) / 2) + (high - low - 1)).cast("int")
        return both.where("own <> other").select(LABEL, problem.alias("problem"), F.when(F.col("own") < F.col("other"), 1).otherwise(-1).alias("y"))
    spark = classes.sparkSession
    order = [*nodes[0]["pos_classes"], *nodes[0]["neg_classes"]] if nodes else []
    at = {c: i for i, c in enumerate(order)}
    runs = [(n["node"], at[n["pos_classes"][0]], len(n["pos_classes"]), len(n["neg_classes"])) for n in nodes]
    places = spark.createDataFrame(list(enumerate(order)), "place int, label int")
    runs = spark.createDataFrame(runs, "problem int, start int, n_pos int, n_neg int")
    entries = runs.select("problem", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_pos") + F.col("n_neg") - 1)).alias("place"),
                          (F.col("start") + F.col("n_pos")).alias("split"))
    entries = entries.join(places, "place").join(classes.select(LABEL), LABEL)
    return entries.select(LABEL, "problem", F.when(F.col("place") < F.col("split"), 1).otherwise(-1).alias("y"))


def binarize(df: DataFrame, codes: DataFrame, n_entries: int) -> DataFrame:
    """One row per (example, problem it takes part in) with its +1/-1 target.

    Covers one-vs-rest, pair (filter to two classes, then 1/0) and class-set
    binarization alike: the code table says which rows each problem uses.
    """
    if n_entries <= BROADCAST_MAX_ENTRIES:
        return df.join(F.broadcast(codes), on=LABEL, how="inner")
    # Too large to broadcast: a class may hold a third of the rows, so they are
    # dealt over salts and every code entry goes to each of them.
    salt = F.array(*[F.lit(i) for i in range(SALTS)])
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(ID), F.lit(SALTS)).cast("int"))
    return rows.join(codes.withColumn("_salt", F.explode(salt)), on=[LABEL, "_salt"], how="inner").drop("_salt")
