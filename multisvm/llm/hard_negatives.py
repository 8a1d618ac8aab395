"""Hard negatives by vertical scans (branch and bound on decomposed data).

Vectors become integers and scores are exact inner products. An anchor's
positives are its best other rows of its label; for every positive the hard
negatives are the best rows of other labels whose score lies in a window under
the positive's.

1. Rows are dealt by hash into shards and anchors into blocks, both of bounded
   size; every block meets every shard in a group of its own. A shard is held
   by columns, with the least and the largest value of each dimension.
2. An anchor reads the dimensions in falling order of its own components'
   magnitude. After each few of them the partial scores and the least and most
   that the remaining dimensions can add bound every candidate's score, and the
   candidate bitmap shrinks to those that can still be an answer:
   - for positives: to the k best of the shard, or above the k-th best of a
     bounded sample of all rows;
   - for negatives: into one of the anchor's windows, and there to its k best;
   what is left after the last dimension has its exact score.
3. The shards' answers are ranked together: first the positives, which set the
   windows of the second scan, then the negatives of every window.

The work is the anchors against all rows, as asked; no row is skipped but by
bounds, and nothing is sent twice but the shards (once a block of anchors).

Defined cases: rows whose id, label or vector is null, or whose vector holds
null or non-finite components, take no part; shorter vectors count as padded
with zeros; repeated rows of one id, label and vector count once, and no row of
the anchor's own id is its positive or negative; equal scores go to the smaller
id; an anchor without positives, or a positive with nothing in its window,
gives no row; a component times ``scale`` beyond 2^62 is an error, and so is a
score beyond a long; other columns are not read; an empty table or no anchor
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from multisvm.llm.common import workers, written
from multisvm.llm.vectors import integers, matrix, whole_vectors

LEAST_ROWS, MOST_ROWS = 1024, 65_536  # of a shard
BLOCK = 8192  # anchors
SEEDS = 1024  # sampled rows that give bounds to start with
STEP = 8  # dimensions between two bounds
OUTPUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Shard:
    """Rows by columns: D x n values and the ends of each dimension."""

    def __init__(self, vectors: np.ndarray):
        self.columns = np.ascontiguousarray(vectors.T)
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, undecided: Callable) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) that are left when all dimensions are read:
        ``undecided`` takes least and largest possible scores of the candidates
        and tells which stay."""
        order = np.argsort(-abs(anchor), kind="stable")
        a = anchor[order]
        ends = a * self.low[order], a * self.high[order]
        least, most = np.minimum(*ends), np.maximum(*ends)
        least, most = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (least, most))  # of the dimensions from k on
        rows = np.flatnonzero(bitmap)
        score = np.zeros(len(rows), dtype=self.columns.dtype)
        for k in range(0, len(order), STEP):
            if len(rows) == 0:
                break
            read = order[k:k + STEP]
            part = self.columns[read] if len(rows) == len(bitmap) else self.columns[np.ix_(read, rows)]
            score = score + a[k:k + STEP] @ part
            to = min(k + STEP, len(order))
            stay = undecided(score + least[to], score + most[to])
            rows, score = rows[stay], score[stay]
        return rows, score


def _kth(values: np.ndarray, k: int):
    return np.sort(values)[-k] if values.dtype == object else np.partition(values, -k)[-k]


def best_of(k: int, floor) -> Callable:
    """Candidates for the k best scores, all of which are ``floor`` at least."""

    def undecided(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        nonlocal floor
        if len(lower) >= k:
            kth = _kth(lower, k)
            floor = kth if floor is None else max(floor, kth)
        return np.ones(len(lower), bool) if floor is None else upper >= floor

    return undecided


def inside_of(windows: list[list[int]], k: int) -> Callable:
    """Candidates for the k best scores of some window (low, high); ``low``
    rises with the k-th best score that is sure to lie inside."""

    def undecided(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(lower), bool)
        for w in windows:
            sure = lower[(lower >= w[0]) & (upper <= w[1])]
            if len(sure) >= k:
                w[0] = max(w[0], _kth(sure, k))
            stay |= (upper >= w[0]) & (lower <= w[1])
        return stay

    return undecided


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    order = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), dtype=np.int64)
    return order[:k]


def hard_negatives(df: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each anchor and each of its first ``positives`` rows of
    the same label, the first ``negatives`` rows of other labels with low *
    positive_score <= 100 * negative_score <= high * positive_score."""
    spark = df.sparkSession
    workers(spark)

    def whole(rows: DataFrame) -> DataFrame:
        rows = whole_vectors(rows, vector_col).where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull())
        return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                           integers(F.col(f"`{vector_col}`"), scale).alias("v")).distinct()

    objects = written(whole(df), "objects")
    asked = written(whole(anchors).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    far = F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))
    n, width, largest = objects.agg(F.count(F.lit(1)), F.max(F.size("v")), far).first()
    n_asked, widest, farthest = asked.agg(F.count(F.lit(1)), F.max(F.size("v")), far).first()
    if not n or not n_asked:
        return spark.createDataFrame([], OUTPUT)
    width, largest = max(1, width, widest), max(largest or 0, farthest or 0)
    bound = width * largest * largest
    kind = np.float64 if bound < 1 << 52 else np.int64 if bound < 1 << 62 else object  # sums of products are exact
    shards = max(-(-n // MOST_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    blocks = -(-n_asked // BLOCK)
    sample = objects.orderBy(F.xxhash64("id", "v"), "id", "label", "v").limit(SEEDS).toArrow()  # bounded

    def load(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return table.column("id").to_numpy(), table.column("label").to_numpy(), matrix(table.column("v"), width).astype(kind)

    seed_ids, seed_labels, seeds = load(sample)

    def meet(extra: DataFrame, search: Callable, schema: str) -> DataFrame:
        """Every block of anchors with every shard."""
        shard = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("shard")
        block = F.pmod(F.xxhash64("anchor"), F.lit(blocks)).alias("block")
        each = [F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x - 1).cast("long"))).alias(c) for x, c in ((blocks, "block"), (shards, "shard"))]
        rows = objects.select("*", shard, each[0]).groupBy("shard", "block")
        ask = extra.select("*", block, each[1]).groupBy("shard", "block")

        def group(left: pa.Table, right: pa.Table) -> pa.Table:
            found: list[tuple] = []
            if left.num_rows and right.num_rows:
                ids, labels, vectors = load(left)
                own, own_labels, queries = load(right)
                near = queries @ seeds.T
                held, more = Shard(vectors), right.drop_columns(["v"]).to_pylist()
                for i, query in enumerate(queries):
                    other, seed_other = ids != own[i], seed_ids != own[i]
                    found += search(more[i], held, query, ids, labels == own_labels[i], other,
                                    near[i], seed_labels == own_labels[i], seed_other)
            columns = list(zip(*found)) or [()] * len(schema.split(","))
            return pa.table([pa.array([int(x) for x in c], pa.int64()) for c in columns], names=[c.split()[0] for c in schema.split(", ")])

        return rows.cogroup(ask).applyInArrow(group, schema)

    def search_positives(more, held, query, ids, same, other, near, seed_same, seed_other) -> list[tuple]:
        known = near[seed_same & seed_other]
        floor = _kth(known, positives) if len(known) >= positives else None
        rows, score = held.scan(query, same & other, best_of(positives, floor))
        first = _first(ids[rows], score, positives)
        return [(more["anchor"], ids[rows[j]], score[j]) for j in first]

    found = meet(asked, search_positives, "anchor long, positive_id long, positive_score long")
    by_score = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= positives).drop("nth")
    chosen = written(found, "positives")

    # an anchor's windows: one for every score of its positives
    share = F.col("positive_score").cast("decimal(38,0)")
    # a floor and a ceiling of whole numbers
    edge = (F.ceil(share * low / 100).cast("long").alias("low"), F.floor(share * high / 100).cast("long").alias("high"))
    windows = chosen.select("anchor", "positive_score").distinct().select("anchor", "positive_score", *edge).where("low <= high")
    windows = windows.groupBy("anchor").agg(F.collect_list(F.struct("positive_score", "low", "high")).alias("windows"))

    def search_negatives(more, held, query, ids, same, other, near, seed_same, seed_other) -> list[tuple]:
        spans = [[w["low"], w["high"]] for w in more["windows"]]
        known = near[~seed_same & seed_other]
        for w in spans:
            inside = known[(known >= w[0]) & (known <= w[1])]
            if len(inside) >= negatives:
                w[0] = max(w[0], _kth(inside, negatives))
        rows, score = held.scan(query, ~same & other, inside_of(spans, negatives))
        out = []
        for w, span in zip(more["windows"], spans):
            fit = np.flatnonzero((score >= span[0]) & (score <= span[1]))
            first = fit[_first(ids[rows[fit]], score[fit], negatives)]
            out += [(more["anchor"], w["positive_score"], ids[rows[j]], score[j]) for j in first]
        return out

    asking = asked.join(windows, "anchor")
    negative = meet(asking, search_negatives, "anchor long, positive_score long, negative_id long, negative_score long")
    by_score = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    negative = negative.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= negatives)
    named = chosen.join(asked.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return named.join(negative, ["anchor", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
