"""Exact top-k by inner product with M-trees.

Inner product becomes a metric by one more coordinate: with M the largest
squared length, x -> (x, sqrt(M - |x|^2)) and a query q -> (q, 0) give
|q' - x'|^2 = |q|^2 + M - 2 q.x, so the nearest objects are the best scores.
Components are integers and scores are exact; distances, used only to pass
over what cannot matter, carry a small allowance.

1. Equal vectors become one object with the few smallest ids that any answer
   can need (limited per task before the shuffle, so a hot vector is no group).
2. Objects go to the nearest of a few pivots (far apart in a bounded sample);
   a pivot's objects, however many, are dealt by hash into shards of bounded
   size, which share its covering radius. Each shard's task builds an M-tree:
   pages of entries with a routing object, the entries' distances to it, and
   covering radii.
3. Queries go in blocks of one pivot. A sample of the objects, scored first,
   gives each a k-th best to start with; a block sends a shard only the queries
   that the pivot's covering radius does not rule out, and skips the shard if
   there are none. A best-first search opens pages in order of the least
   distance they can hold, skips entries by the stored parent distance without
   computing theirs (triangle inequality), and stops at the k-th best.
4. The shards' answers of a query are ranked together.

A query goes to every shard that may answer it, so the queries sent outgrow the
query table they come from: they meet the trees in a merge join, never by a
broadcast (whose size is judged by that table), and travel as the smallest
integers that hold them.

Defined cases: rows whose id or vector is null, or whose vector holds null or
non-finite components, take no part; shorter vectors count as padded with
zeros; equal scores go to the smaller id; repeated rows of one id and vector
count once, and no row of the query's own id is its candidate; a component
times ``scale`` beyond 2^62 is an error, and so is a score beyond a long; other
columns are not read; an empty table or no query gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from multisvm.llm.common import workers, written
from multisvm.llm.vectors import integers, matrix, whole_vectors

PAGE = 256
SHARD = 8192  # objects
BLOCK = 512  # queries
SEEDS = 512  # objects scored first
PIVOTS = 128  # at most


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Objects as points of the metric space."""
    x = vectors.astype(float)
    return np.concatenate([x, np.sqrt(np.maximum(0.0, longest - (x**2).sum(axis=1)))[:, None]], axis=1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of two sets of points."""
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(0.0, square))


def far_points(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` points, each the farthest from those before."""
    chosen, to = [0], apart(points, points[:1])[:, 0]
    while len(chosen) < count and to.max() > 0:
        chosen.append(int(to.argmax()))
        to = np.minimum(to, apart(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def within(queries: np.ndarray, start: np.ndarray, pivots: np.ndarray, radius: np.ndarray, longest: float) -> np.ndarray:
    """Queries x pivots: can the objects of a pivot, within its covering radius,
    hold a score of at least the query's ``start``?"""
    x = queries.astype(float)
    own = (x**2).sum(axis=1) + longest  # squared distance of score 0
    to = apart(np.concatenate([x, np.zeros((len(x), 1))], axis=1), pivots)
    reach = np.sqrt(np.maximum(0.0, own - 2 * np.where(np.isfinite(start), start, 0.0)))
    reach[~np.isfinite(start)] = np.inf
    return to - radius[None, :] <= (reach + 1e-6 * (1 + np.sqrt(own)))[:, None]


@dataclass
class Page:
    """Entries of one page: objects of a leaf, or child pages."""

    entries: np.ndarray  # object numbers (in an inner page: the children's routing objects)
    children: list | None
    apart: np.ndarray  # distance of each entry to the page's routing object
    radius: np.ndarray  # covering radius of each entry (0 in leaves)


class MTree:
    """Bulk-loaded M-tree over integer vectors."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], longest: float, page: int = PAGE):
        self.vectors, self.ids, self.longest, self.page = vectors, ids, longest, page
        self.points = lifted(vectors, longest)
        level = [self._leaf(part) for part in self._split(np.arange(len(vectors)), self.points)]
        while len(level) > 1:
            objects = np.array([o for o, _, _ in level])
            level = [self._inner([level[i] for i in part]) for part in self._split(np.arange(len(level)), self.points[objects])]
        self.root_object, self.root_radius, self.root = level[0]
        del self.points

    def _split(self, members: np.ndarray, points: np.ndarray) -> list[np.ndarray]:
        """Halves by the distance to two far points until a page holds a part."""
        parts, done = [members], []
        while parts:
            part = parts.pop()
            if len(part) <= self.page:
                done.append(part)
                continue
            x = points[part]
            a = x[((x - x[0]) ** 2).sum(axis=1).argmax()]
            b = x[((x - a) ** 2).sum(axis=1).argmax()]
            side = np.argsort(x @ (b - a), kind="stable")
            parts += [part[side[: len(part) // 2]], part[side[len(part) // 2:]]]
        return done

    def _centre(self, objects: np.ndarray) -> int:
        x = self.points[objects]
        return int(objects[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin()])

    def _apart(self, objects: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.points[objects] - self.points[centre]) ** 2).sum(axis=1))

    def _leaf(self, part: np.ndarray):
        centre = self._centre(part)
        apart = self._apart(part, centre)
        return centre, float(apart.max()), Page(part, None, apart, np.zeros(len(part)))

    def _inner(self, parts: list):
        objects, radius = np.array([o for o, _, _ in parts]), np.array([r for _, r, _ in parts])
        centre = self._centre(objects)
        apart = self._apart(objects, centre)
        return centre, float((apart + radius).max()), Page(objects, [p for _, _, p in parts], apart, radius)

    def search(self, query: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
        """The k best (score, id), ids other than ``own``; only scores of at
        least ``least`` need be found."""
        square = float(query @ query) + self.longest
        slack = 1e-7 * (1 + np.sqrt(square))
        best: list[tuple[int, int]] = []
        kth = least
        reach = np.sqrt(max(0.0, square - 2 * kth)) if kth > -np.inf else np.inf
        to = float(np.sqrt(max(0.0, square - 2 * float(self.vectors[self.root_object] @ query))))
        heap, n = [(max(0.0, to - self.root_radius), 0, to, self.root)], 0
        while heap:
            bound, _, to, page = heapq.heappop(heap)
            if bound > reach + slack:
                break
            near = np.abs(to - page.apart) - page.radius <= reach + slack  # without their distances
            entries = page.entries[near] if not near.all() else page.entries
            score = self.vectors[entries] @ query
            if page.children is None:  # exact, whatever the type
                for i in np.flatnonzero(score >= kth):
                    best += [(-int(score[i]), x) for x in self.ids[entries[i]] if x != own]
                if len(best) > k:
                    best = sorted(best)[:k]
                if len(best) == k and -max(best)[0] > kth:
                    kth = -max(best)[0]
                    reach = np.sqrt(max(0.0, square - 2 * kth))
                continue
            away = np.sqrt(np.maximum(0.0, square - 2 * score.astype(float)))
            low = np.maximum(0.0, away - page.radius[near])
            for i, child in enumerate(np.flatnonzero(near)):
                if low[i] <= reach + slack:
                    n += 1
                    heapq.heappush(heap, (float(low[i]), n, float(away[i]), page.children[child]))
        return [(-s, x) for s, x in sorted(best)]


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best rows of ``df``
    by the inner product of floor(scale * component); both tables have the id
    and vector columns."""
    spark = df.sparkSession
    workers(spark)

    def whole(rows: DataFrame) -> DataFrame:
        rows = whole_vectors(rows, vector_col).where(F.col(f"`{id_col}`").isNotNull())
        return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), integers(F.col(f"`{vector_col}`"), scale).alias("v")).distinct()

    first = Window.partitionBy("v").orderBy("id")
    few = whole(df).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)  # limited per task first
    objects = written(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "objects")
    asked = written(whole(queries), "queries")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    far = F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))
    n, longest, wide, largest = objects.agg(F.count("*"), F.max(square), F.max(F.size("v")), far).first()
    n_asked, widest, farthest = asked.agg(F.count("*"), F.max(F.size("v")), far).first()
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, longest = max(1, wide, widest), float(longest)
    bound = width * max(largest or 0, farthest or 0) ** 2
    kind = np.float64 if bound < 1 << 52 else np.int64 if bound < 1 << 62 else object  # sums of products are exact

    size = max(largest or 0, farthest or 0)
    small = np.int16 if size < 1 << 15 else np.int32 if size < 1 << 31 else np.int64  # for the way between tasks

    def load(table: pa.Table) -> np.ndarray:
        return matrix(table.column("v"), width).astype(kind)

    sample = objects.orderBy(F.xxhash64("v"), "v").limit(SEEDS).toArrow()  # bounded
    seeds, seed_ids = load(sample), np.array([x[0] for x in sample.column("ids").to_pylist()], np.int64)
    pivots = far_points(lifted(seeds, longest), min(PIVOTS, -(-n // SHARD)))

    def nearest(batches):
        for b in batches:
            to = apart(lifted(load(pa.Table.from_batches([b])), longest), pivots)
            at = to.argmin(axis=1)
            own = [pa.array(at, pa.int32()), pa.array(to[np.arange(len(at)), at] if len(at) else np.zeros(0))]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*b.schema.names, "pivot", "apart"])

    def dealt(rows: DataFrame, kept: str, size: int, by: str) -> tuple[DataFrame, dict]:
        """Rows with their pivot's number and a part of it of bounded size (a
        pivot with many rows has many); (rows, radius) of each pivot."""
        near = written(rows.select(*kept.split()).mapInArrow(nearest, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept.split())
                                                             + ", pivot int, apart double"), "pivots")
        found = {r[0]: (r[1], r[2]) for r in near.groupBy("pivot").agg(F.count("*"), F.max("apart")).collect()}  # a row a pivot
        parts = F.get(F.array(*[F.lit(max(1, -(-found.get(p, (0, 0))[0] // size))) for p in range(len(pivots))]), F.col("pivot"))
        return near.withColumn("part", F.shiftleft(F.col("pivot").cast("long"), 32) + F.pmod(F.xxhash64(by), parts)), found

    rows, held = dealt(objects, "v ids", SHARD, "v")
    groups, _ = dealt(asked, "v id", BLOCK, "id")
    radius = np.array([held.get(p, (0, 0.0))[1] * (1 + 1e-9) + 1e-6 for p in range(len(pivots))])
    shards = [[(p << 32) + i for i in range(-(-held.get(p, (0, 0))[0] // SHARD))] for p in range(len(pivots))]

    def build(table: pa.Table) -> pa.Table:
        tree = MTree(load(table), table.column("ids").to_pylist(), longest)
        tree.vectors = tree.vectors.astype(small)
        return pa.table({"part": table.column("part").slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    def bundle(table: pa.Table) -> pa.Table:
        vectors = load(table)
        ids = table.column("id").to_numpy()
        start = np.full(len(ids), -np.inf)
        if len(seed_ids) > k:
            score = (vectors @ seeds.T).astype(float)
            score[ids[:, None] == seed_ids[None, :]] = -np.inf  # not the query itself
            start = np.partition(score, -k, axis=1)[:, -k]
            if kind is not np.float64:
                start = start * (1 - np.sign(start) * 1e-12)  # rounded: a little less
        asks = within(vectors, start, pivots, radius, longest)
        sent = [(shard, pickle.dumps((ids[asks[:, p]], vectors[asks[:, p]].astype(small), start[asks[:, p]])))
                for p in range(len(pivots)) if asks[:, p].any() for shard in shards[p]]
        return pa.table({"part": pa.array([x for x, _ in sent], pa.int64()), "queries": pa.array([q for _, q in sent], pa.binary())})

    trees = rows.groupBy("part").applyInArrow(build, "part long, tree binary")
    sent = groups.groupBy("part").applyInArrow(bundle, "part long, queries binary")
    pairs = sent.hint("merge").join(trees.hint("merge"), "part")

    def search(batches):
        for b in batches:
            for i in range(b.num_rows):
                tree: MTree = pickle.loads(b.column(1)[i].as_py())
                ids, vectors, start = pickle.loads(b.column(0)[i].as_py())  # written by this job's own tasks
                tree.vectors = tree.vectors.astype(kind)
                found = [(q, x, s) for q, v, t in zip(ids.tolist(), vectors.astype(kind), start) for s, x in tree.search(v, q, k, t)]
                cols = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    answers = pairs.select("queries", "tree").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
