"""Connected components of a link table, by alternating large and small stars.

Every round is one aggregate and one join on the node; a node's neighbours are
never gathered in one row, and nodes with many links are joined by broadcast
(``join_counted``), so no task holds them all. Rounds end when no link changes;
each is cut with checkpoint() into the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from multisvm.session import checkpoint_dir

# A key with more than this share of the rows is hot: there are fewer than so many.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the facts of their key. ``facts`` has a row a key and a column
    n, the rows of that key; these sum up to ``total``, so at most ``HOT_SHARE``
    keys have a ``HOT_SHARE``-th of the rows each. Those are broadcast, and their
    rows stay where they are."""
    is_hot = F.col("n") * HOT_SHARE >= total
    hot, other = facts.where(is_hot).drop("n"), facts.where(~is_hot).drop("n")
    few = rows.join(F.broadcast(hot), key)
    return few.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(other, key))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n"))
    least = least.select("u", F.least("u", "m").alias("m"), "n")
    return join_counted(both.where("v > u"), least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """A node's smaller neighbours and the node are linked to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_counted(links, least, "u", total).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in a link (u, v) of two longs; the root is the
    component's least node. Links to oneself and repeated links are allowed."""
    checkpoint_dir(links.sparkSession)
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct().checkpoint()
    total, sign = links.count(), None
    while True:
        # a large star has a row a link
        links = _small_star(_large_star(links, total), total).distinct().checkpoint()
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == sign:
            break
        total, sign = now[0], tuple(now)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
