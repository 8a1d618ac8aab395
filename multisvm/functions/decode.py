"""Decoders: turn a row's array of margins into a class, JVM-side.

Model-derived constants (class lists, pair labels, tree links) enter as
literal arrays of at most K(K-1)/2 entries; the margins themselves come from
the vectorized scoring pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int_array(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def argmax_label(margins: Column, classes: Sequence[int]) -> Column:
    """Class of the largest margin; ties go to the first, i.e. lowest, class."""
    pos = F.array_position(margins, F.array_max(margins)).cast("int")
    return F.element_at(_int_array(classes), pos)


def vote_winner(votes: Column, classes: Sequence[int]) -> Column:
    """Class with most votes; ties go to the lowest label."""
    pos = F.array_position(votes, F.array_max(votes)).cast("int")
    return F.element_at(_int_array(classes), pos)


def tree_walk(margins: Column, nodes: Sequence[dict]) -> Column:
    """Walk the tree from node 0: margin >= 0 goes to the positive side.

    ``nodes[i]`` has ``pos_child``/``neg_child`` (-1 when that side is a leaf)
    and ``pos_label``/``neg_label``. Built as nested CASE, one branch per node.
    """
    if not nodes:
        raise ValueError("empty tree")

    def side(child: int, label: int) -> Column:
        return at(child) if child >= 0 else F.lit(int(label))

    def at(i: int) -> Column:
        n = nodes[i]
        return F.when(margins[i] >= 0.0, side(n["pos_child"], n["pos_label"])).otherwise(
            side(n["neg_child"], n["neg_label"])
        )

    return at(0)
