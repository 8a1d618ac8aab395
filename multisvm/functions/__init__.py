"""Column-expression helpers (JVM-side, no Python in the row path)."""

from multisvm.functions.hashing import fraction_threshold, hash_bucket, in_fraction
from multisvm.functions.decode import argmax_label, vote_winner, tree_walk

__all__ = [
    "fraction_threshold", "hash_bucket", "in_fraction",
    "argmax_label", "vote_winner", "tree_walk",
]
