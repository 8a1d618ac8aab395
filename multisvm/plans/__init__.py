"""Plans: the three classifiers and the registered queries."""

from multisvm.plans.classifiers import (
    OneVsAll, OneVsOne, ClusterTree, CodedModel, trainer_for, OVA_DEFAULTS, OVO_DEFAULTS, TREE_DEFAULTS,
)

__all__ = ["OneVsAll", "OneVsOne", "ClusterTree", "CodedModel", "trainer_for",
           "OVA_DEFAULTS", "OVO_DEFAULTS", "TREE_DEFAULTS"]
