"""multisvm: multiclass linear SVMs (one-vs-all, one-vs-one, cluster tree)
trained and scored as Spark jobs."""

from multisvm.operators.trainer import SGDParams
from multisvm.plans.classifiers import ClusterTree, CodedModel, OneVsAll, OneVsOne

__all__ = ["SGDParams", "OneVsAll", "OneVsOne", "ClusterTree", "CodedModel"]
