"""Operators: coding, training, scoring, clustering, metrics."""

from multisvm.operators.coding import (
    Inventory, class_inventory, collect_inventory, one_vs_all_code, one_vs_one_code, class_pairs,
    tree_layout, tree_code, halve, code_table, binarize,
)
from multisvm.operators.trainer import SGDParams, FitResult, fit_coded
from multisvm.operators.scoring import with_margins, MARGINS
from multisvm.operators.clustering import (
    lloyd, kmeans_fit, first_last_centres, assign_clusters, class_cluster_counts, class_to_cluster,
    cluster_class_order, CLUSTER,
)
from multisvm.operators.metrics import confusion, metrics_by_label, accuracy_summary, PREDICTION

__all__ = [
    "Inventory", "class_inventory", "collect_inventory", "one_vs_all_code", "one_vs_one_code",
    "class_pairs", "tree_layout", "tree_code", "halve", "code_table", "binarize",
    "SGDParams", "FitResult", "fit_coded", "with_margins", "MARGINS",
    "lloyd", "kmeans_fit", "first_last_centres", "assign_clusters", "class_cluster_counts",
    "class_to_cluster", "cluster_class_order", "CLUSTER",
    "confusion", "metrics_by_label", "accuracy_summary", "PREDICTION",
]
