import numpy as np
import pytest

from multisvm.operators.coding import class_pairs, halve, one_vs_all_code, one_vs_one_code, tree_code, tree_layout


def test_halve_gives_extra_class_to_first_half():
    assert halve([1, 2, 3]) == ([1, 2], [3])
    assert halve([1, 2, 3, 4]) == ([1, 2], [3, 4])
    assert halve([7, 8]) == ([7], [8])


def test_one_vs_all_and_pairs():
    m = one_vs_all_code(3)
    assert m.tolist() == [[1, -1, -1], [-1, 1, -1], [-1, -1, 1]]
    assert class_pairs(4) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    o = one_vs_one_code(4)
    assert o.shape == (4, 6)
    assert (np.abs(o).sum(axis=0) == 2).all() and (o.sum(axis=0) == 0).all()


@pytest.mark.parametrize("a", range(0, 13))
@pytest.mark.parametrize("b", range(0, 13))
def test_tree_layout_fills_every_slot_and_leaves_every_class_once(a, b):
    side1 = list(range(a))
    side0 = list(range(100, 100 + b))
    nodes = tree_layout(side1, side0)
    k = a + b
    if k < 2:
        assert nodes == []
        return
    assert len(nodes) == k - 1
    assert [n["node"] for n in nodes] == list(range(k - 1))
    leaves = []
    children = []
    for n in nodes:
        for side in ("pos", "neg"):
            if n[f"{side}_child"] == -1:
                assert len(n[f"{side}_classes"]) == 1
                leaves.append(n[f"{side}_label"])
            else:
                children.append(n[f"{side}_child"])
                child = nodes[n[f"{side}_child"]]
                assert sorted(child["pos_classes"] + child["neg_classes"]) == sorted(n[f"{side}_classes"])
    assert sorted(leaves) == sorted(side1 + side0)
    assert sorted(children) == list(range(1, k - 1))  # every non-root node reached once


def test_tree_layout_numbering_matches_reference_rule():
    nodes = tree_layout([3, 1, 4, 5, 9], [2, 6, 0, 7, 8])
    root = nodes[0]
    assert (root["pos_child"], root["neg_child"]) == (1, 5)
    # cluster-1 side: [3,1,4,5,9] -> [3,1,4] | [5,9]
    assert nodes[1]["pos_classes"] == [3, 1, 4] and nodes[1]["neg_classes"] == [5, 9]
    assert (nodes[1]["pos_child"], nodes[1]["neg_child"]) == (2, 4)
    assert nodes[2]["pos_classes"] == [3, 1] and nodes[2]["neg_label"] == 4
    assert (nodes[3]["pos_label"], nodes[3]["neg_label"]) == (3, 1)
    assert (nodes[4]["pos_label"], nodes[4]["neg_label"]) == (5, 9)


def test_one_class_cluster_is_a_leaf_on_the_root():
    nodes = tree_layout([4], [0, 1, 2])
    assert nodes[0]["pos_child"] == -1 and nodes[0]["pos_label"] == 4
    assert nodes[0]["neg_child"] == 1
    nodes = tree_layout([0, 1, 2], [5])
    assert nodes[0]["neg_child"] == -1 and nodes[0]["neg_label"] == 5
    nodes = tree_layout([1], [2])
    assert len(nodes) == 1 and (nodes[0]["pos_label"], nodes[0]["neg_label"]) == (1, 2)


def test_empty_cluster_halves_the_full_list():
    nodes = tree_layout([], [3, 0, 2, 1])
    assert nodes[0]["pos_classes"] == [3, 0] and nodes[0]["neg_classes"] == [2, 1]
    nodes = tree_layout([5, 6, 7], [])
    assert nodes[0]["pos_classes"] == [5, 6] and nodes[0]["neg_classes"] == [7]


def test_tree_code_marks_unused_classes_zero():
    nodes = tree_layout([0, 1], [2, 3])
    m = tree_code(nodes, [0, 1, 2, 3])
    assert m[:, 0].tolist() == [1, 1, -1, -1]
    assert m[:, 1].tolist() == [1, -1, 0, 0]
    assert m[:, 2].tolist() == [0, 0, 1, -1]


def test_binarize_without_broadcast_equals_with(spark):
    from multisvm.operators import coding
    from pyspark.sql import functions as F

    df = spark.range(200).select("id", (F.col("id") % 4).cast("int").alias("label"))
    code = coding.one_vs_one_code(4)
    codes = coding.code_table(spark, code, [0, 1, 2, 3])
    a = sorted(map(tuple, coding.binarize(df, codes, 12).collect()))
    b = coding.binarize(df, codes, coding.BROADCAST_MAX_ENTRIES + 1)
    assert b.columns == ["label", "id", "problem", "y"] and sorted(map(tuple, b.collect())) == a
