"""Property tests against brute force."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from multisvm.operators.coding import class_pairs
from multisvm.operators.metrics import confusion, metrics_by_label
from multisvm.operators.scoring import pair_votes


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 9), st.integers(1, 30), st.integers(0, 10_000))
def test_pair_votes_match_a_loop(k, n, seed):
    rng = np.random.default_rng(seed)
    pairs = class_pairs(k)
    m = rng.normal(size=(n, len(pairs)))
    m[rng.random(m.shape) < 0.1] = 0.0
    pos = np.array([p for p, _ in pairs])
    neg = np.array([q for _, q in pairs])
    got = pair_votes(m, pos, neg, k)
    for r in range(n):
        c = Counter(pos[j] if m[r, j] >= 0 else neg[j] for j in range(len(pairs)))
        assert [c.get(i, 0) for i in range(k)] == list(got[r])
    assert (got.sum(axis=1) == len(pairs)).all()


def _brute(pairs):
    labels = sorted({t for t, _ in pairs})
    n = len(pairs)
    out = {}
    for lab in labels:
        tp = sum(1 for t, p in pairs if t == lab and p == lab)
        fp = sum(1 for t, p in pairs if t != lab and p == lab)
        n_lab = sum(1 for t, _ in pairs if t == lab)
        prec = 0.0 if tp + fp == 0 else tp / (tp + fp)
        rec = tp / n_lab
        fpr = None if n - n_lab == 0 else fp / (n - n_lab)
        f1 = 0.0 if prec + rec == 0 else 2.0 * prec * rec / (prec + rec)
        out[lab] = (n_lab, tp, fp, prec, rec, fpr, f1)
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 5)), min_size=1, max_size=40))
def test_metrics_match_brute_force(spark, pairs):
    df = spark.createDataFrame(pairs, "label int, prediction int")
    got = {r.label: (r.n_label, r.tp, r.fp, r.precision, r.recall, r.false_positive_rate, r.f1)
           for r in metrics_by_label(confusion(df)).collect()}
    assert got == _brute(pairs)
