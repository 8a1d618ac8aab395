import random
import re
from collections import Counter

import numpy as np
from helpers import SCHEMA, corpus, with_clashes
from multisvm.llm import recompress, substrings
from multisvm.llm.substrings import dedup_substrings


def brute(texts, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_equal_to_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_CHARS", 20_000)  # several batches and ranges
    monkeypatch.setattr(substrings, "BUCKET_CHARS", 10_000)
    data = corpus()
    df = with_clashes(spark.createDataFrame(data, SCHEMA))
    out = dedup_substrings(df)
    assert set(out.columns) == set(df.columns)
    want = sorted((str(d[0]), str(d[1] is None), *w) for d, w in zip(data, brute([d[1] for d in data])))
    got = sorted((str(r.doc_id), str(r.text is None), r.removed.n_words, r.removed.n_removed, r.text or "") for r in out.collect())
    assert got == want
    assert sum(w[3] for w in want) > 500
    for r in out.collect():
        assert sum(s.length for s in r.removed.spans) == r.removed.n_removed
    assert {r.n_words for r in out.select("n_words").collect()} == {"mine"}


def test_short_windows(spark):
    data = corpus(seed=9, n=30)
    got = {(r.doc_id, r.text) for r in dedup_substrings(spark.createDataFrame(data, SCHEMA), window=3).collect()}
    want = {(d[0], None if d[1] is None else w[2]) for d, w in zip(data, brute([d[1] for d in data], 3))}
    assert got == want


def test_empty_table(spark):
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_repeated_window_is_lost():
    """Windows that occur twice never hold a symbol that occurs once, also in
    texts of few words, runs and periods."""
    rng = random.Random(6)
    for round_ in range(60):
        letters = "abcdefgh"[: rng.choice([1, 2, 3, 8])]
        texts = []
        for _ in range(12):
            t = [rng.choice(letters) for _ in range(rng.randint(0, 90))]
            if texts and rng.random() < 0.6:
                other = rng.choice(texts)
                t[rng.randint(0, len(t)):0] = other[rng.randint(0, len(other)):]
            if rng.random() < 0.3:
                t += [rng.choice(letters)] * rng.randint(1, 60)
            texts.append(t)
        raw = [" ".join(t).encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        words = recompress.find_words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        assert [bytes(words.data[a:b]).decode() for a, b in zip(words.start, words.end)] == [w for t in texts for w in t]
        size = rng.choice([5, 20, 35])
        name, low, high = recompress.symbols(words)
        values, back, counts = np.unique(name, return_inverse=True, return_counts=True)
        kept = set(recompress.candidates(words, low, high, counts[back] > 1, size).tolist())
        seen = Counter(tuple(t[i:i + size]) for t in texts for i in range(len(t) - size + 1))
        at = 0
        for t in texts:
            for i in range(len(t) - size + 1):
                if seen[tuple(t[i:i + size])] > 1:
                    assert at + i in kept, (round_, i)
            at += len(t)


def test_rows_of_one_id_are_dealt_over_the_batches(spark, monkeypatch):
    from multisvm.llm import substrings
    from pyspark.sql import functions as F

    monkeypatch.setattr(substrings, "BATCH_CHARS", 400)
    rows = [(None, f"some words of text {i} " * 3, None, None, None) for i in range(400)]
    out = substrings.dedup_substrings(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == 400
    size = sum(len(r[1]) for r in rows)
    batches, _ = substrings.keyblobs.layout(size // substrings.KEY_CHARS, 400 // substrings.KEY_CHARS, substrings.BUCKET_CHARS // substrings.KEY_CHARS)
    assert batches > 20
    per = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(per) > 3 and max(r["count"] for r in per) < 200
