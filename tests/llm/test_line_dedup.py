import random

import pytest

from helpers import SCHEMA, corpus, prose, with_clashes
from multisvm.llm import line_dedup
from multisvm.llm.line_dedup import dedup_lines, keep_bitmaps

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, least_documents=3):
    """(id, n_lines, n_dropped, kept) of every row."""
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))

    holders = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        gone = [len(h := holders.get(key(x), ())) >= least_documents and max(h, key=lambda i: (i is not None, i or 0)) != r[0] for x in lines]
        out.append((r[0], len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


def lined(seed=2, n=120):
    rng = random.Random(seed)
    shared = [prose(rng, rng.randint(3, 30)) for _ in range(25)] + ["x" * 19, "y" * 20, "\U0001f642" * 20, "É" * 20, "é" * 20]
    rows = []
    for i in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.4 else prose(rng, rng.randint(0, 20)) for _ in range(rng.randint(0, 150))]
        lines = [rng.choice(["", " ", "\t", "\r"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "  ", "\r", "\x0b"]) for x in lines]
        rows.append((i, "\n".join(lines + ["a line that a third of the documents hold"] * (i % 3 == 0)), "en", "s", 0))
    rows += [rows[4], rows[4], rows[4], (9, rows[8][1], "en", "s", 0)]  # repeated rows; an id of two texts
    rows += [(None, rows[7][1], None, None, None), (None, rows[7][1], None, None, None), (None, "z" * 30, None, None, None)]
    rows += [(500 + i, "only lines of others\n" * 64, "en", "s", 0) for i in range(4)]
    return rows


def got(df):
    return sorted(((r.doc_id, r.lines.n_lines, r.lines.n_dropped, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows", [corpus(), lined()], ids=["corpus", "lines"])
def test_equal_to_brute_force(spark, rows):
    df = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(5)
    out = dedup_lines(df)
    assert set(df.columns) < set(out.columns)
    assert got(out) == brute(rows)


@pytest.mark.parametrize("share", [1, 10**9])
def test_hot_and_ranged_keys_are_decided_alike(spark, monkeypatch, share):
    """No key by counts (share 1: one with all rows), and every key by counts."""
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    rows = lined(3, 60)
    assert got(dedup_lines(spark.createDataFrame(rows, SCHEMA), least_documents=4)) == brute(rows, 4)


def test_hot_keys_hold_every_frequent_key(spark):
    from pyspark.sql import functions as F

    n = 60_000
    lines = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(8)).otherwise(F.xxhash64("id")).alias("h1"))
    hot = [r.h1 for r in line_dedup.hot_keys(lines.repartition(9), n).collect()]
    assert {7, 8} <= set(hot) and len(hot) < 1300


def test_bitmaps_are_runs_and_no_text(spark):
    from pyspark.sql import functions as F

    rows = [(i, "\n".join(["a shared line of some length"] * 70 + ["own"] * (i + 1) + ["another shared line of length"])) for i in range(3)]
    maps = {r.id: [(d.first, d.n) for d in r.drops] for r in keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert maps == {0: [(0, 70), (71, 1)], 1: [(0, 70), (72, 1)]}
    assert keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).columns == ["id", "row", "drops"]
    one = spark.createDataFrame([("a" * 10**6 + "\n" + "b\n" * 200_000,)], "text string").withColumn("doc_id", F.lit(1))
    assert dedup_lines(one).select("lines.n_lines").first()[0] == 200_002


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dedup_lines(none).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(lined(1, 20), SCHEMA)
    plan = dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("LocalTableScan", "") and "Pandas" not in plan
