import corpus_pipeline
import pytest
from helpers import SCHEMA, corpus, with_clashes
from multisvm.llm.common import DOCUMENT_COLUMNS, written
from multisvm.llm.simhash import fingerprint
from test_quality_rules import EXTRA
from test_quality_rules import brute as judged
from test_substrings import brute as cut



def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def docs(spark):
    data = corpus() + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(EXTRA)]
    return data, with_clashes(spark.createDataFrame(data, SCHEMA))


def test_stages_are_the_dealt_ones():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]


def test_every_stage_on_its_own_input(spark, docs):
    data, df = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, df, "").columns == DOCUMENT_COLUMNS
        assert f(spark, df.limit(0), "").count() == 0
    assert stage("best_fit_packing")(spark, df, "").count() >= len(data)


def test_quality_stage(spark, docs):
    data, df = docs
    got = sorted(str(tuple(r)) for r in stage("quality_rules")(spark, df, "").collect())
    assert got == sorted(str(d) for d in data if judged(d[1])[-1])


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs):
    data, df = docs
    kept = stage("simhash_near_dedup")(spark, df, "").collect()
    named = {}
    for i, t, *_ in data:
        if i is not None:
            named.setdefault(i, fingerprint(t))
    fps = sorted(set(named.values()))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, f in named.items():
        least[find(f)] = min(i, least.get(find(f), i))
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(least.values())
    assert sum(r.doc_id is None for r in kept) == sum(d[0] is None for d in data)


def test_substring_stage(spark, docs):
    data, df = docs
    got = sorted((str(r.doc_id), r.text or "") for r in stage("substring_dedup")(spark, df, "").collect())
    assert got == sorted((str(d[0]), w[2]) for d, w in zip(data, cut([d[1] for d in data])))
    for r in stage("substring_dedup")(spark, df, "").collect():
        assert r.text is None or r.n_chars == len(r.text)


def test_run_equals_the_stages_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = written(f(spark, docs, sf), name)
    whole = corpus_pipeline.run(spark, sf)
    a = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole.collect())
    b = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect())
    assert a == b and a


def test_near_duplicate_stage_keeps_a_row_of_every_group_of_a_shared_id(spark):
    import random

    from helpers import prose

    rng = random.Random(3)
    texts = [prose(rng, 60) for _ in range(12)]
    # id 5 stands on every text, each text in a group of its own; some have a row of a smaller id
    rows = [(5, t, "en", "s", 1) for t in texts for _ in range(2)] + [(i, texts[i], "en", "s", 1) for i in range(4)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, SCHEMA).coalesce(1)
        kept = stage("simhash_near_dedup")(spark, df, "").collect()
        assert sorted((r.text, r.doc_id) for r in kept) == sorted((t, i if i < 4 else 5) for i, t in enumerate(texts))


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
