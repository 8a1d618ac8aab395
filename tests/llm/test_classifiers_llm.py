import random
import zlib

import numpy as np
from helpers import SCHEMA, corpus, with_clashes
from multisvm.llm import language, quality_ranking
from multisvm.llm.queries import op8_quality_ranking, op9_language
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op9_language(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = op8_quality_ranking(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in rows) / len(rows) > 0.97
    good, bad = [[r.score for r in rows if r.quality == q] for q in (1, 0)]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    data = [(i, t, "en" if i % 2 else "xx", "s", 1) for i, t in enumerate(["the of and"] * 20 + ["über schon"] * 20)]
    held = [d for d in data if zlib.crc32(str(d[0]).encode()) % 3 == 1]
    df = spark.createDataFrame(data, SCHEMA)
    changed = df.withColumn("lang", F.when(F.col("doc_id").isin([d[0] for d in held]), "zz").otherwise(F.col("lang")))
    a = sorted(tuple(r) for r in language.identify(df).select("doc_id", "language.*").collect())
    assert a == sorted(tuple(r) for r in language.identify(changed).select("doc_id", "language.*").collect())


def test_kernel_is_the_shared_presence_count():
    texts = ["abc abd", "abd xyz", "xyz"]
    model = language.fit(texts, ["a", "b", "c"], landmarks=1)

    def grams(t):
        t = "".join(map(chr, language.points(t)))
        return {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    for i, row in enumerate(model.kernel(texts)):
        for j, value in enumerate(row):
            a, b = grams(texts[i]), grams(texts[j])
            assert abs(value - len(a & b) / np.sqrt(len(a) * len(b))) < 1e-6


def test_language_edge_cases(spark):
    df = with_clashes(spark.createDataFrame(corpus(), SCHEMA))
    out = language.identify(df)
    assert set(out.columns) == set(df.columns) and out.count() == len(corpus())
    for r in out.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.language.lang_pred == "und") == (not letters) and 0 <= r.language.score <= 1
    unlabelled = language.identify(df.withColumn("lang", F.lit(None).cast("string"))).select("language.lang_pred").distinct().collect()
    assert [r[0] for r in unlabelled] == ["und"]
    assert language.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quality_edge_cases(spark):
    data = corpus()
    df = with_clashes(spark.createDataFrame(data, SCHEMA))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_ranking.rank_quality(df, labels).collect()
    assert len(out) == len(data) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    none = quality_ranking.rank_quality(df, labels.where("quality = 7")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_ranking.rank_quality(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_ranking_learns_the_better_side():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (3000, 4))
    y = (x @ np.array([2.0, -1.0, 0.0, 0.5]) + rng.normal(0, 0.2, 3000) > 1).astype(int)
    w, threshold, _, centre, spread = quality_ranking.fit(x, y)
    score = (x - centre) / spread @ w
    assert ((score > threshold) == y).mean() > 0.95 and abs((score > threshold).mean() - y.mean()) < 0.01
    random.seed(0)


def test_numerals_are_no_letters(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["the of and"] * 20 + ["²", "½ ³", "③ Ⅷ", "ª", "x²", "12_3", "日"])]
    out = {r.text: r.language.lang_pred for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [t for t, p in out.items() if p == "und"] == ["²", "½ ³", "③ Ⅷ", "12_3"]


def test_pieces_have_the_grams_of_the_whole(monkeypatch):
    rng = random.Random(5)
    text = "  " + "".join(rng.choice("abcé 1.,\n日") for _ in range(3000)) + " .. "
    model = language.fit([text, "abc ab"], ["a", "b"])
    whole = model.distinct(text)
    for size in (1, 7, 50, 2990):
        monkeypatch.setattr(language, "PIECE", size)
        assert np.array_equal(model.distinct(text), whole)


def test_memory_follows_the_ngrams_not_the_alphabet():
    import tracemalloc

    rng = random.Random(6)
    letters = [chr(0x4E00 + i) for i in range(2000)]
    texts = ["".join(rng.choices(letters, k=600)) for _ in range(40)]
    tracemalloc.start()
    model = language.fit(texts, ["a", "b"] * 20, landmarks=10)
    model.predict(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.letters) > 1900 and peak < 200_000_000


def test_ridge_equals_a_dense_solution():
    """With every text a landmark, Nystroem features lose nothing: plain kernel ridge regression."""
    rng = random.Random(7)
    texts = ["".join(rng.choices("abcdef ghij", k=rng.randint(5, 60))) + "a" for _ in range(24)]
    names = [rng.choice("xyz") for _ in texts]
    model = language.fit(texts, names, landmarks=24, ridge=0.05)
    sets = [set(model.distinct(t).tolist()) for t in texts]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    target = np.array([[float(n == m) for m in model.languages] for n in names])
    want = kernel @ np.linalg.solve(kernel + 0.05 * len(texts) * np.eye(len(texts)), target)
    assert np.abs(model.kernel(texts) @ model.coefficients - want).max() < 1e-3


def test_no_text_is_shuffled_by_language(spark, monkeypatch):
    """The rows meet the counts without an exchange, and only the sample's share is moved."""
    df = spark.range(4000).selectExpr("id as doc_id", "concat('the words of text ', id) as text", "if(id % 3 = 0, 'a', 'b') as lang")
    df = df.unionByName(df.where("doc_id = 5").crossJoin(spark.range(500)).selectExpr("doc_id", "text", "lang"))  # a repeated row
    df = df.unionByName(spark.range(500).selectExpr("cast(null as long) as doc_id", "concat('more words ', id) as text", "'a' as lang"))
    plans = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    rows = language.training_rows(df, "doc_id", "text", "lang", 20)
    last = plans[-1]
    joined = last.index("BroadcastHashJoin")
    assert "SortMergeJoin" not in last and "Exchange hashpartitioning" not in last[joined:]
    assert len(rows) == 40 and len({r["text"] for r in rows}) == 40


def test_accepted_texts_reach_the_learned_score(spark):
    rng = random.Random(8)
    words = {"a": ["the", "of", "and", "then", "that"], "b": ["sch", "und", "ein", "nicht", "auch"]}
    rows = [(i, " ".join(rng.choices(words["ab"[i % 2]], k=30)), "ab"[i % 2], "s", 1) for i in range(400)]
    odd = [(1000, "これは日本語の文章です" * 5, None, "s", 1), (1001, "zqx wvk jpf qqz" * 5, None, "s", 1), (1002, "²", None, "s", 1), (1003, None, None, "s", 1)]
    out = {r.doc_id: r.language.accepted for r in language.identify(spark.createDataFrame(rows + odd, SCHEMA), per_language=50).collect()}
    assert all(out[i] for i in range(400)) and not any(out[1000 + i] for i in range(4))


def test_pair_weights_equal_a_plain_descent():
    """Newton steps on the pair loss against gradient descent on the same pairs."""
    rng = np.random.default_rng(2)
    rows = rng.normal(0, 1, (60, 3)) * [1.0, 5.0, 0.2] + 3
    labels = (rows @ [1.0, 0.1, -2.0] + rng.normal(0, 1.0, 60) > np.median(rows @ [1.0, 0.1, -2.0])).astype(int)
    w, _, _, centre, spread = quality_ranking.fit(rows, labels, pairs=500)
    x = (rows - centre) / spread
    draw = np.random.default_rng(7)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    delta = x[draw.choice(good, 500)] - x[draw.choice(bad, 500)]
    v = np.zeros(3)
    for _ in range(20_000):
        v -= 0.2 * (-(delta / (1 + np.exp(delta @ v))[:, None]).mean(axis=0) + quality_ranking.DECAY * v)
    assert np.abs(v - w).max() < 1e-4


def test_training_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 30, f"{'good words here' if i % 2 else '# $ % !!'} {i}", None, None, 0) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(3, 1, 0)], "doc_id long, quality int, toxic int")
    a, b = (sorted((r.doc_id, r.score) for r in quality_ranking.rank_quality(spark.createDataFrame(x, SCHEMA), labels).collect()) for x in (rows, rows[::-1]))
    assert a == b


def pair_rows(n=900):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (n, len(quality_ranking.FEATURES))) * np.linspace(0.1, 4, len(quality_ranking.FEATURES)) + 2
    x[:, 4] = 7.0  # a constant component
    labels = (x[:, 0] * 10 - x[:, 1] + rng.normal(0, 1, n) > np.quantile(x[:, 0] * 10 - x[:, 1], 0.3)).astype(int)
    return x, labels


def test_quality_learns_from_every_row_and_every_pair(spark):
    """Weights of plain Newton steps over all pairs of all rows, repeats counted; threshold of all scores."""
    x, labels = pair_rows()
    times = [3 if i % 10 == 0 else 1 for i in range(len(x))]
    data = [(int(y), t, r.tolist()) for r, y, t in zip(x, labels, times)]
    rows = spark.createDataFrame(data, "label int, times long, features array<double>").repartition(5)
    w, threshold, scale, centre, spread = quality_ranking.fit_all(rows)
    every, marks = np.repeat(x, times, axis=0), np.repeat(labels, times)
    assert np.allclose(centre, every.mean(axis=0)) and spread[4] == 1.0
    z = (every - every.mean(axis=0)) / np.where(every.std(axis=0) > 1e-9, every.std(axis=0), 1.0)
    delta = (z[marks == 1][:, None, :] - z[marks == 0][None, :, :]).reshape(-1, z.shape[1])

    def sums(v):
        p = 1 / (1 + np.exp(np.clip(delta @ v, -30, 30)))
        return -(delta * p[:, None]).mean(axis=0), (delta * (p * (1 - p))[:, None]).T @ delta / len(delta)

    v = quality_ranking.descend(z.shape[1], sums)
    assert np.abs(v - w).max() < 1e-3 * np.abs(v).max()
    score = z @ w
    assert (score < threshold).sum() == (marks == 0).sum() and abs(scale - score.std() / 4) < 1e-6


def test_quality_counts_labels_beyond_any_fixed_number(spark, monkeypatch):
    """All labelled rows outside the held-out fold reach the fit."""
    docs = spark.range(30_000).selectExpr("id as doc_id", "if(id % 3 = 0, '# $ % !!', concat('good words here ', id)) as text")
    labels = docs.selectExpr("doc_id", "if(doc_id % 3 = 0, 0, 1) as quality")
    seen = []
    fit_all = quality_ranking.fit_all
    monkeypatch.setattr(quality_ranking, "fit_all", lambda rows: seen.append(rows.count()) or fit_all(rows))
    out = quality_ranking.rank_quality(docs, labels)
    assert out.where("predicted != if(doc_id % 3 = 0, 0, 1)").count() == 0
    assert seen == [sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(30_000))]


def test_order_statistics_are_exact(spark):
    from multisvm.llm import ranks

    rng = random.Random(11)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-9), 1e9, 0.5]) for _ in range(500)]
    times = [rng.randint(1, 3) for _ in values]
    rows = spark.createDataFrame(list(zip(values, times)), "v double, t int")
    every = sorted(v for v, t in zip(values, times) for _ in range(t))
    for k in (0, 3, 137, 400, len(every) - 1):
        assert ranks.value_at(rows, "v", k, F.col("t")) == every[k]
    assert abs(ranks.quantile(rows, "v", 0.137) - np.quantile(values, 0.137)) < 1e-12


def test_languages_learn_from_every_text(spark):
    """Coefficients are those of all texts in memory (repeated rows once), also far beyond the landmarks."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices(["the", "of", "then", "und", "sch", "ein"], k=9)) + f" w{i}", "ab"[rng.random() < 0.3]) for i in range(900)]
    df = spark.createDataFrame(rows + rows[:40] + rows[:40], "id long, text string, lang string").repartition(5)
    marks = [{"lang": n, "text": t} for n in "ab" for t in [r[1] for r in rows if r[2] == n][:6]]
    model = language.learn(marks, language.once(df))
    first = [m["text"] for m in marks]
    rest = [r for r in rows if r[1] not in first]
    plain = language.fit(first + [r[1] for r in rest], [m["lang"] for m in marks] + [r[2] for r in rest], landmarks=6)
    assert np.abs(model.coefficients - plain.coefficients).max() < 1e-3 * np.abs(plain.coefficients).max()
    assert 0 < model.least <= language.SLACK


def test_the_least_score_counts_every_text(spark):
    """One odd text in fifty tells the low quantile, wherever it lies in the order of hashes."""
    words = {"a": "the of and then that", "b": "sch und ein nicht auch"}
    rows = [(i, f"{words['ab'[i % 2]]} {i}", "ab"[i % 2]) for i in range(1500)]
    odd = [(i, "qzx " * 60 if i % 50 == 0 else t, n) for i, t, n in rows]
    made = [language.learn([{"lang": n, "text": words[n]} for n in "ab"], language.once(spark.createDataFrame(x, "id long, text string, lang string"))) for x in (rows, odd)]
    assert made[1].least < 0.5 * made[0].least


def test_a_language_of_one_repeated_row_is_learned(spark):
    rows = [(i, "the of and then that", "a") for i in range(60)] + [(72, "sch und ein nicht auch", "b")] * 3000
    assert zlib.crc32(b"72") % 3 != 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r.lang, r.lang_pred) for r in language.identify(df).select("lang", "language.*").collect()} == {("a", "a"), ("b", "b")}
