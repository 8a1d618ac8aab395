import re

from helpers import SCHEMA, corpus, prose, with_clashes
from multisvm.llm.licenses import CONTAINMENT, SHINGLE, TEMPLATES, scan_licenses


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(data, templates=TEMPLATES):
    found = {}
    for doc_id, text, *_ in data:
        ws = tokens(text)
        for name, body in templates:
            t = tokens(body)
            n = min(SHINGLE, len(t))
            want = {tuple(t[i:i + n]) for i in range(len(t) - n + 1)}
            span = len(t) - n + 1
            grams = [tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)]
            for at in range(0, max(0, len(grams)), span):
                part = grams[at:at + 2 * span]
                share = len(want & set(part)) / len(want)
                if share >= CONTAINMENT:
                    first = at + min(i for i, g in enumerate(part) if g in want)
                    old = found.get((doc_id, name), (0.0, set(), 1 << 60))
                    found[doc_id, name] = (max(old[0], share), old[1] | {at}, min(old[2], first))
    return {k: (v[0], len(v[1]), v[2]) for k, v in found.items()}


def planted():
    import random

    rng = random.Random(5)
    data = corpus()
    for i, (_, body) in enumerate(TEMPLATES):
        ws = body.split()
        if len(ws) > 20:
            ws[len(ws) // 2] = "other"  # a changed word leaves five shingles out
        data.append((2000 + i, f"{prose(rng, rng.randint(0, 40))}\n{' '.join(ws).upper()}\n{prose(rng, 20)}", "en", "s", 1))
        data.append((3000 + i, f"{prose(rng, 3)} {body} {prose(rng, 9)} {body}", "en", "s", 1))
        data.append((4000 + i, " ".join(body.split()[: len(ws) // 2]), "en", "s", 1))
    return data


def test_matches_equal_brute_force(spark):
    data = planted()
    df = with_clashes(spark.createDataFrame(data, SCHEMA))
    got = {(r.doc_id, r.template_id): (r.containment, r.n_windows, r.first_word) for r in scan_licenses(df).collect()}
    want = brute(data)
    assert got == want and len(want) >= 2 * len(TEMPLATES) - 4


def test_main_path_has_no_python_and_empty_tables_work(spark):
    empty = scan_licenses(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    plan = scan_licenses(spark.createDataFrame(corpus(), SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_longer_windows_find_edited_notices_wherever_they_start(spark):
    import random

    rng = random.Random(7)
    name, body = next(t for t in TEMPLATES if t[0] == "mit-permission")
    t = tokens(body)
    want = {tuple(t[i:i + SHINGLE]) for i in range(len(t) - SHINGLE + 1)}
    span = len(t) - SHINGLE + 1
    edited = t[:15] + [f"extra{i}" for i in range(2 * span - 4)] + t[15:]
    words = [prose(rng, 1) for _ in range(span + 1)]
    data = [(k, " ".join(words[:k] + edited + words), "en", "s", 1) for k in range(span)]
    # brute force: windows of the longest extent, from every start position
    for _, text, *_ in data:
        ws = tokens(text)
        grams = [tuple(ws[i:i + SHINGLE]) for i in range(len(ws) - SHINGLE + 1)]
        assert max(len(want & set(grams[at:at + 3 * span + 1])) for at in range(len(grams))) >= CONTAINMENT * len(want)
    found = scan_licenses(spark.createDataFrame(data, SCHEMA), templates=[(name, body)], reach=4).collect()
    assert {r.doc_id: r.first_word for r in found} == {k: k for k in range(span)}


def test_texts_that_share_an_id_are_each_verified(spark):
    name, body = next(t for t in TEMPLATES if t[0] == "mit-permission")
    ws = body.split()
    # windows of one number: each stray one shares a band shingle or more with the template
    strays = [" ".join(["other"] * k + ws[k:k + 15]) for k in range(len(ws) - 15)]
    for key in (7, None):
        rows = [(key, t, "en", "s", 1) for t in [*strays, body, body, *strays]]
        for order in (rows, rows[::-1], rows[len(strays):]):
            df = spark.createDataFrame(order, SCHEMA).coalesce(1)
            got = [(r.doc_id, r.containment, r.n_windows, r.first_word) for r in scan_licenses(df, templates=[(name, body)]).collect()]
            assert got == [(key, 1.0, 1, 0)]
