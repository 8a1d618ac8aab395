import re
from collections import Counter

from helpers import SCHEMA, corpus, with_clashes
from multisvm.llm.quality_rules import STOP_WORDS, quality_rules


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    chars, symbols = sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text))
    dup, stop = len(lines) - len(set(lines)), sum(w in set(STOP_WORDS) for w in ws)
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    kept = not failed and 2 <= chars / len(ws) <= 15 and symbols / len(ws) <= 0.1 and (stop + 1) / len(ws) >= 0.04 \
        and dup / len(lines) <= 0.35
    return len(ws), chars, symbols, dup, len(covered), failed, kept


EXTRA = ["THE!! OF!! " * 30, "a*** b### " * 40, "one two three four five\none two three four five\nx y z", "| a | b " * 20,
         "the end of it\n" * 30, "the man and the dog ran to a house in the wood for it was late"]


def rows(spark):
    data = corpus() + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(EXTRA)]
    return data, spark.createDataFrame(data, SCHEMA)


def test_metrics_and_verdict_equal_brute_force(spark):
    data, df = rows(spark)
    out = with_clashes(df).transform(quality_rules).select("doc_id", "text", "quality.*").collect()
    assert len(out) == len(data)
    for r in out:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
        assert got == brute(r.text), r.text


def test_other_columns_pass_and_the_plan_has_no_python(spark):
    _, df = rows(spark)
    out = quality_rules(with_clashes(df), out="verdict")
    assert out.columns == [*with_clashes(df).columns, "verdict"]
    assert out.select("n_words").distinct().collect()[0][0] == "mine"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0

