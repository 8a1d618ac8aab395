"""Fixtures shared by the operators' tests."""

import random

SYLLABLES = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "ti"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Prose with exact and near copies, shared passages, nulls, empty and
    white texts, a very long text and repeated rows."""
    rng = random.Random(seed)
    passage = prose(rng, 50)
    texts: list[str | None] = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    texts += [texts[0], texts[0], texts[1] + " tail", f"{texts[2]}\n{passage}", f"{passage} {texts[3]}", passage, passage]
    texts += [None, None, "", "", "  \t\n", "a", "a a a a a a a a a a a a", "word " * 90, "ab cd " * 60, "été 日本 \U0001f642 x" * 5]
    texts += [prose(rng, 6000), "x" * 50_000]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, prose(rng, 30), None, None, None), (None, None, None, None, None)]
    return rows


CLASHING = ["quality", "removed", "language", "n_words", "fp", "id", "component_id", "_batch", "_text", "_rest", "batch", "value", "text2"]


def with_clashes(df):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    for c in CLASHING:
        df = df.withColumn(c, F.lit("mine"))
    return df


def same(a: dict, b: dict) -> None:
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == b[k], (k, a[k], b[k])
