"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression over the whole text (no user function,
no shuffle), every rule a row of ``RULES``. A
document is kept if it passes the base rules and every row of the table.

Defined cases: a null text counts as empty (no words, fails the base rule);
repeated rows are judged row by row; an empty table gives an empty result; the
input's other columns pass through (one named like ``out`` is replaced). Texts
of over 25 words in a language without listed stop words (they are English,
French, German and Spanish) fail the stop-word ratio. A very long text needs
memory for its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from multisvm.llm.common import WHITE, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Function words of the four languages, as written inside a sentence (fixed values).
STOP_WORDS = [
    # English
    "the", "of", "and", "to", "a", "in", "is", "it", "that", "was", "for", "on", "are", "as", "with", "be",
    "by", "this", "from", "at", "or", "an", "have", "not", "which",
    # German
    "der", "die", "das", "und", "ist", "ein", "eine", "den", "dem", "des", "zu", "von", "mit", "im", "für",
    "auf", "sich", "nicht", "auch", "es",
    # French
    "le", "la", "les", "et", "un", "une", "du", "que", "qui", "dans", "est", "pour", "par", "sur", "pas",
    "au", "avec", "ce", "il", "aux",
    # Spanish
    "el", "los", "las", "y", "se", "por", "con", "una", "su", "lo", "no", "al", "del", "como", "más", "o",
    # shared by several
    "de", "en",
]

# name, ratio (part + extra) / whole, smallest and largest value that is kept (None: no bound).
# The extra stop word lets texts of up to 25 words pass without any.
RULES: list[tuple[str, str, int, str, float | None, float | None]] = [
    ("mean_word_length", "word_chars", 0, "n_words", 2.0, 15.0),
    ("symbols_per_word", "n_symbols", 0, "n_words", None, 0.1),
    ("stop_word_ratio", "n_stop_words", 1, "n_words", 0.04, None),
    ("duplicate_line_ratio", "n_dup_lines", 0, "n_lines", None, 0.35),
]
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words"]


def verdict(facts: Column, rules=RULES) -> Column:
    """The threshold table as one boolean expression over the metrics' struct.
    A ratio without a value passes (the base rules see to empty texts)."""
    ok = F.lit(True)
    for _name, part, extra, whole, low, high in rules:
        value = F.try_divide(facts[part] + extra, facts[whole])
        if low is not None:
            ok = ok & F.coalesce(value >= F.lit(float(low)), F.lit(True))
        if high is not None:
            ok = ok & F.coalesce(value <= F.lit(float(high)), F.lit(True))
    return ok


def _repeat_words(w: Column) -> Column:
    """Words inside 5-word windows that the word array holds twice or more."""
    n = WINDOW

    def covered(at: Column) -> Column:
        gap = F.transform(at, lambda p, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - p, F.lit(n))))
        return F.aggregate(gap, F.lit(0), lambda a, b: a + b)

    def repeated(s: Column) -> Column:
        same = lambda k, h: F.coalesce(F.get(s, k)["h"] == h, F.lit(False))
        at = F.transform(s, lambda x, k: F.when(same(k - 1, x["h"]) | same(k + 1, x["h"]), x["i"]))
        return let(F.sort_array(F.filter(at, lambda p: p.isNotNull())), covered)

    def windows(wh: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(wh) - n), lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(n)]))
        # only texts with some window twice are sorted: (hash, position), equal hashes adjacent
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)))

    return F.when(F.size(w) < n, F.lit(0)).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), windows))


def quality_rules(df: DataFrame, text_col: str = "text", out: str = "quality", rules=RULES) -> DataFrame:
    """The input plus a struct ``out``: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_lines, n_stop_words (long), base_failed, kept.

    ``n_repeat_words`` counts the words inside 5-word windows found twice or
    more in the text (windows are compared by a 64-bit hash of their word
    hashes, inside one document only).
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bare = lambda c: F.translate(c, WHITE, "")
    lines = F.filter(F.split(text, "\n"), lambda line: bare(line) != "")
    facts = let(words(text), lambda w: let(lines, lambda ls: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(bare(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
        F.size(ls).cast("long").alias("n_lines"),
        F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )))
    judged = let(facts, lambda f: let(
        (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"]),
        lambda failed: F.struct(
            *[f[m].alias(m) for m in METRICS], failed.alias("base_failed"), (~failed & verdict(f, rules)).alias("kept")
        ),
    ))
    return df.withColumn(out, judged)
