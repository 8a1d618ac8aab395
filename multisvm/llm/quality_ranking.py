"""Quality classifier by Bradley-Terry pairwise ranking.

Every whole text gives a short vector of ratios. Labelled rows of different
label make preference pairs (the better one should win); weights minimize the
logistic loss on the pairs' feature differences, so a weighted sum ranks the
documents. The threshold is the quantile of the labelled rows' scores at the
share of rows labelled 0; a logistic function around it gives scores from 0 to
1 with 0.5 at the threshold.

Fitting uses every labelled row outside the held-out fold and every pair of
them. In a Newton step each task adds up, by label and score rounded to
``1 / BINS`` of a unit, the rows' counts, vectors and products of components; from
these sums (bounded in number) the driver gets the loss's slope and curvature
over all pairs, each pair's score difference being that of its two groups'
means. The threshold is an exact order statistic of all those rows' scores.
Results are rounded to ``DIGITS``, so that the order of sums does not show.

Defined cases: null and empty texts have the vector of an empty text and are
scored like any other; ids labelled more than once count once for each label
row; of several texts of a labelled id the one with the least vector teaches;
without both labels the weights are zero and the score is 0.5; repeated
rows are scored row by row; an empty table gives an empty result. A very long
text needs memory for its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from multisvm.llm.common import fold, workers, written
from multisvm.llm.ranks import value_at
from multisvm.operators.partials import PARTIAL_SCHEMA, partial_batch, reduce_partials

PAIRS = 100_000
STEPS = 30
DECAY = 1e-3
BINS, REACH = 32, 32  # groups a unit of score; scores beyond the reach share a group (the loss is flat there)
DIGITS = 9
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>@^~=+{}[]\\_")] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[list(b"!?")] = True
FEATURES = [
    "log_words", "symbols_per_word", "upper_share", "shouts_per_word", "digit_share", "distinct_share", "word_length",
    "repeats_next", "repeated_lines", "symbol_words", "lines_per_word", "top_word_share", "log_distinct", "log_symbols",
    "log_shouts",
]


def features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(raw, np.uint8)
    symbols, shouts = int(_SYMBOLS[data].sum()), int(_SHOUT[data].sum())
    lower = int(((data >= 97) & (data <= 122)).sum())
    upper, digits = int(((data >= 65) & (data <= 90)).sum()), int(((data >= 48) & (data <= 57)).sum())
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), symbols / n, upper / max(1, upper + lower), shouts / n, digits / len(raw), len(counts) / n,
        sum(map(len, words)) / n, sum(map(bytes.__eq__, words[1:], words)) / n,
        (len(lines) - len(set(lines))) / len(lines), sum(c for w, c in counts.items() if len(w) == 1 and _SYMBOLS[w[0]]) / n,
        len(lines) / n, max(counts.values()) / n, float(np.log1p(len(counts))),
        float(np.log1p(20 * symbols / n)), float(np.log1p(20 * shouts / n)),
    ]


def descend(width: int, sums, steps: int = STEPS) -> np.ndarray:
    """Weights by Newton steps; ``sums(w)`` gives the pair loss's slope and curvature."""
    w = np.zeros(width)
    for _ in range(steps):
        slope, curve = sums(w)
        step = np.linalg.solve(curve + DECAY * np.eye(width), slope + DECAY * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: np.ndarray, labels: np.ndarray, pairs: int = PAIRS, steps: int = STEPS):
    """(weights, threshold, scale, centre, spread) from feature rows and 0/1 labels
    in memory, on drawn pairs: :func:`fit_all` for a few rows."""
    width = rows.shape[1] if rows.ndim == 2 else len(FEATURES)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return np.zeros(width), 0.0, 1.0, np.zeros(width), np.ones(width)
    centre, spread = rows.mean(axis=0), rows.std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    x = (rows - centre) / spread
    draw = np.random.default_rng(7)
    n = min(pairs, len(good) * len(bad))
    delta = x[draw.choice(good, n)] - x[draw.choice(bad, n)]

    def sums(w):
        p = 1 / (1 + np.exp(np.clip(delta @ w, -30, 30)))  # chance that the worse one wins
        return -(delta * p[:, None]).mean(axis=0), (delta * (p * (1 - p))[:, None]).T @ delta / n

    w = descend(width, sums, steps)
    score = x @ w
    order = np.sort(score)
    at = len(bad)  # as many rows fall below the threshold as are labelled 0
    first_good = order[min(at, len(order) - 1)]
    below = order[order < first_good]  # equal scores stay on one side
    threshold = (first_good + below[-1]) / 2 if len(below) else first_good - 1e-9
    return w, float(threshold), float(max(1e-9, score.std() / 4)), centre, spread


def rounded(values, digits: int = DIGITS):
    """To so many significant digits."""
    values = np.asarray(values, float)
    size = 10.0 ** (digits - 1 - np.floor(np.log10(np.maximum(np.abs(values), 1e-30))))
    return np.round(values * size) / size


def group_sums(rows: DataFrame, centre: np.ndarray, spread: np.ndarray, w: np.ndarray):
    """(rows, sums of vectors, sums of products of two components) of each label
    and score group, label 0's groups first; vectors are centred and scaled."""
    width, groups = len(centre), 2 * BINS * REACH + 1
    i, j = np.triu_indices(width)

    def run(batches):
        count, sums = np.zeros(2 * groups, np.int64), np.zeros((2 * groups, width + len(i)))
        for b in batches:
            for low in range(0, b.num_rows, 4096):
                part = b.slice(low, 4096)
                label, times = part.column(0).to_numpy().astype(np.int64), part.column(1).to_numpy().astype(np.int64)
                x = (np.array(part.column(2).flatten()).reshape(-1, width) - centre) / spread
                key = label * groups + np.clip(np.rint(BINS * (x @ w)), -BINS * REACH, BINS * REACH).astype(np.int64) + BINS * REACH
                order = np.argsort(key, kind="stable")
                x, times, key = x[order], times[order], key[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                sums[key[first]] += np.add.reduceat(np.concatenate([x, x[:, i] * x[:, j]], axis=1) * times[:, None], first)
                count[key[first]] += np.add.reduceat(times, first)
        seen = np.flatnonzero(count)
        if len(seen):
            yield partial_batch(seen, count[seen], sums[seen])

    parts = rows.select("label", "times", "features").mapInArrow(run, PARTIAL_SCHEMA)
    sums, count = reduce_partials(parts, 2 * groups, width + len(i), rows.rdd.getNumPartitions())
    products = np.zeros((2 * groups, width, width))
    products[:, i, j] = products[:, j, i] = sums[:, width:]
    return count, sums[:, :width], products


def pair_sums(count: np.ndarray, sums: np.ndarray, products: np.ndarray, w: np.ndarray):
    """Slope and curvature of the mean loss over all pairs, from the groups."""
    half = len(count) // 2
    bad, good = np.flatnonzero(count[:half]), half + np.flatnonzero(count[half:])
    score = (sums @ w) / np.maximum(1, count)
    p = 1 / (1 + np.exp(np.clip(score[good][:, None] - score[bad][None, :], -30, 30)))  # chance that the worse one wins
    n_good, n_bad = count[good].astype(float), count[bad].astype(float)
    pairs = n_good.sum() * n_bad.sum()
    slope = ((p.T @ n_good) @ sums[bad] - (p @ n_bad) @ sums[good]) / pairs
    q = p * (1 - p)
    own = np.tensordot(q @ n_bad, products[good], 1) + np.tensordot(q.T @ n_good, products[bad], 1)
    cross = sums[good].T @ q @ sums[bad]
    return slope, (own - cross - cross.T) / pairs


def fit_all(rows: DataFrame):
    """(weights, threshold, scale, centre, spread) from all ``rows`` (label 0 or 1,
    times, features) and all their pairs; see the module's head."""
    width = len(FEATURES)
    still = np.zeros(width)
    count, sums, _ = group_sums(rows, still, np.ones(width), still)
    half = len(count) // 2
    n_bad, n = int(count[:half].sum()), int(count.sum())
    if not 0 < n_bad < n:
        return still, 0.0, 1.0, still, np.ones(width)
    centre = rounded(sums.sum(axis=0) / n, 12)
    _, _, products = group_sums(rows, centre, np.ones(width), still)
    spread = rounded(np.sqrt(np.diag(products.sum(axis=0)) / n), 12)
    spread = np.where(spread > 1e-9, spread, 1.0)
    last = []

    def step(w):
        last[:] = group_sums(rows, centre, spread, w)
        return pair_sums(*last, w)

    w = np.round(descend(width, step), DIGITS)
    mean, square = last[1].sum(axis=0) @ w / n, w @ last[2].sum(axis=0) @ w / n
    scale = float(rounded(np.sqrt(max(0.0, square - mean**2)) / 4))
    scored = rows.select("times", weighted_sum(w / spread, float((centre / spread) @ w)).alias("score"))
    first_good = value_at(scored, "score", min(n_bad, n - 1), F.col("times"))  # as many rows fall below as are labelled 0
    below = scored.where(F.col("score") < first_good).agg(F.max("score")).first()[0]  # equal scores stay on one side
    threshold = (first_good + below) / 2 if below is not None else first_good - 1e-9
    return w, float(threshold), max(1e-9, scale), centre, spread


def weighted_sum(weight: np.ndarray, shift: float):
    """The features' weighted sum, less the shift."""
    total = F.lit(-shift)
    for i, v in enumerate(weight.tolist()):
        total = total + F.get("features", F.lit(i)) * F.lit(v)
    return total


def feature_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features array<double>), one row a row."""
    workers(df.sparkSession)

    def run(batches):
        for b in batches:
            for low in range(0, b.num_rows, 512):
                part = b.slice(low, 512)
                rows = [features(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "features"])

    of = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return of.mapInArrow(run, f"id {of.schema['id'].dataType.simpleString()}, features array<double>")


def rank_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted): one row an input row."""
    known = written(feature_rows(df, id_col, text_col), "features")
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    marked = marked.where((fold(F.col("id")) != 1) & F.col("label").isin(0, 1))
    marked = marked.groupBy("id", "label").agg(F.count(F.lit(1)).alias("times"))
    least = known.where(fold(F.col("id")) != 1).groupBy("id").agg(F.min("features").alias("features"))
    rows = written(least.join(marked, "id").sortWithinPartitions("id", "label").select("label", "times", "features"), "training")
    w, threshold, scale, centre, spread = fit_all(rows)
    score = weighted_sum(w / spread / scale, (float((centre / spread) @ w) + threshold) / scale)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score))))
    done = known.select(F.col("id").alias(id_col), (fold(F.col("id")) == 1).alias("held_out"), score.alias("score"))
    return done.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
