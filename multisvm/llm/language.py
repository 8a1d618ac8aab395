"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts counts the character n-grams
(1 to 3, words lower-cased and set between blanks) that both contain; it is
normalized by the texts' own kernel values. Landmarks from every language give
Nystroem features, one-versus-rest kernel ridge regression is fitted on them,
and texts are scored in batches: presence matrix x landmark n-grams, then
kernel values x coefficients.

Fitting reads every whole text with a language outside the held-out fold. The
basis is bounded: ``LANDMARKS_PER_LANGUAGE`` landmarks a language (the least hashes
of id and text, texts of ``TRAIN_CHARS`` characters first). Tasks add up the
products of all texts' kernel values, in two halves of the ids; coefficients
come from the sums of both. What score a text of the learned languages has at
least is told by all of them again, each scored by the half it is not in; a text
is ``accepted`` if its own reaches ``SLACK`` of their exact ``LOW_QUANTILE``. Scoring reads
every whole text. The number of languages is the number of labels in the data
(each adds its landmarks to the model); over ``MOST_LANGUAGES`` is an error.

Defined cases: null texts and texts without a letter are ``und`` with score 0
and not accepted; equal scores go to the alphabetically first language; null
languages teach nothing, rows of one id and text teach once; with no row to
learn from every text is ``und``; repeated rows are scored row by row; an empty
table gives an empty result. A very long text is read in pieces of ``PIECE``
characters that end between words; what is kept of it are its distinct n-grams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from multisvm.llm.common import fold, workers, written
from multisvm.llm.ranks import quantile
from multisvm.operators.partials import PARTIAL_SCHEMA, partial_batch, reduce_partials

LANDMARKS_PER_LANGUAGE = 32
TRAIN_CHARS = (200, 4000)
RIDGE = 1e-3
LOW_QUANTILE, SLACK = 0.001, 0.5
MOST_LANGUAGES = 2000
PIECE = 1 << 20
UNKNOWN = "und"
_WORDED = re.compile(r"[^\W\d_]+")
_BLANKS = re.compile(r"[\W\d_]+")


def points(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, each word between blanks."""
    plain = " " + _BLANKS.sub(" ", text.lower()).strip() + " "
    return np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)


def has_letter(text: str | None) -> bool:
    """Is there a character of a letter category (not a numeral such as a superscript)?"""
    return bool(text) and any(any(map(str.isalpha, m.group())) for m in _WORDED.finditer(text))


def pieces(text: str) -> Iterator[np.ndarray]:
    """``points`` of a text in runs of about ``PIECE`` characters. Runs end
    between words and repeat the letter before, so that their n-grams together
    are those of the whole."""
    start, tail = 0, None
    while True:
        blank = _BLANKS.search(text, start + PIECE) if len(text) - start > PIECE else None
        end = blank.start() if blank else len(text)
        at = points(text[start:end])
        last = end == len(text)
        if len(at) > 2 or last and tail is None:
            yield at if tail is None else np.concatenate([tail, at])
            tail = at[-2:-1]
        if last:
            return
        start = end


@dataclass
class Model:
    languages: list[str]
    letters: np.ndarray  # sorted code points of the landmarks
    codes: np.ndarray  # sorted n-gram codes of the landmarks
    grams: np.ndarray  # presence of each code in each landmark, normalized by landmark
    coefficients: np.ndarray  # landmarks x languages
    least: float = 0.0  # score of an accepted text

    def grams_of(self, at: np.ndarray) -> np.ndarray:
        """Codes of the 1-, 2- and 3-grams (0-based blocks; digits are places
        among the known letters, 0 for any other)."""
        place = np.searchsorted(self.letters, at)
        known = self.letters[np.minimum(place, len(self.letters) - 1)] == at
        a = np.where(known, place + 1, 0)
        n = len(self.letters) + 1
        two = a[:-1] * n + a[1:]
        return np.concatenate([a, n + two, n + n * n + two[:-1] * n + a[2:]])

    def distinct(self, text: str) -> np.ndarray:
        """Sorted distinct n-gram codes of a whole text."""
        found = None
        for at in pieces(text):
            codes = self.grams_of(at)
            codes.sort()
            codes = codes[np.append(True, codes[1:] != codes[:-1])]
            found = codes if found is None else np.union1d(found, codes)
        return found

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Normalized kernel values of the texts with the landmarks."""
        rows = np.zeros((len(texts), len(self.codes)), np.float32)
        own = np.ones(len(texts), np.float32)
        for i, t in enumerate(texts):
            codes = self.distinct(t)
            place = np.searchsorted(self.codes, codes)
            rows[i, place[self.codes[np.minimum(place, len(self.codes) - 1)] == codes]] = 1
            own[i] = max(1, len(codes))
        return (rows @ self.grams) / np.sqrt(own)[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not len(texts) or not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        scores = self.kernel(texts) @ self.coefficients
        best = scores.argmax(axis=1)
        return [self.languages[i] for i in best], np.clip(scores[np.arange(len(best)), best], 0, 1).astype(float)


def basis(texts: list[str], languages: list[str], landmarks: int = LANDMARKS_PER_LANGUAGE) -> tuple[Model, np.ndarray]:
    """A model without coefficients, whose landmarks are the first ``landmarks``
    texts of each language, and the map from its kernel values to Nystroem features."""
    names = sorted(set(languages))
    if not names:
        none = np.zeros(0)
        return Model([], none, none, none, none), none
    marks = [t for name in names for t in [x for x, of in zip(texts, languages) if of == name][:landmarks]]
    letters = np.unique(np.concatenate([np.unique(at) for t in marks for at in pieces(t)])).astype(np.int64)
    model = Model(names, letters, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    sets = [model.distinct(t) for t in marks]
    model.codes = np.unique(np.concatenate(sets))
    model.grams = np.zeros((len(model.codes), len(marks)), np.float32)
    for j, s in enumerate(sets):
        model.grams[np.searchsorted(model.codes, s), j] = 1 / np.sqrt(len(s))
    values, vectors = np.linalg.eigh(model.kernel(marks).astype(float))
    good = values > 1e-6 * values.max()
    return model, vectors[:, good] / np.sqrt(values[good])


def solved(root: np.ndarray, kernels: np.ndarray, targets: np.ndarray, n: int, ridge: float = RIDGE) -> np.ndarray:
    """Coefficients from ``n`` texts' sums: products of two kernel values, and
    kernel values by language."""
    system = root.T @ kernels @ root + ridge * max(1, n) * np.eye(root.shape[1])
    return (root @ np.linalg.solve(system, root.T @ targets)).astype(np.float32)


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on Nystroem features, of texts in memory."""
    model, root = basis(texts, languages, landmarks)
    if model.languages:
        values = np.concatenate([model.kernel(texts[i:i + 256]) for i in range(0, len(texts), 256)]).astype(float)
        target = np.array([[float(of == name) for name in model.languages] for of in languages])
        model.coefficients = solved(root, values.T @ values, values.T @ target, len(texts), ridge)
    return model


def teaching(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, text, lang) of the rows to learn from: a language, a letter, not held out."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    return rows.where((fold(F.col("id")) != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))


def training_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list:
    """Landmarks: (lang, text), at most ``per_language`` rows each, ranked.

    A count per language gives the share of hash values that holds some four
    times the rows wanted; the counts (a row a language) meet the rows without a
    shuffle, and only the rows in that share are moved and ranked."""
    rows = teaching(df, id_col, text_col, lang_col)
    usual = F.length("text").between(*TRAIN_CHARS)
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    rows = rows.select("id", "text", "lang", usual.alias("usual"), place.alias("place"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.col("usual").cast("long")).alias("n_usual"))
    known = counts.limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn; is {lang_col} a language?")
    shares = [(r.lang, r.n_usual >= per_language, 4.0 * per_language / (r.n_usual if r.n_usual >= per_language else r.n)) for r in known]

    def pick(shares: list) -> list:
        shares = df.sparkSession.createDataFrame(shares, "lang string, enough boolean, share double")
        few = rows.join(F.broadcast(shares), "lang").where((F.col("usual") | ~F.col("enough")) & (F.col("place") < F.col("share")))
        few = few.dropDuplicates(["lang", "id", "text"])  # combined in tasks first
        order = Window.partitionBy("lang").orderBy(F.desc("usual"), "place", "id")
        ranked = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language)
        return ranked.select("lang", "text", "k").orderBy("lang", "k").collect()

    found = pick(shares)
    missing = [(lang, enough, 2.0) for lang, enough, _ in shares if lang not in {r.lang for r in found}]
    return sorted(found + pick(missing), key=lambda r: (r.lang, r.k)) if missing else found  # a few rows, often repeated


def once(rows: DataFrame) -> DataFrame:
    """(text, lang, half, share): repeated rows of one id and text share one
    row's weight. Only keys are moved to find them; the few that repeat meet the
    rows by a join whose kind Spark chooses by their size."""
    name = F.xxhash64("id", "text", "lang")
    rows = rows.select("text", "lang", name.alias("name"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("half"))
    repeated = rows.groupBy("name").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    met = rows.join(written(repeated, "repeated"), "name", "left")
    return met.select("text", "lang", "half", (1 / F.coalesce("times", F.lit(1))).alias("share"))


def learn(marks: list, rows: DataFrame) -> Model:
    """A model of the landmarks ``marks`` (lang, text), fitted on all ``rows`` of
    :func:`once`, with the least score of an accepted text."""
    model, root = basis([r["text"] for r in marks], [r["lang"] for r in marks], len(marks))
    if not model.languages:
        return model
    m, k = len(root), len(model.languages)
    sent = rows.sparkSession.sparkContext.broadcast((model, {name: i for i, name in enumerate(model.languages)}))  # bounded by the landmarks

    def parts(batches):
        for b in batches:
            for low in range(0, b.num_rows, 128):
                part = b.slice(low, 128)
                known = [sent.value[1][name] for name in part.column(1).to_pylist()]
                yield (sent.value[0].kernel(part.column(0).to_pylist()).astype(float), np.eye(k)[known],
                       part.column(2).to_numpy(), part.column(3).to_numpy())

    def sums(batches):
        total, seen = np.zeros((2, m + 1, m + k)), np.zeros(2, bool)
        for values, target, half, share in parts(batches):
            for h in np.unique(half):
                own = half == h
                weighted = values[own] * share[own][:, None]
                total[h, :m] += weighted.T @ np.concatenate([values[own], target[own]], axis=1)
                total[h, m, m:] += share[own] @ target[own]  # texts of each language
                seen[h] = True
        if seen.any():
            yield partial_batch(np.arange(2 * (m + 1)), np.zeros(2 * (m + 1)), total.reshape(-1, m + k))

    columns = rows.select("text", "lang", "half", "share")
    found, _ = reduce_partials(columns.mapInArrow(sums, PARTIAL_SCHEMA), 2 * (m + 1), m + k, columns.rdd.getNumPartitions())
    halves = found.reshape(2, m + 1, m + k)

    def coefficients(total: np.ndarray) -> np.ndarray:
        return solved(root, total[:m, :m], total[:m, m:], total[m, m:].sum())

    model.coefficients = coefficients(halves.sum(axis=0))
    # what the other half has not learned (few texts) is told by the whole fit
    other = [np.where(halves[1 - h, m, m:] > 0.5, coefficients(halves[1 - h]), model.coefficients) for h in (0, 1)]

    def scores(batches):
        for values, target, half, _ in parts(batches):
            known = target.argmax(axis=1)
            best = np.zeros(len(half))
            for h in np.unique(half):
                own = half == h
                learned = halves[1 - h, m, m:] > 0.5
                best[own] = np.where(learned[known[own]], (values[own] @ other[h]).max(axis=1), (values[own] @ model.coefficients).max(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(best, 0, 1).round(9))], names=["score"])

    model.least = SLACK * quantile(written(columns.mapInArrow(scores, "score double"), "scores"), "score", LOW_QUANTILE)
    sent.unpersist()
    return model


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", out: str = "language",
             learn_from: DataFrame | None = None, per_language: int = LANDMARKS_PER_LANGUAGE) -> DataFrame:
    """The input plus a struct ``out``: lang_pred, score (0 to 1), accepted. The model is
    learned from ``learn_from`` (the input itself if none is given), never from
    rows of the held-out fold, with ``per_language`` landmarks a language. (A column
    named like ``out`` is replaced.)"""
    spark = df.sparkSession
    workers(spark)
    source = df if learn_from is None else learn_from
    marks = training_rows(source, id_col, text_col, lang_col, per_language)
    model = spark.sparkContext.broadcast(learn(marks, once(teaching(source, id_col, text_col, lang_col))))  # bounded by the landmarks

    def run(batches):
        for b in batches:
            for low in range(0, b.num_rows, 128):
                part = b.slice(low, 128)
                texts = part.column(0).to_pylist()
                known = [i for i, t in enumerate(texts) if has_letter(t)]
                pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                got, value = model.value.predict([texts[i] for i in known])
                for i, p, v in zip(known, got, value):
                    pred[i], score[i] = p, v
                accepted = [p != UNKNOWN and v >= model.value.least for p, v in zip(pred, score)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                    names=["_rest", "lang_pred", "score", "accepted"],
                )

    carried = [c for c in df.columns if c != out]
    given = df.select(F.col(f"`{text_col}`").cast("string").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_rest"))
    done = given.mapInArrow(run, f"_rest {given.schema['_rest'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")
    return done.select(*[F.col(f"_rest.`{c}`").alias(c) for c in carried], F.struct("lang_pred", "score", "accepted").alias(out))
