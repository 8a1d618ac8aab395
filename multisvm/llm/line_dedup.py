"""Line deduplication with DataFrame functions only.

Hashes of lines are range-partitioned and sorted by document and position;
first occurrences are streamed, and what comes back is a compressed keep
bitmap a document, no text.

1. Every line of enough code points gives (128-bit hash of its key, document,
   row, position), written once. The key is the line without white space at
   both ends and with A-Z lower-cased.
2. Keys that hold over a thousandth of all lines (or a million of them) are
   found by a mergeable frequency sketch of all lines, whose error bound makes
   sure that none is overlooked. They are decided by counts that tasks combine
   before the shuffle; their list is short by the same bound (under 1,300 keys
   and two a million lines) and broadcast.
3. All other keys are range-partitioned by hash and sorted by document (largest
   first) and position: the first document of a key in that order keeps its
   lines, those of the later ones go if the key is in enough documents.
4. Dropped positions become words of 64 bits by document (combined in tasks
   before the shuffle) and then runs: ``drops``, the zeros of the keep bitmap
   as (first line, number of lines). Documents that keep every line have none.

Defined cases: a null or empty text is one empty line; the rows of one id,
null included, are one document, and a null id is less than any other; a key
that a document repeats counts once there and stays or goes as a whole; equal
rows get equal bitmaps; a text whose lines all go becomes the empty string;
extra columns are kept as they are; an empty table gives an empty result. A
very long text is split by rows of lines and needs memory for its own text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from multisvm.llm.common import WHITE, let, written

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
# Rows of a key, and share of all rows, above which it is decided by counts.
HOT_ROWS = 1_000_000
HOT_SHARE = 1_000
# Sketch: items of the smallest and the largest one, and how many are made in parallel.
TRACKED, MOST_TRACKED, SKETCHES = 10_000, 1_000_000, 64


def line_key(line: Column) -> Column:
    bare = F.trim(line, F.lit(WHITE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def line_hashes(df: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(h1, h2, id, row, pos): the lines that can be dropped."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    lines = rows.select("id", F.xxhash64("t").alias("row"), F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    keys = lines.select("id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "id", "row", "pos")


def hot_keys(lines: DataFrame, n: int) -> DataFrame:
    """h1 of every key with more than a ``HOT_SHARE``-th of the n rows or
    ``HOT_ROWS`` of them (and of some keys with nearly as many)."""
    tracked = min(MOST_TRACKED, max(TRACKED, 8 * n // HOT_ROWS))
    part = lines.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("sketch"))
    states = part.agg(F.expr(f"approx_top_k_accumulate(h1, {tracked})").alias("state"))
    whole = states.groupBy(F.lit(1).alias("one")).agg(F.expr(f"approx_top_k_combine(state, {tracked})").alias("state"))
    top = whole.select(F.explode(F.expr(f"approx_top_k_estimate(state, {tracked})")).alias("top")).select("top.*")
    return top.where((F.col("count") * HOT_SHARE >= n) | (F.col("count") >= HOT_ROWS)).select(F.col("item").alias("h1"))


def _runs(words: Column) -> Column:
    """Sorted (word, bits) to the runs of set bits (first, n)."""
    inside = F.transform(words, lambda w: F.filter(
        F.sequence(w["word"] * 64, w["word"] * 64 + 63),
        lambda p: F.getbit(w["bits"], p - w["word"] * 64) == 1,
    ))

    def runs(at: Column) -> Column:
        first = F.filter(at, lambda p, i: F.coalesce(F.get(at, i - 1) != p - 1, F.lit(True)))
        last = F.filter(at, lambda p, i: F.coalesce(F.get(at, i + 1) != p + 1, F.lit(True)))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("n")))

    return let(F.flatten(inside), runs)


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
                 least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(id, row, drops) of every document that loses lines: its id, the hash of
    its text and the runs of dropped lines."""
    spark = df.sparkSession
    lines = written(line_hashes(df, id_col, text_col, least_chars), "lines")
    n = lines.count()
    hot = written(hot_keys(lines, n), "hot-keys")  # bounded, see above

    # hot keys: counts combined in tasks
    heavy = lines.join(F.broadcast(hot), "h1", "left_semi")
    facts = heavy.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("last"))
    facts = facts.where(F.col("docs") >= least_documents).drop("docs")
    gone = heavy.join(F.broadcast(facts), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("last")))

    # all others: ranges of hashes, the largest document of a key first
    light = lines.join(F.broadcast(hot), "h1", "left_anti")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // HOT_ROWS))
    down = F.desc_nulls_last("id")
    ranged = light.repartitionByRange(tasks, "h1", "h2").sortWithinPartitions("h1", "h2", down, "row", "pos")
    key = Window.partitionBy("h1", "h2")
    nth = ranged.withColumn("nth", F.dense_rank().over(key.orderBy(down))).withColumn("docs", F.max("nth").over(key))
    later = nth.where((F.col("nth") > 1) & (F.col("docs") >= least_documents))

    dropped = later.select("id", "row", "pos").unionByName(gone.select("id", "row", "pos"))
    word = F.floor(F.col("pos") / 64).cast("int").alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)
    words = dropped.groupBy("id", "row", word).agg(F.bit_or(bit).alias("bits"))
    maps = words.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return maps.select("id", "row", _runs(F.col("words")).alias("drops"))


def kept_lines(lines: Column, drops: Column) -> Column:
    """The lines outside the dropped runs."""
    def between(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(drops, i - 1)["first"] + F.get(drops, i - 1)["n"])
        end = F.coalesce(F.get(drops, i)["first"], F.size(lines))
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(drops)), between))


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  out: str = "lines") -> DataFrame:
    """``df`` with dropped lines taken out of the text, and a struct ``out``
    (n_lines before dropping, n_dropped, drops)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("doc_row", F.xxhash64("text"))
    both = docs.join(bitmaps, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("doc_row") == F.col("row")), "left")
    lines = F.split("text", "\n")
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(
        let(lines, lambda x: F.array_join(kept_lines(x, F.col("drops")), "\n")))
    n_dropped = F.coalesce(F.aggregate("drops", F.lit(0).cast("long"), lambda a, d: a + d["n"]), F.lit(0).cast("long"))
    facts = F.struct(F.size(lines).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), "drops")
    done = both.select("doc", kept.alias("kept"), facts.alias("facts"))
    keep = [F.col("kept").alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in df.columns if c != out]
    return done.select(*keep, F.col("facts").alias(out))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "lines",
                least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Both steps: the documents without the lines that recur in others."""
    return apply_bitmaps(df, keep_bitmaps(df, id_col, text_col, least_chars, least_documents), id_col, text_col, out)
