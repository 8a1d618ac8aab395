"""Substring deduplication by recompression, exact at word windows.

A word goes if a window of ``window`` consecutive words that covers it starts
anywhere else too. Documents are dealt into batches by a hash; every batch

1. parses its texts by recompression (``recompress``) and sends the names of
   its symbols to hash ranges (``keyblobs``), which answer with those that
   occur twice or more anywhere;
2. sends the hashes of the windows that hold no unshared symbol (symbols that
   the window alone decides are the same wherever it occurs, so no repeated
   window is lost) and gets back the windows that do repeat: the check of the
   candidates, on whole windows;
3. marks the words that repeated windows cover.

The documents are shuffled once (the three steps read one exchange); names and
window hashes are 8 bytes or less each, at most two of a kind a batch, so large
groups of copies cost no more than their batches.

Names and window hashes have 64 bits: two different windows are taken for one
only if their hashes collide and all their symbols are shared.

Defined cases: a null text stays null and counts no words; texts without a
word give an empty text; texts shorter than a window are kept whole; repeated
rows repeat all their windows, so each loses them; the order of the input does
not matter; other columns pass through whatever their names; an empty table
gives an empty result. A text is parsed at once: one of 20 MB needs about 1 GB.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from multisvm.llm import keyblobs
from multisvm.llm.common import workers
from multisvm.llm.recompress import candidates, find_words, symbols, window_hashes, windows

WINDOW = 35
BATCH_CHARS = 6_000_000  # of text in one batch, on average
BUCKET_CHARS = 4_000_000  # of text for each hash range
KEY_CHARS = 4  # of text for each key sent, about
PART = 1_000_000  # bytes that are parsed at once


def _parts(texts: list[bytes]):
    """Words of the texts, some texts at a time: (their slice, Words)."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= PART):
            size += len(texts[to])
            to += 1
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts[at:to]])]).astype(np.int64)
        yield slice(at, to), find_words(np.frombuffer(b"".join(texts[at:to]), np.uint8), offsets)
        at = to


def _texts(table: pa.Table) -> list[bytes]:
    return [b or b"" for b in table.column("_text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     out: str = "removed") -> DataFrame:
    """The input with the text's kept words joined by one space, plus a struct
    ``out``: n_words, n_removed (long) and spans, the (start, length) in words
    of what was removed. (A column named like ``out`` is replaced.)"""
    spark = df.sparkSession
    workers(spark)
    size = df.agg(F.coalesce(F.sum(F.length(F.col(f"`{text_col}`").cast("string"))), F.lit(0))).first()[0]
    batches, buckets = keyblobs.layout(size // KEY_CHARS, BATCH_CHARS // KEY_CHARS, BUCKET_CHARS // KEY_CHARS)
    carried = [c for c in df.columns if c != out]
    slices = max(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.select(
        # by id and place: rows of one id, or of none, are dealt over the batches too
        F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.monotonically_increasing_id()), F.lit(batches)).alias("_batch"),
        F.col(f"`{text_col}`").cast("string").alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in carried if c != text_col], F.lit(0).alias("_none")).alias("_rest"),
    ).repartition(slices, "_batch")

    def parsed(texts):
        for _, words in _parts(texts):
            yield (words, *symbols(words))

    # names are cut to 44 bits on the wire: a chance agreement only adds a candidate
    drop = np.uint64(20)

    def short_names(table: pa.Table) -> pa.Table:
        keys = [keyblobs.twice(name >> drop) for _, name, _, _ in parsed(_texts(table))]
        return keyblobs.blob_table(table.column("_batch")[0].as_py(), np.concatenate(keys), buckets, 44)

    again = keyblobs.shared(dealt.groupBy("_batch").applyInArrow(short_names, keyblobs.BLOB_SCHEMA))

    def window_keys(left: pa.Table, right: pa.Table) -> pa.Table:
        known, keys = keyblobs.keys_of(right), [np.empty(0, np.uint64)]
        if not left.num_rows:
            return keyblobs.blob_table(0, keys[0], buckets, 64)
        for words, name, low, high in parsed(_texts(left)):
            found = keyblobs.member(known, name >> drop)
            starts = candidates(words, low, high, found, window)
            keys.append(keyblobs.twice(window_hashes(words.hash, starts, window)))
        return keyblobs.blob_table(left.column("_batch")[0].as_py(), np.concatenate(keys), buckets, 64)

    repeated = keyblobs.shared(
        dealt.groupBy("_batch").cogroup(again.groupBy("batch")).applyInArrow(window_keys, keyblobs.BLOB_SCHEMA)
    )

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    schema = T.StructType([
        T.StructField("_text", T.StringType()),
        dealt.schema["_rest"],
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(span)),
    ])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        known, texts = keyblobs.keys_of(right), _texts(left)
        kept: list[bytes] = []
        counts, gone, spans = [], [], []
        for part, words in _parts(texts):
            starts = windows(words, window)
            hit = starts[keyblobs.member(known, window_hashes(words.hash, starts, window))]
            cover = np.zeros(len(words.hash) + 1, np.int32)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + window, -1)
            out_of = np.cumsum(cover)[:-1] > 0
            for k, text in enumerate(texts[part]):
                a, b = words.first[k], words.first[k + 1]
                drop_of = out_of[a:b]
                n = int(drop_of.sum())
                own = text.split()
                kept.append(b" ".join(own if not n else compress(own, (~drop_of).tolist())))
                counts.append(int(b - a))
                gone.append(n)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], drop_of.astype(np.int8), [0]])))
                spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2])])
        null = left.column("_text").is_null().to_numpy()
        texts_out = pa.array([None if z else t.decode() for t, z in zip(kept, null)], pa.string())
        return pa.table({
            "_text": texts_out,
            "_rest": left.column("_rest"),
            "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(gone, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
        })

    done = dealt.groupBy("_batch").cogroup(repeated.groupBy("batch")).applyInArrow(cut, schema)
    return done.select(
        *[F.col("_text" if c == text_col else f"_rest.`{c}`").alias(c) for c in carried],
        F.struct("n_words", "n_removed", "spans").alias(out),
    )
