"""Best-fit packing of token sequences by large-item matching.

1. Documents are tokenized where they are read and cut into pieces of at most
   ``capacity`` tokens; a piece's row holds its length and checksum (or ids).
2. How many pieces of each length there are is all the packing needs: at most
   ``capacity`` numbers. On them, pieces above a third of the capacity, of
   which at most two fit together, are matched greedily (the longest with the
   longest that fits), then the shorter ones, longest first, go where they
   leave the least gap. Equal bins are planned together, so the plan has a row
   for a run of equal placements, not for a piece.
3. A piece finds its place by its rank among the pieces of its length: a count
   per task and length gives each task its first rank.

The pieces are written to the shared checkpoint folder before they are
counted, so counts and ranks speak of the same rows even if an executor is lost.

Defined cases: null and empty texts are one piece that holds the end token
alone; repeated rows are packed as often as they occur; ties (equal lengths)
take any order; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from multisvm.llm.bpe import Codec, Words
from multisvm.llm.common import workers, written

CAPACITY = 4096
END_ID = 1


class LibraryCodec(Codec):
    """Pieces encoded by the tokenizers library's model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self._library = Tokenizer.from_file(path)
        self._model = self._library.model

    def _encode(self, symbols: str) -> list[int]:
        return [t.id for t in self._model.tokenize(symbols)]


@lru_cache(maxsize=2)
def _words(path: str) -> tuple[LibraryCodec, Words]:
    own = LibraryCodec(path)
    return own, Words(own.word)


def _pieces(path: str, text: str, capacity: int, end_id: int):
    """Byte strings of at most ``capacity`` uint32 ids, the end id last."""
    own, known = _words(path)
    held = b""
    for words in own.words(text):
        held += b"".join(map(known.__getitem__, words))
        while len(held) > 4 * capacity:
            yield held[: 4 * capacity]
            held = held[4 * capacity:]
    held += end_id.to_bytes(4, "little")
    for at in range(0, len(held), 4 * capacity):
        yield held[at:at + 4 * capacity]


def tokenized_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                     end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], part, rank): one row a
    piece; ``rank`` counts the pieces of its length before it in task ``part``."""
    workers(df.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        try:
            for b in batches:
                for low in range(0, b.num_rows, 512):
                    ids_of, rows = b.slice(low, 512), []
                    for k, text in enumerate(ids_of.column(1).to_pylist()):
                        start = 0
                        for n, raw in enumerate(_pieces(path, text or "", capacity, end_id)):
                            length = len(raw) // 4
                            rows.append((k, n, start, length, zlib.crc32(raw), raw if with_ids else None, int(seen[length])))
                            seen[length] += 1
                            start += length
                    cols = list(zip(*rows))
                    longs = [pa.array(c, pa.int64()) for c in (cols[2], cols[3], cols[4])]
                    ids = [pa.array([np.frombuffer(r, "<u4").astype(np.int32) for r in cols[5]], pa.list_(pa.int32()))] if with_ids else []
                    yield pa.RecordBatch.from_arrays(
                        [ids_of.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *longs, *ids,
                         pa.array([part] * len(rows), pa.int64()), pa.array(cols[6], pa.int64())],
                        names=["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "part", "rank"],
                    )
        finally:
            for tables in _words(path):
                tables.rest()

    of = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = of.schema["id"].dataType.simpleString()
    ids = "ids array<int>, " if with_ids else ""
    return of.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, {ids}part long, rank long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first rank, pieces, first sequence, pieces a
    sequence, offset) of ``counts[length]`` pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    placed: dict[int, int] = dict.fromkeys(left, 0)
    out, sequences = [], 0
    gaps: list[int] = []  # sorted gaps that some sequence has
    open_at: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, how many)

    def put(n: int, first: int, each: int, pieces: int, gap: int = capacity) -> None:
        out.append((n, placed[n], pieces, first, each, capacity - gap))
        placed[n] += pieces

    def leave(g: int, first: int, bins: int) -> None:
        if g > 0 and bins:
            if g not in open_at:
                insort(gaps, g)
                open_at[g] = []
            open_at[g].append((first, bins))

    # Large items: the longest is matched with the longest that fits beside it.
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect_right(large, capacity - n) - 1
        m = large[at] if at >= 0 else None
        if m == n:
            bins = left[n] // 2
            if not bins:
                at -= 1
                m = large[at] if at >= 0 else None
        if m is None:
            bins = left[n]
            put(n, sequences, 1, bins)
            leave(capacity - n, sequences, bins)
            left[n] = 0
        elif m == n:
            put(n, sequences, 2, 2 * bins)
            leave(capacity - 2 * n, sequences, bins)
            left[n] -= 2 * bins
        else:
            bins = min(left[n], left[m])
            put(n, sequences, 1, bins)
            put(m, sequences, 1, bins, capacity - n)
            leave(capacity - n - m, sequences, bins)
            left[n] -= bins
            left[m] -= bins
        sequences += bins
        large = [x for x in large if left[x]]

    # Small items, longest first, into the least gap that takes them.
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at == len(gaps):  # none: new sequences
                each = capacity // n
                bins = -(-left[n] // each)
                leave(capacity, sequences, bins)
                sequences += bins
                continue
            gap = gaps[at]
            first, bins = open_at[gap].pop()
            if not open_at[gap]:
                del open_at[gap], gaps[at]
            each = min(gap // n, left[n])
            full = min(bins, left[n] // each)
            put(n, first, each, full * each, gap)
            left[n] -= full * each
            leave(gap - each * n, first, full)
            leave(gap, first + full, bins - full)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``tokenized_pieces`` with sequence_id and offset. The plan grows
    with the capacity, not with the rows."""
    workers(pieces.sparkSession)
    known = written(pieces, "pieces")
    counts = known.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    totals = {r["length"]: r["n"] for r in known.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    steps = sorted(plan(totals, capacity))
    table = np.array(steps, np.int64).reshape(-1, 6)
    wide = np.int64(1) << np.int64(45)  # ranks of one length stay below
    order = table[:, 0] * wide + table[:, 1]

    def place(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            step = table[np.searchsorted(order, length * wide + rank, side="right") - 1]
            k = rank - step[:, 1]
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names) if n != "_rank"}
            cols["sequence_id"] = pa.array(step[:, 3] + k // step[:, 4])
            cols["offset"] = pa.array(step[:, 5] + k % step[:, 4] * length)
            yield pa.RecordBatch.from_pydict(cols)

    ranked = known.join(first, ["part", "length"]).withColumn("_rank", F.col("rank") + F.col("before"))
    ranked = ranked.select(*[c for c in pieces.columns if c not in ("part", "rank")], "_rank")
    fields = [f for f in ranked.schema.fields if f.name != "_rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    return pack(tokenized_pieces(df, path, id_col, text_col, capacity, end_id, with_ids), capacity).withColumnRenamed("id", id_col)
