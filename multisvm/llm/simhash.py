"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within r bits have a value within r / 2 bits of both. Every
distinct fingerprint emits all variants within half the radius (2,081 of 64
bits for r = 4), the variants are shuffled by hash range, and fingerprints
that meet at a variant are linked once their distance has been verified.

The shuffle is in two passes, to keep it near two bytes a variant:
1. every batch of fingerprints sends all its variants' hashes, sorted and
   packed (``keyblobs``), and gets back those that are sent twice or more;
2. only these variants are emitted again, with their fingerprint. All
   fingerprints at one variant are linked to the least of them (a star, not
   all pairs: they are within r of each other through the variant), and each
   task sends on a spanning forest of what it saw.
Components of the links give the groups (``components``).

Exact copies have one fingerprint and are aggregated before anything else.

Defined cases: a null text counts as empty; a text without a word has
fingerprint zero and is linked like any other; fewer words than a shingle are
one shingle; repeated rows each get a result row; a null id is carried, and
never is a component's smallest id unless the whole component has null ids;
an empty table gives an empty result. A very long text needs memory for its
words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from multisvm.llm import keyblobs
from multisvm.llm.common import workers, written
from multisvm.llm.components import components, join_counted

SHINGLE = 4
MAX_BITS = 4
BATCH = 2048  # fingerprints whose variants one task holds at a time
BUCKET_KEYS = 1_500_000  # variants of one hash range, over all batches


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the shingles' XXH64 (seed 42), bit by bit."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    counts = np.zeros(64, np.int64)
    for low in range(0, len(first), 65536):
        part = [digest(joined[a:b], 42) for a, b in zip(first[low:low + 65536], last[low:low + 65536])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(first), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the 64-bit fingerprint as a signed long, one row a row."""
    workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fp long")


def flips(radius: int) -> np.ndarray:
    """Masks of every set of at most ``radius`` bits."""
    return np.array(
        [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)], np.uint64
    )


def _variants(fps: np.ndarray, masks: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of all variants, below 2^bits; (fingerprint, mask). They are
    mixed some rows at a time, in the array that is returned."""
    keys = np.empty((len(fps), len(masks)), np.uint64)
    step = max(1, keyblobs.SLICE // len(masks))
    for low in range(0, len(fps), step):
        part = keys[low:low + step]
        np.bitwise_xor(fps[low:low + step, None], masks[None, :], out=part)
        keyblobs.mix(part.reshape(-1))
    keys = keys.reshape(-1)
    keys >>= np.uint64(64 - bits)
    return keys


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, towards the least node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    for a, b in zip(u.tolist(), v.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root) if find(x) != x]


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v) of fingerprints (column fp, distinct) that are within ``max_bits``
    bits or joined by such steps: enough links for the components, none else."""
    workers(distinct.sparkSession)
    n = distinct.count()
    masks = flips((max_bits + 1) // 2)  # an odd radius is met with one more bit on both sides
    total = max(1, n * len(masks))
    bits = min(64, max(24, total.bit_length() + 8))  # one variant in 256 or fewer meets another by its hash alone
    batches, buckets = keyblobs.layout(total, BATCH * len(masks), BUCKET_KEYS)
    tight = max(1, buckets // 16)
    dealt = distinct.select("fp", F.pmod(F.xxhash64("fp"), F.lit(batches)).alias("batch"))
    dealt = dealt.repartition(2 * batches, "batch")  # a few bytes a row, but thousands of variants: no merging of tasks

    def emit(table: pa.Table) -> pa.Table:
        fps = np.sort(table.column("fp").to_numpy()).view(np.uint64)
        return keyblobs.blob_table(table.column("batch")[0].as_py(), _variants(fps, masks, bits), buckets, bits)

    meet = keyblobs.shared(dealt.groupBy("batch").applyInArrow(emit, keyblobs.BLOB_SCHEMA))

    def again(left: pa.Table, right: pa.Table) -> pa.Table:
        """The variants that meet another, with their fingerprint, by hash range."""
        wanted, got = keyblobs.keys_of(right), []
        fps = np.sort(left.column("fp").to_numpy()).view(np.uint64)
        for i in range(0, len(fps), BATCH // 4):
            part = fps[i:i + BATCH // 4]
            keys = _variants(part, masks, bits)
            hit = np.flatnonzero(keyblobs.member(wanted, keys))
            own = part[hit // len(masks)]
            got.append((own ^ masks[hit % len(masks)], own))
        z = np.concatenate([g[0] for g in got]) if got else np.empty(0, np.uint64)
        own = np.concatenate([g[1] for g in got]) if got else np.empty(0, np.uint64)
        at = keyblobs.mix(z.copy()) % np.uint64(tight)
        order = np.argsort(at, kind="stable")
        z, own, at = z[order], own[order], at[order]
        cut = np.searchsorted(at, np.arange(tight + 1, dtype=np.uint64))
        rows = [b for b in range(tight) if cut[b] < cut[b + 1]]
        return pa.table({
            "part": pa.array(rows, pa.int64()),
            "z": pa.array([z[cut[b]:cut[b + 1]].tobytes() for b in rows], pa.binary()),
            "own": pa.array([own[cut[b]:cut[b + 1]].tobytes() for b in rows], pa.binary()),
        })

    emitted = dealt.groupBy("batch").cogroup(meet.groupBy("batch")).applyInArrow(again, "part long, z binary, own binary")

    def verify(table: pa.Table) -> pa.Table:
        z = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("z").to_pylist()])
        own = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("own").to_pylist()])
        order = np.lexsort((own, z))
        z, own = z[order], own[order]
        head = np.concatenate([[True], z[1:] != z[:-1]])
        least = own[head][np.cumsum(head) - 1]
        near = (np.bitwise_count(least ^ own) <= max_bits) & (least != own)
        pairs = np.unique(np.stack([own[near], least[near]], axis=1), axis=0)
        found = _forest(pairs[:, 0], pairs[:, 1])
        return pa.table({c: pa.array(np.array([f[k] for f in found], np.uint64).view(np.int64)) for k, c in enumerate("uv")})

    return emitted.groupBy("part").applyInArrow(verify, "u long, v long")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component_id): one row an input row; the component is named by
    the smallest id that is reachable over links of at most ``max_bits`` bits."""
    prints = written(fingerprints(df, id_col, text_col, shingle), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    rooted = components(links(distinct.select("fp"), max_bits))
    named = distinct.join(rooted, distinct.fp == rooted.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of = join_counted(named, least, "root", distinct.count()).select("fp", "component_id")
    return prints.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
