"""Which 64-bit keys occur twice or more, for key sets far larger than the rows.

Documents are dealt into batches; a batch's sorted keys are cut by hash range
into buckets, one packed binary row each. A bucket's task sees every batch's
keys of its range and answers each batch with the keys that are shared. A key
is counted at most twice a batch, so hot keys cost two entries a batch.

Batches and buckets grow in number with the keys as long as their product, the
packed rows, stays under a ``LEAST_KEYS``-th of the keys (``layout``). Beyond,
both grow in size instead, with the square root of the input: rows in proportion
to the keys, and a task's memory in proportion to their root.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOB_SCHEMA = "bucket long, batch long, keys binary"
LEAST_KEYS = 32  # keys of a packed row, on average and at least
SLICE = 1 << 17  # keys that are worked on at once, beside a batch's own
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # mixing multipliers


def layout(keys: int, batch_keys: int, bucket_keys: int) -> tuple[int, int]:
    """(batches, buckets) for so many keys, of the given sizes or larger."""
    batches, buckets = max(1, -(-keys // batch_keys)), max(1, -(-keys // bucket_keys))
    over = batches * buckets * LEAST_KEYS / max(1, keys)
    if over <= 1:
        return batches, buckets
    return max(1, math.ceil(batches / math.sqrt(over))), max(1, math.ceil(buckets / math.sqrt(over)))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64 values, so that key ranges are even; it
    works in place on the array given."""
    spare = x >> np.uint64(32)
    x ^= spare
    x *= ODD[0]
    np.right_shift(x, np.uint64(29), out=spare)
    x ^= spare
    x *= ODD[1]
    np.right_shift(x, np.uint64(32), out=spare)
    x ^= spare
    return x


def twice(keys: np.ndarray) -> np.ndarray:
    """The keys sorted (in place), each kept at most twice."""
    keys.sort()
    return _at_most_twice(keys)


def _at_most_twice(keys: np.ndarray) -> np.ndarray:
    """Sorted keys, each kept at most twice."""
    if len(keys) > 2:
        extra = keys[2:] == keys[:-2]
        if extra.any():
            keys = keys[np.concatenate([[True, True], ~extra])]
    return keys


def pack(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as their differences in 1, 2, 3, 4 or 8 bytes, as is
    shortest (wider gaps are written as whole steps)."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=np.uint64(0))
    first, gaps = int(gaps[0]), gaps.copy()
    gaps[0] = 0
    width = min((1, 2, 3, 4), key=lambda w: w * (len(gaps) + int((gaps // np.uint64((1 << (8 * w)) - 1)).sum())))
    top = (1 << (8 * width)) - 1
    if gaps.max() >= top:
        if width == 4:
            width, top = 8, None
        else:  # a gap g becomes g // top escapes of ``top`` and the rest
            steps = (gaps // np.uint64(top)).astype(np.int64)
            out = np.full(len(gaps) + int(steps.sum()), top, np.uint64)
            out[np.cumsum(steps + 1) - 1] = gaps % np.uint64(top)
            gaps = out
    raw = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + first.to_bytes(8, "little") + np.ascontiguousarray(raw).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    width, first = blob[0], int.from_bytes(blob[1:9], "little")
    raw = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    gaps = wide.view("<u8").ravel()
    keys = np.cumsum(gaps, dtype=np.uint64) + np.uint64(first)
    if width < 8 and len(gaps):
        keys = keys[gaps != np.uint64((1 << (8 * width)) - 1)]
    return keys


def bucket_numbers(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Bucket of each key below 2^bits: even ranges, by the top 32 bits."""
    high = keys >> np.uint64(bits - 32) if bits > 32 else keys
    return high * np.uint64(buckets) >> np.uint64(min(bits, 32))


def buckets_of(keys: np.ndarray, buckets: int, bits: int) -> list[tuple[int, np.ndarray]]:
    """Sorted keys below 2^bits cut into ranges; (bucket, its keys) of those that hold one."""
    if not len(keys):
        return []
    starts, numbers, last = [], [], None
    for low in range(0, len(keys), SLICE):
        number = bucket_numbers(keys[low:low + SLICE], buckets, bits)
        at = np.flatnonzero(np.concatenate([[last is None or number[0] != last], number[1:] != number[:-1]]))
        starts.append(low + at)
        numbers.append(number[at])
        last = number[-1]
    return [(int(b), part) for b, part in zip(np.concatenate(numbers), np.split(keys, np.concatenate(starts)[1:]))]


def blob_table(batch: int, keys: np.ndarray, buckets: int, bits: int) -> pa.Table:
    """A batch's rows for ``shared``: its keys, sorted (in place) and at most
    twice each. Equal keys are in one bucket, so that no second array of the
    batch's size is needed."""
    keys.sort()
    rows = buckets_of(keys, buckets, bits)
    return pa.table({
        "bucket": pa.array([b for b, _ in rows], pa.int64()),
        "batch": pa.array([batch] * len(rows), pa.int64()),
        "keys": pa.array([pack(_at_most_twice(k)) for _, k in rows], pa.binary()),
    })


def _answer(table: pa.Table) -> pa.Table:
    batches = table.column("batch").to_pylist()
    blobs = [unpack(b) for b in table.column("keys").to_pylist()]
    every = np.sort(np.concatenate(blobs))
    again = every[1:][every[1:] == every[:-1]]
    again = again[np.concatenate([[True], again[1:] != again[:-1]])] if len(again) else again
    del every
    out: list[tuple[int, bytes]] = []
    for batch, keys in zip(batches, blobs):
        if len(again):
            at = np.minimum(np.searchsorted(again, keys), len(again) - 1)
            mine = keys[again[at] == keys]
            if len(mine):
                mine = mine[np.concatenate([[True], mine[1:] != mine[:-1]])]
                out.append((batch, pack(mine)))
    bucket = table.column("bucket")[0].as_py()
    return pa.table({
        "bucket": pa.array([bucket] * len(out), pa.int64()),
        "batch": pa.array([b for b, _ in out], pa.int64()),
        "keys": pa.array([k for _, k in out], pa.binary()),
    })


def shared(blobs: DataFrame) -> DataFrame:
    """(bucket, batch, keys): the keys of each batch that occur twice or more
    over all batches (or in the batch itself)."""
    return blobs.groupBy(F.col("bucket")).applyInArrow(_answer, BLOB_SCHEMA)


def keys_of(table: pa.Table) -> np.ndarray:
    """All keys of answered rows, sorted."""
    parts = [unpack(b) for b in table.column("keys").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Boolean mask of ``keys`` that are in ``sorted_keys``; a bitmap of low
    bits passes over most of the others."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    size = 1 << min(24, max(10, int(len(sorted_keys)).bit_length() + 3))
    low = np.uint64(size - 1)
    seen = np.zeros(size, bool)
    seen[(sorted_keys & low).astype(np.int64)] = True
    out = seen[(keys & low).astype(np.int64)]
    at = np.flatnonzero(out)
    near = np.minimum(np.searchsorted(sorted_keys, keys[at]), len(sorted_keys) - 1)
    out[at] = sorted_keys[near] == keys[at]
    return out
