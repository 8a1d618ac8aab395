"""Recompression of word sequences with bounded context, on numpy arrays.

Rounds rename neighbouring symbols: the first names runs of one word, every
round names pairs of a left and a right symbol (a symbol's side is a bit of
its hash, anew each round). Names are 64-bit hashes of what they stand for, so
they are global: equal substrings get equal symbols in every document and
task, but near their ends, where a neighbour outside has a say. Symbols grow
to at most ``LONGEST`` words.

For every symbol the words that decided it are tracked (``low`` .. ``high``).
Wherever those words occur again, the symbol does too; that makes the symbols
of a window that are decided by the window alone an exact filter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from multisvm.llm.keyblobs import mix

LONGEST = 12
ROUNDS = 6

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, out=out)


def window_hashes(values: np.ndarray, starts: np.ndarray, lengths) -> np.ndarray:
    """64-bit polynomial hashes (odd base, modulo 2^64, then mixed) of the runs
    ``values[start:start + length]``, all at once by prefix sums."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, len(values)), out=total[1:])
    return mix((total[starts + lengths] - total[starts]) * _powers(_BASE_INVERSE, len(values) + 1)[starts])


@dataclass
class Words:
    """Words of a batch of texts: byte ranges in ``data``, hash, text number."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text: its first word; one more entry at the end


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]`` (UTF-8 bytes)."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    del begins, ends, cut, inside
    text = np.searchsorted(offsets, start, side="right") - 1
    hashes = window_hashes(data.astype(np.uint64) + np.uint64(1), start, end - start)
    first = np.searchsorted(text, np.arange(len(offsets)))
    return Words(data, start, end, text, hashes, first)


def _deal(symbol: np.ndarray, salt: int) -> np.ndarray:
    return mix(symbol + np.uint64((salt * 2 + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))


def _named(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix(_deal(a, salt) * np.uint64(0xA0761D6478BD642F) + b)


def symbols(words: Words, longest: int = LONGEST, rounds: int = ROUNDS):
    """(symbol, low, high): names of the final symbols and the range of words
    that decided each; a range that leaves its text leaves every window."""
    n = len(words.hash)
    sym, start = words.hash.copy(), np.arange(n)
    text = words.text
    low, high = start.copy(), start + 1
    if n == 0:
        return sym, low, high
    left_edge, right_edge = words.first[:-1], words.first[1:]  # of the texts

    def neighbours(text_of):
        same = text_of[1:] == text_of[:-1]
        return np.concatenate([[False], same]), np.concatenate([same, [False]])

    def beyond(text_of, low, high):
        """low of each left neighbour and high of each right one; past the
        text's edge where there is none."""
        has_left, has_right = neighbours(text_of)
        return (
            np.where(has_left, np.roll(low, 1), left_edge[text_of] - 1),
            np.where(has_right, np.roll(high, -1), right_edge[text_of] + 1),
        )

    # Runs of a word: named as one symbol up to the longest, else left as words.
    _, has_right = neighbours(text)
    same_next = has_right & np.concatenate([sym[1:] == sym[:-1], [False]])
    head = np.concatenate([[True], ~same_next[:-1]])
    at = np.flatnonzero(head)
    length = np.diff(np.append(at, n))
    out_low, out_high = beyond(text[at], at, at + length)
    whole = length <= longest
    run_name = np.where(length > 1, _named(sym[at], length.astype(np.uint64), 0), sym[at])
    run_of = np.cumsum(head) - 1
    keep = head | ~whole[run_of]  # every word of a long run stays
    pos, run = np.flatnonzero(keep), run_of[keep]
    in_short = whole[run]
    sym = np.where(in_short, run_name[run], sym[pos])
    # a run's name depends on the words next to it; a long run's word on enough of the run
    low = np.where(in_short, out_low[run], np.maximum(at[run] - 1, pos - longest))
    high = np.where(in_short, out_high[run], np.minimum(at[run] + length[run] + 1, pos + longest + 1))
    size = np.where(in_short, length[run], 1)
    text = text[pos]

    for salt in range(1, rounds + 1):
        has_left, has_right = neighbours(text)
        right = (_deal(sym, salt) & np.uint64(1)).astype(bool)
        next_size = np.append(size[1:], 0)
        pair = has_right & ~right & np.append(right[1:], False) & (size + next_size <= longest)
        second = np.concatenate([[False], pair[:-1]])
        # symbols that stay: a left one looked at its right neighbour, a right one at its left
        near_low, near_high = beyond(text, low, high)
        low_next = np.where(has_right, np.append(low[1:], 0), low)
        high_prev = np.where(has_left, np.concatenate([[0], high[:-1]]), high)
        stays = ~pair & ~second & (size < longest)
        new_low = np.where(stays & right, np.minimum(low, near_low), np.where(stays, np.minimum(low, low_next), low))
        new_high = np.where(stays & ~right, np.maximum(high, near_high), np.where(stays, np.maximum(high, high_prev), high))
        # a pair depends on what its two symbols depend on
        new_low = np.where(pair, np.minimum(low, np.append(low[1:], 0)), new_low)
        new_high = np.where(pair, np.maximum(high, np.append(high[1:], 0)), new_high)
        sym = np.where(pair, _named(sym, np.append(sym[1:], np.uint64(0)), salt), sym)
        size = np.where(pair, size + next_size, size)
        keep = ~second
        sym, low, high, size, text = sym[keep], new_low[keep], new_high[keep], size[keep], text[keep]
    return sym, low, high


def windows(words: Words, length: int) -> np.ndarray:
    """First words of all windows of ``length`` words inside one text."""
    n = len(words.hash)
    starts = np.arange(max(0, n - length + 1))
    return starts[words.text[starts] == words.text[starts + length - 1]] if len(starts) else starts


def candidates(words: Words, low, high, found, length: int) -> np.ndarray:
    """Windows that may occur again: those that hold no symbol, decided inside
    them, that is not ``found`` (shared)."""
    starts = windows(words, length)
    if not len(starts):
        return starts
    lost = np.flatnonzero(~found & (high - low <= length))
    mark = np.zeros(len(words.hash) + 2, np.int32)
    a, b = np.maximum(high[lost] - length, 0), np.minimum(low[lost], len(words.hash) - 1)
    ok = b >= a
    np.add.at(mark, a[ok], 1)
    np.add.at(mark, b[ok] + 1, -1)
    return starts[np.cumsum(mark)[starts] == 0]
