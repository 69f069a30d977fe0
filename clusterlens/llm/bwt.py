"""Burrows-Wheeler transform of a block of strings, and which of their
windows share a prefix of a given length.

``suffix_order`` sorts the suffixes of all strings (each ends in a separator of
its own, smaller than every byte, ordered by string) by prefix doubling on
packed 63-bit keys. ``common_prefixes`` derives the common prefixes of
neighbouring suffixes from the transform alone, by increasing value: it starts
with the interval of the empty string and extends all intervals of one length
by one byte to the left (a breadth-first step, vectorised over the intervals); the
row after an extended interval, if no shorter string has ended there, has the
present length as its common prefix, and only then is the interval kept. It stops at
``least``: rows left open share at least that many bytes with the row before.
"""

from __future__ import annotations

import numpy as np

MOST_ROWS = 1 << 21  # a row number and two ranks fill a 63-bit key


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, string of each symbol, bytes from each symbol to its string's
    end): the strings one after the other, a 0 after each, bytes numbered from 1."""
    sizes = ends - starts + 1
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(int(sizes.sum())) - first[of]
    left = sizes[of] - 1 - at
    used = np.zeros(256, bool)
    used[data] = True
    code = np.cumsum(used).astype(np.int64)
    inside = np.minimum(starts[of] + at, max(len(data) - 1, 0))
    symbols = np.where(left > 0, code[data[inside]] if len(data) else 0, 0)
    return symbols, of, left


def suffix_order(symbols: np.ndarray, of: np.ndarray, left: np.ndarray) -> np.ndarray:
    n = len(symbols)
    if n >= MOST_ROWS:
        raise ValueError("block too large")
    row = np.arange(n, dtype=np.int64)
    bits = max(int(symbols.max(initial=0)).bit_length(), 1)
    size = 42 // bits
    key = np.zeros(n, np.int64)
    for k in range(size):  # the first symbols; nothing lies behind a separator
        at = np.minimum(row + k, n - 1)
        key = key << bits | np.where(left >= k, symbols[at], 0)
    while True:
        packed = np.sort(key << 21 | row)
        order = packed & (1 << 21) - 1
        new = np.ones(n, bool)
        np.not_equal(packed[1:] >> 21, packed[:-1] >> 21, out=new[1:])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return order
        # equal suffixes that reached their separators are told apart by string
        then = np.where(left >= size, rank[np.minimum(row + size, n - 1)], of)
        key, size = rank << 21 | then, 2 * size


def common_prefixes(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each row of the order its common prefix with the row before, -1
    where that is ``least`` or more. (The first row has 0.)"""
    n = len(order)
    bwt = symbols[order - 1].astype(np.uint16)  # a string's first symbol follows a separator
    by_symbol = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int32)
    lf[by_symbol] = np.arange(n, dtype=np.int32)
    sorted_bwt = bwt[by_symbol]
    same = np.concatenate([sorted_bwt[1:] == sorted_bwt[:-1], [False]])
    after, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    after[by_symbol[:-1][same[:-1]]] = by_symbol[1:][same[:-1]]
    before[by_symbol[1:][same[:-1]]] = by_symbol[:-1][same[:-1]]
    strings = int((symbols == 0).sum())
    common = np.full(n + 1, -1, np.int32)
    common[:strings + 1] = 0  # every separator differs from every other symbol
    common[n] = 0
    lo, hi = np.array([0], np.int32), np.array([n - 1], np.int32)
    for length in range(least):
        sizes = hi - lo + 1
        rows = np.arange(sizes.sum(), dtype=np.int32) + np.repeat(lo - (np.cumsum(sizes, dtype=np.int32) - sizes), sizes)
        real = bwt[rows] > 0
        # per interval and byte: its first and its last row lead to the ends of the extended interval
        new_lo = np.sort(lf[rows[(before[rows] < np.repeat(lo, sizes)) & real]])
        new_hi = np.sort(lf[rows[(after[rows] > np.repeat(hi, sizes)) & real]])
        fresh = common[new_hi + 1] < 0
        common[new_hi[fresh] + 1] = length
        lo, hi = new_lo[fresh], new_hi[fresh]
        if length == 0:  # the separators, as strings of length one
            own = np.arange(strings, dtype=np.int32)
            lo, hi = np.concatenate([own, lo]), np.concatenate([own, hi])
        if not len(lo):
            break
    return common[:n]


def repeated_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, times: np.ndarray,
                     least: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset), in order, of every window of ``least`` bytes that the
    strings hold twice or more, a string counting ``times`` times."""
    symbols, of, left = joined(data, starts, ends)
    order = suffix_order(symbols, of, left)
    group = np.cumsum(common_prefixes(symbols, order, least) >= 0)
    whole = left[order] >= least
    held = np.bincount(group[whole], weights=np.minimum(times, 2)[of[order[whole]]], minlength=group[-1] + 1 if len(group) else 0)
    hit = np.sort(order[whole & (held[group] >= 2)])
    return of[hit], (ends - starts)[of[hit]] - left[hit]
