"""Words, lines and shingles of Arrow string columns as NumPy arrays.

A *block* is a run of rows whose texts lie next to each other in the Arrow
buffer; words and lines are (start, end, row) spans of its bytes, and a span's
identity is a 64-bit hash of its bytes. Everything is vectorised over a block
of at most ``BLOCK_BYTES`` bytes (or one longer text), so memory stays bounded
however many rows an Arrow batch holds. Null texts are empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
_PIECE = 2 << 20
_U = np.uint64

# The white space the word and line contracts name.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
IS_WHITE = np.zeros(256, dtype=bool)
IS_WHITE[list(WHITE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z only
LOWER_BYTES = LOWER.tobytes()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser (splitmix64) of unsigned integers, seeded."""
    with np.errstate(over="ignore"):
        z = x.astype(_U) + _U((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


class Block:
    """Rows ``first .. first+n`` of a batch: their bytes and row bounds."""

    __slots__ = ("data", "starts", "ends", "first")

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int):
        self.data, self.starts, self.ends, self.first = data, starts, ends, first

    def __len__(self) -> int:
        return len(self.starts)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column, in row order, covering every row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = offs[:-1].copy(), offs[1:].copy()
    if column.null_count:
        gone = np.asarray(column.is_null())
        ends[gone] = starts[gone]
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        lo, hi = int(offs[at]), int(offs[to])
        yield Block(data[lo:hi], starts[at:to] - lo, ends[at:to] - lo, at)
        at = to


def words(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word ``[^\\x20\\x09-\\x0D]+``."""
    white = IS_WHITE[b.data]
    ink = ~white
    first = ink.copy()
    first[1:] &= white[:-1]
    last = ink.copy()
    last[:-1] &= white[1:]
    # rows touch each other in the buffer: a row's bounds also bound words
    s = b.starts[b.starts < b.ends]
    e = b.ends[b.starts < b.ends] - 1
    first[s] = ink[s]
    last[e] = ink[e]
    ws, we = np.flatnonzero(first), np.flatnonzero(last) + 1
    return ws, we, row_of(b, ws)


def lines(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every line of every text split at \\n; an empty
    text is one empty line."""
    cut = np.flatnonzero(b.data == 10)
    row = row_of(b, cut)
    starts = np.concatenate([b.starts, cut + 1])
    ends = np.concatenate([b.ends, cut])
    rows = np.arange(len(b))
    s_rows, e_rows = np.concatenate([rows, row]), np.concatenate([rows, row])
    s_at, e_at = np.lexsort((starts, s_rows)), np.lexsort((ends, e_rows))
    return starts[s_at], ends[e_at], s_rows[s_at]


def row_of(b: Block, at: np.ndarray) -> np.ndarray:
    """Row of each byte position (positions lie inside non-empty rows)."""
    return np.searchsorted(b.ends, at, "right") if len(b) > 1 else np.zeros(len(at), np.int64)


class SpanHash:
    """64-bit hash of byte spans: a polynomial in a random odd base over random
    byte values, from one prefix sum per piece, then a finaliser. ``lower``
    hashes A-Z as a-z. Equal bytes give equal hashes wherever they stand."""

    def __init__(self, seed: int, lower: bool = False):
        self.seed = seed
        value = mix(np.arange(1, 257), 101 + seed)
        self.value = value[LOWER] if lower else value
        self.lower = lower
        self.base = int(mix(np.array([7]), 977 + seed)[0]) | 1
        self.power = self.inverse = np.zeros(0, _U)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                one = np.ones(1, _U)
                self.power = np.cumprod(np.concatenate([one, np.full(n - 1, self.base, _U)]))
                back = pow(self.base, -1, 1 << 64)
                self.inverse = np.cumprod(np.concatenate([one, np.full(n - 1, back, _U)]))

    def __call__(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Hashes of the spans; starts must ascend, ends too."""
        out = np.empty(len(s), _U)
        at = 0
        while at < len(s):
            lo = int(s[at])
            to = int(np.searchsorted(e, lo + _PIECE, "right"))
            if to <= at:  # one span longer than a piece
                raw = data[lo:int(e[at])].tobytes()
                raw = raw.translate(LOWER_BYTES) if self.lower else raw
                out[at] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=b"%d" % self.seed).digest(), "big")
                at += 1
                continue
            hi = int(e[at:to].max())
            self._grow(hi - lo + 1)
            with np.errstate(over="ignore"):
                sums = np.zeros(hi - lo + 1, _U)
                np.cumsum(self.value[data[lo:hi]] * self.power[:hi - lo], out=sums[1:])
                a, z = s[at:to] - lo, e[at:to] - lo
                out[at:to] = mix((sums[z] - sums[a]) * self.inverse[a], self.seed)
            at = to
        return out


def windows(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first position) of every run of ``k`` words inside one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        acc = np.zeros(n, _U)
        for j in range(k):
            acc = (acc ^ hashes[j:j + n]) * _U(0xD6E8FEB86659FD93)
            acc ^= acc >> _U(32)
    at = np.flatnonzero(rows[:n] == rows[k - 1:k - 1 + n])
    return mix(acc[at], k), at


def shingle_sets(b: Block, hasher: SpanHash, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every row's distinct ``k``-word shingles, ordered by row
    and hash; a text of fewer words gives its whole word sequence as one
    shingle, a text without words gives none."""
    ws, we, rows = words(b)
    h = hasher(b.data, ws, we)
    wh, at = windows(h, rows, k)
    wr = rows[at]
    count = np.bincount(rows, minlength=len(b)) if len(rows) else np.zeros(len(b), np.int64)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.searchsorted(rows, few)
        with np.errstate(over="ignore"):
            acc = mix(count[few].astype(_U), 31)
            for j in range(k - 1):
                has = count[few] > j
                nxt = h[np.minimum(first + j, len(h) - 1)]
                step = (acc ^ nxt) * _U(0xD6E8FEB86659FD93)
                acc = np.where(has, step ^ (step >> _U(32)), acc)
        wh, wr = np.concatenate([wh, mix(acc, k)]), np.concatenate([wr, few])
    order = np.lexsort((wh, wr))
    wh, wr = wh[order], wr[order]
    keep = np.ones(len(wh), bool)
    keep[1:] = (wh[1:] != wh[:-1]) | (wr[1:] != wr[:-1])
    return wh[keep], wr[keep]


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count (or sum of weights) for each row 0 .. n-1."""
    if weights is None:
        return np.bincount(rows, minlength=n).astype(np.int64)
    return np.bincount(rows, weights=weights, minlength=n).astype(np.int64)


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each row's part in an array ordered by row (n + 1 values)."""
    return np.searchsorted(rows, np.arange(n + 1))
