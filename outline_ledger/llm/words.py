"""Vectorised words of whole texts: hashes of all words of an Arrow batch in NumPy.

Words are the maximal runs of bytes other than space and \\x09-\\x0D of the UTF-8
text; A-Z count as a-z.  A word's hash is a 64-bit mix of two independent
polynomial sums of its bytes, so it depends on the word alone, on any executor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 array (wraps around)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0x9E3779B97F4A7C15)
    x ^= x >> U(32)
    return x


# with ``plain`` words, ASCII punctuation separates words as white space does
_SEP = _WS.copy()
_SEP[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


def _table(seed: int) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=U) * U(2 * seed + 1) + U(seed))
    t[65:91] = t[97:123]
    t[_WS] = 0
    return t


_T1, _T2 = _table(0x51ED2701), _table(0x2545F491)
_BASE1, _BASE2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
_POW: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_POW[0]) < n:
        for i, base in enumerate((_BASE1, _BASE2)):
            p = _POW[i]
            _POW[i] = np.concatenate([p, p * (p[-1:] * base)])
    return _POW[0], _POW[1]


def text_slices(column, slice_bytes: int = SLICE_BYTES):
    """Yield (first row, last row + 1, bytes, row starts) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + slice_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], (offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def word_spans(buf: np.ndarray, rows: np.ndarray, plain: bool = False):
    """(bytes in words, bytes that start one, their places, words before each row)."""
    live = ~(_SEP if plain else _WS)[buf]
    begin = live.copy()
    begin[1:] &= ~live[:-1]
    first = rows[:-1]
    first = first[first < len(buf)]
    begin[first] = live[first]
    starts = np.flatnonzero(begin)
    return live, begin, starts, np.searchsorted(starts, rows)


def word_hashes(buf: np.ndarray, rows: np.ndarray, prefixes: tuple[int, ...] = (), plain: bool = False):
    """Hashes of all words of the rows in ``buf`` and the index of each row's first word.

    With ``prefixes``, also the hash of each word's first p bytes, one array for each p
    (0 where the word is not longer than p bytes).
    """
    live, begin, starts, at = word_spans(buf, rows, plain)
    if not len(starts):
        z = np.zeros(0, U)
        return (z, at, *[z for _ in prefixes])
    s0 = int(starts[0])
    word = np.cumsum(begin[s0:]) - 1
    pos = np.arange(len(buf) - s0) - (starts - s0)[word]
    longest = int(np.diff(np.append(starts, len(buf))).max())
    p1, p2 = _powers(longest + 1)
    b = buf[s0:]
    v1, v2 = _T1[b] * p1[pos], _T2[b] * p2[pos]
    if plain:
        v1, v2 = v1 * live[s0:], v2 * live[s0:]
    cut = starts - s0
    out = mix(np.add.reduceat(v1, cut) ^ mix(np.add.reduceat(v2, cut)))
    more = []
    if prefixes:
        size = np.add.reduceat(live[s0:].astype(np.int32), cut)
        for p in prefixes:
            m = (pos < p)
            h = mix(np.add.reduceat(v1 * m, cut) ^ mix(np.add.reduceat(v2 * m, cut)) ^ U(p * 0x1F3D5B79))
            h[size <= p] = 0
            more.append(h)
    return (out, at, *more)
