"""Numpy kernels over Arrow string buffers: byte folding, word and window hashes, sub-batches.

Nothing here imports Spark. Every function works on the concatenated UTF-8 bytes of a batch, so the
cost per document is a few array operations whatever its length. Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18  # bytes of text that the temporaries of one step cover
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
MAX64 = U64(0xFFFFFFFFFFFFFFFF)


def _fold_table() -> np.ndarray:
    """ASCII letters in lower case, digits and bytes from 0x80 as they are, all else a blank."""
    t = np.full(256, 32, np.uint8)
    t[0x80:] = np.arange(0x80, 0x100)
    for a, b in ((48, 58), (97, 123)):
        t[a:b] = np.arange(a, b)
    t[65:91] = np.arange(97, 123)
    return t


def _space_table() -> np.ndarray:
    """All bytes as they are, but white space and control characters a blank."""
    t = np.arange(256, dtype=np.uint8)
    t[:33] = 32
    return t


FOLD, SPACE = _fold_table(), _space_table()


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: U64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def inverse(base: U64) -> U64:
    """The inverse of an odd number modulo 2**64."""
    return U64(pow(int(base), -1, 1 << 64))


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i is bytes[offsets[i]:offsets[i+1]]; no copy unless there are nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def doc_runs(offs: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Consecutive row ranges of at most limit bytes each, or of one row."""
    out, i, n = [], 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        out.append((i, min(j, n)))
        i = out[-1][1]
    return out


def fold_case(x: np.ndarray) -> np.ndarray:
    """FOLD, and the capital letters of U+00C0..U+00DE to small ones; the length stays."""
    y = FOLD[x]
    if len(x) > 1:
        up = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)
        y[1:][up] += 0x20
    return y


class Words:
    """Words of a batch: hash, byte range, and at[i]:at[i+1] are the words of row i."""

    __slots__ = ("h", "start", "end", "at")

    def __init__(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray):
        self.h, self.start, self.end, self.at = h, start, end, at


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if SEGMENT not in _POW:
        _POW[SEGMENT] = powers(BASE, SEGMENT + 1), powers(inverse(BASE), SEGMENT + 1)
    return _POW[SEGMENT]


def _segments(sep: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of at most SEGMENT bytes that begin where a word may begin. A word that fills a whole
    segment is cut SEGMENT bytes after its own start, so equal words are cut alike everywhere."""
    out, s, n = [], 0, len(sep)
    while s < n:
        e = min(s + SEGMENT, n)
        if e < n:
            k = int(np.searchsorted(cuts, e, "right")) - 1
            by_row = int(cuts[k]) if k >= 0 and cuts[k] > s else s
            tail = np.flatnonzero(sep[max(s, by_row) : e])
            last = max(by_row, max(s, by_row) + int(tail[-1]) + 1 if len(tail) else s)
            e = last if last > s else e
        out.append((s, e))
        s = e
    return out


def words(data: np.ndarray, offs: np.ndarray, fold: bool) -> Words:
    """Words between blanks (fold: letters in lower case and all punctuation is blank)."""
    n_rows = len(offs) - 1
    if not len(data):
        return Words(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n_rows + 1, np.int64))
    x = fold_case(data) if fold else SPACE[data]
    sep = x == 32
    pow_, inv = _tables()
    first = np.zeros(len(x) + 1, bool)  # a row begins here
    first[offs] = True
    hs, ss, es = [], [], []
    for s, e in _segments(sep, np.unique(offs)):
        blank = sep[s:e]
        edge = first[s:e]
        left = ~blank
        left[1:] &= blank[:-1] | edge[1:]
        right = ~blank
        right[:-1] &= blank[1:] | edge[1:]
        a = np.flatnonzero(left)
        b = np.flatnonzero(right) + 1
        v = x[s:e].astype(U64)
        v += U64(1)
        v *= pow_[: e - s]
        c = np.empty(e - s + 1, U64)
        c[0] = 0
        np.cumsum(v, out=c[1:])
        h = c[b] - c[a]
        h *= inv[a]
        hs.append(mix(h))
        ss.append(a + s)
        es.append(b + s)
    start = np.concatenate(ss)
    return Words(np.concatenate(hs), start, np.concatenate(es), np.searchsorted(start, offs))


def windows(h: np.ndarray, k: int, base: U64) -> np.ndarray:
    """Hash of h[i:i+k] for every i up to len(h)-k."""
    n = len(h)
    if n < k:
        return np.zeros(0, U64)
    p, q = powers(base, n), powers(inverse(base), n)
    c = np.empty(n + 1, U64)
    c[0] = 0
    np.cumsum(h * p, out=c[1:])
    out = c[k:] - c[: n - k + 1]
    out *= q[: n - k + 1]
    return mix(out)


def slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over x[i:i+w], for every i up to len(x)-w."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def row_of(at: np.ndarray) -> np.ndarray:
    """The row of each element, from the rows' bounds."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def char_index(data: np.ndarray) -> np.ndarray:
    """Number of characters that begin before each byte position (length + 1 values)."""
    out = np.empty(len(data) + 1, np.int64)
    out[0] = 0
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
