"""Vectorised text kernels shared by the corpus operators.

Everything works on Arrow string batches, through numpy, with no per-row
Python: a batch is one UTF-8 buffer plus offsets.

Words are maximal runs of letters, digits and ``_``.  They are compared
case-insensitively: ASCII letters and every one-to-one lower-case mapping that
keeps the length in UTF-8.  Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that a kernel looks at together; a longer text goes alone, whole.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``size`` bytes; no text is cut."""
    buf, off = buffers(column)
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(1 << 16, dtype=np.uint32)
    wordy = np.zeros(1 << 16, bool)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        wordy[c] = x.isalnum() or x == "_"
        y = x.lower()
        if len(y) == 1 and len(y.encode()) == len(x.encode()):
            lower[c] = ord(y)
    ascii_lower = np.arange(256, dtype=np.uint8)
    ascii_lower[:128] = lower[:128]
    is_word = np.ones(256, bool)
    is_word[:128] = wordy[:128]
    return lower, wordy, ascii_lower, is_word


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        with np.errstate(over="ignore"):
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _powers.append(np.multiply.accumulate(p))
        del _powers[:-2]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def fold(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, and whether each byte belongs to a word character."""
    lower, wordy, ascii_lower, is_word = _tables()
    low = ascii_lower[buf]
    inside = is_word[buf]
    for at, size in ((np.flatnonzero((buf >= 0xC2) & (buf < 0xE0)), 2), (np.flatnonzero((buf >= 0xE0) & (buf < 0xF0)), 3)):
        at = at[at + size <= len(buf)]
        if not len(at):
            continue
        if size == 2:
            cp = ((buf[at].astype(np.uint32) & 0x1F) << 6) | (buf[at + 1] & 0x3F)
        else:
            cp = ((buf[at].astype(np.uint32) & 0x0F) << 12) | ((buf[at + 1].astype(np.uint32) & 0x3F) << 6) | (buf[at + 2] & 0x3F)
        to = lower[cp]
        if (to != cp).any():
            if size == 2:
                low[at], low[at + 1] = 0xC0 | (to >> 6), 0x80 | (to & 0x3F)
            else:
                low[at], low[at + 1], low[at + 2] = 0xE0 | (to >> 12), 0x80 | ((to >> 6) & 0x3F), 0x80 | (to & 0x3F)
        out = at[~wordy[cp]]
        for k in range(size):
            inside[out + k] = False
    return low, inside


def spans_of(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of maximal True runs that don't cross the texts' borders."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by prefix sums of a polynomial."""
    pw, inv = powers(len(low) + 1)
    total = np.empty(len(low) + 1, np.uint64)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((low.astype(np.uint64) + U64(1)) * pw[: len(low)], out=total[1:])
        return mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))


class Words:
    """Words of a run of texts: hash, byte span, and for text i the words ``at[i]:at[i+1]``."""

    __slots__ = ("at", "end", "hash", "start")

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        if len(buf):
            low, inside = fold(buf)
            self.start, self.end = spans_of(inside, off)
            self.hash = span_hashes(low, self.start, self.end)
        else:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
        self.at = np.searchsorted(self.start, off)


def grams(h: np.ndarray, at: np.ndarray, n: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, bounds by text) of the word n-grams in each text, with repeats.

    A text of fewer than ``n`` words, but some, has one gram of all its words
    if ``whole_if_short``, else none.
    """
    count = np.diff(at)
    full = np.maximum(count - n + 1, 0)
    with np.errstate(over="ignore"):
        m = max(len(h) - n + 1, 0)
        g = h[:m].copy()
        for j in range(1, n):
            g *= U64(_BASE)
            g += h[j : j + m]
    ok = np.zeros(len(h) + 1, np.int32)
    some = full > 0
    np.add.at(ok, at[:-1][some], 1)
    np.add.at(ok, (at[:-1] + full)[some], -1)
    first = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    g = g[first]
    with np.errstate(over="ignore"):
        g = mix(g)
    short = np.flatnonzero((full == 0) & (count > 0)) if whole_if_short else np.zeros(0, np.int64)
    if len(short):
        extra = np.empty(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for k, d in enumerate(short):
                x = U64(int(count[d]))
                for w in h[at[d] : at[d + 1]]:
                    x = x * U64(_BASE) + w
                extra[k] = x
            extra = mix(extra)
        where = np.searchsorted(first, at[short])
        g, first = np.insert(g, where, extra), np.insert(first, where, at[short])
        full = full.copy()
        full[short] = 1
    bounds = np.zeros(len(at), np.int64)
    np.cumsum(full, out=bounds[1:])
    return g, first, bounds


def reduce_by(op: np.ufunc, x: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """``op`` over each run ``bounds[i]:bounds[i+1]``; ``empty`` where a run has nothing."""
    out = np.full(len(bounds) - 1, empty, x.dtype)
    some = bounds[1:] > bounds[:-1]
    if some.any():
        out[some] = op.reduceat(x, bounds[:-1][some])
    return out


def char_offsets(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte offsets into one text as character offsets."""
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    return lead[at]
