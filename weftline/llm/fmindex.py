"""FM-index over the words of a shard of texts, in numpy.

The shard is one sequence of symbols: each text's words, then a separator.  Its
suffixes are sorted whole (packed prefixes, then prefix doubling on what is
tied), the Burrows-Wheeler transform is kept as a wavelet matrix with rank
counts, and every ``sample``-th position of the text is kept for locating.
"""

from __future__ import annotations

import numpy as np

END, SEPARATOR, OTHER, FIRST = 0, 1, 2, 3


def suffix_array(s: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes of ``s``, whose last symbol is unique and least."""
    n = len(s)
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(width):
        key <<= bits
        key[: max(n - j, 0)] |= s[j:]
    sa = np.argsort(key)
    sorted_key = key[sa]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = head
    last = np.append(new[1:], True)
    tied = np.flatnonzero(~(new & last))
    h = width
    while len(tied):
        at = sa[tied]
        group = head[tied]
        after = rank[np.minimum(at + h, n - 1)]
        both = group * n + after
        order = np.argsort(both)
        at, both = at[order], both[order]
        sa[tied] = at
        new = np.ones(len(tied), bool)
        new[1:] = both[1:] != both[:-1]
        moved = np.maximum.accumulate(np.where(new, tied, 0))
        head[tied] = moved
        rank[at] = moved
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


class WaveletMatrix:
    """Rank of symbols in a sequence."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.n, self.levels = len(seq), levels
        self.words, self.ones, self.zeros = [], [], []
        pad = -(-(self.n + 1) // 64) * 64
        for level in range(levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            packed = np.zeros(pad // 8, np.uint8)
            packed[: -(-self.n // 8)] = np.packbits(bit, bitorder="little")
            packed = packed.view(np.uint64)
            count = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=count[1:])
            self.words.append(packed)
            self.ones.append(count)
            left = seq[~bit]
            self.zeros.append(len(left))
            seq = np.concatenate([left, seq[bit]])

    def _rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level][block] + np.bitwise_count(self.words[level][block] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        low, high = np.zeros_like(i), i
        for k in range(self.levels):
            bit = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self._rank1(k, low), self._rank1(k, high)
            low = np.where(bit, self.zeros[k] + a, low - a)
            high = np.where(bit, self.zeros[k] + b, high - b)
        return high - low

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before that."""
        symbol, low, at = np.zeros_like(i), np.zeros_like(i), i
        for k in range(self.levels):
            bit = (self.words[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            bit = bit.astype(bool)
            a, b = self._rank1(k, low), self._rank1(k, at)
            low = np.where(bit, self.zeros[k] + a, low - a)
            at = np.where(bit, self.zeros[k] + b, at - b)
            symbol = (symbol << 1) | bit
        return symbol, at - low


class FMIndex:
    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        """``symbols`` are at least SEPARATOR and below ``sigma``; an END is added."""
        s = np.append(symbols, END).astype(np.int64)
        bits = max(2, int(sigma - 1).bit_length())
        sa = suffix_array(s, bits)
        self.n, self.sample = len(s), sample
        self.less = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(s, minlength=sigma)[:sigma], out=self.less[1:])
        self.wavelet = WaveletMatrix(s[sa - 1].astype(np.uint32), bits)
        marked = sa % sample == 0
        self.marked = marked
        self.before = np.zeros(self.n + 1, np.int64)
        np.cumsum(marked, out=self.before[1:])
        self.samples = sa[marked]

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range [lo, hi) of each phrase; phrases are rows of symbols, at the right end of the row."""
        width = phrases.shape[1]
        c = phrases[:, width - 1].astype(np.int64)
        lo, hi = self.less[c].copy(), self.less[c + 1].copy()
        for step in range(1, width):
            live = np.flatnonzero((hi > lo) & (lengths > step))
            if not len(live):
                break
            c = phrases[live, width - 1 - step].astype(np.int64)
            r = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.less[c] + r[: len(live)], self.less[c] + r[len(live) :]
        return lo, hi

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, text position) of all occurrences, by stepping back to a sampled position."""
        count = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(lo)), count)
        i = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        at = np.full(len(i), -1, np.int64)
        open_, steps = np.arange(len(i)), 0
        while len(open_):
            done = self.marked[i[open_]]
            now = open_[done]
            at[now] = self.samples[self.before[i[now]]] + steps
            open_ = open_[~done]
            symbol, r = self.wavelet.access_rank(i[open_])
            i[open_] = self.less[symbol] + r
            steps += 1
        return which, at
