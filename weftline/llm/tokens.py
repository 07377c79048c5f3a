"""Whole-text tokenization with a byte-level BPE vocabulary, by distinct chunks.

A text is cut where a character that isn't ASCII white space is followed by
one that is.  No alternative of the pretokenizer's pattern spans such a place,
so the chunks' ids in a row are the text's ids; a text with other white space
(where that doesn't hold) is encoded whole.  Each worker keeps the ids of the
chunks seen, by a 64-bit hash that includes the length, and encodes new ones.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

from .text import buffers, span_hashes, spans_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_LETTER, _NUMBER = r"\p{L}", r"\p{N}"
PATTERN = "|".join((r"'(?:[sdmt]|ll|ve|re)", f" ?{_LETTER}++", f" ?{_NUMBER}++", rf" ?[^\s{_LETTER}{_NUMBER}]++", r"\s++$", r"\s+(?!\S)", r"\s"))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A worker forgets its chunks beyond so many.
KEEP = 1 << 20


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokenizer:
    def __init__(self, path: str = VOCABULARY):
        self.encoding = encoding(path)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, buf: np.ndarray) -> None:
        raw = buf.tobytes()
        encode = self.encoding.encode_ordinary
        got = [encode(raw[a:b].decode()) for a, b in zip(start.tolist(), end.tolist())]
        count = np.array([len(x) for x in got], np.int32)
        ids = np.fromiter((i for x in got for i in x), np.int32, int(count.sum()))
        first = len(self.ids) + np.cumsum(count, dtype=np.int64) - count
        where = np.searchsorted(self.known, h)
        self.known = np.insert(self.known, where, h)
        self.first = np.insert(self.first, where, first)
        self.count = np.insert(self.count, where, count)
        self.ids = np.append(self.ids, ids)

    def entries(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of the cache for each chunk, chunks of each text as bounds)."""
        turn = np.zeros(len(buf), bool)
        space = _SPACE[buf]
        turn[1:] = space[1:] & ~space[:-1]
        turn[off[:-1][np.diff(off) > 0]] = True
        other = np.flatnonzero((buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3))
        if len(other):
            odd = {i for i in np.unique(np.searchsorted(off, other, "right") - 1) if any(c.isspace() and c > "\x7f" for c in buf[off[i] : off[i + 1]].tobytes().decode())}
            for i in odd:
                turn[off[i] + 1 : off[i + 1]] = False
        start = np.flatnonzero(turn)
        end = np.append(start[1:], len(buf))
        h = span_hashes(buf, start, end)
        one, at, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > KEEP:
            self.forget()
        k = np.searchsorted(self.known, one)
        new = np.flatnonzero(~((k < len(self.known)) & (self.known[np.minimum(k, len(self.known) - 1)] == one)) if len(self.known) else np.ones(len(one), bool))
        if len(new):
            self._learn(one[new], start[at[new]], end[at[new]], buf)
            k = np.searchsorted(self.known, one)
        return k[back], np.searchsorted(start, off)

    def counts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        if not len(buf):
            return np.zeros(len(off) - 1, np.int64)
        k, at = self.entries(buf, off)
        return np.diff(np.append(0, np.cumsum(self.count[k], dtype=np.int64))[at])

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's)."""
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        k, at = self.entries(buf, off)
        n = self.count[k].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.first[k] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.append(0, ends)[at]


_ready: dict[str, Tokenizer] = {}


def tokenizer(path: str = VOCABULARY) -> Tokenizer:
    """This worker's tokenizer."""
    if path not in _ready:
        _ready[path] = Tokenizer(path)
    return _ready[path]
