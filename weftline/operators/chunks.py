"""Whole-text work by distinct chunks: a text is cut before spaces, and each chunk is worked on once by a worker.

A cut lies before a space that follows a printable ASCII sign or a letter or
digit.  Where no normalizer step and no pretokenizer stage looks across such a
place (``cuts_at_spaces``), the chunks' results in a row are the text's.  A
worker keeps the results by a 64-bit hash of the chunk, in a table of fixed size
where a later chunk takes the place of an earlier one, and all else is numpy on
the batch's flat arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ..functions.buffers import U64, mix, slices, span_hashes
from ..functions.pretokenize import KNOWN, NAMED, stages

#: Places for chunks in a worker's table; it forgets all beyond so many results of them, or bytes of results that are texts.
PLACES, KEEP_RESULTS, KEEP_BYTES = 1 << 19, 1 << 22, 1 << 25
#: Bytes of text that are cut together: as many new chunks as can be are encoded at once.
TOGETHER = 1 << 20
#: Kinds of chunks that a worker keeps at once.
KINDS = 3

#: Steps that work on each side of a cut alone.
_LOCAL_STEPS = {"clean", "lowercase", "strip_accents", "drop_marks", "nfc", "nfd", "nfkc", "nfkd", "space_cjk", "prepend", "metaspace"}
#: Stages for which every cut is the border of two pieces.
_BORDERS = {NAMED[n][0] for n in ("gpt2", "cl100k", "o200k", "voyage", "qwen", "bert", "whitespace_split", "whitespace", "units")} | {NAMED["deepseek"][-1], ("▁[^▁]*|[^▁]+", "matches")} | {(p, b) for p in KNOWN for b in ("isolated", "matches")}
#: Stages that only split what they match from what lies between.
_LOCAL_STAGES = {NAMED[n][0] for n in ("digits", "digit_runs", "punctuation")} | set(NAMED["deepseek"][:-1])


def local_steps(steps: tuple[tuple, ...]) -> bool:
    return all(s[0] in _LOCAL_STEPS or (s[0] == "replace" and len(s[1]) == 1) or s[:2] == ("replace_regex", r"\s+") for s in steps)


def cuts_at_spaces(steps: tuple[tuple, ...], pretokenizer) -> bool:
    """Whether a text may be normalized and split in chunks."""
    own = stages(pretokenizer)
    return local_steps(steps) and any(s in _BORDERS for s in own) and all(s in _BORDERS or s in _LOCAL_STAGES for s in own)


def later(steps: tuple[tuple, ...]) -> tuple[tuple, ...]:
    """The steps for a chunk that isn't the text's first: nothing is put before it."""
    return tuple(("metaspace", "never") if s[0] == "metaspace" else s for s in steps if s[0] != "prepend")


@lru_cache(maxsize=1)
def _solid() -> np.ndarray:
    """Whether a cut may follow a character of two or three bytes: letters and digits below U+3000, but for two that begin or make something else."""
    out = np.zeros(0x3000, bool)
    out[0x80:] = [chr(c).isalnum() for c in range(0x80, 0x3000)]
    out[[0x037A, 0x0D4E]] = False
    return out


#: Stages for which letters, with or without a space before them, are one piece, and for which a piece ends where letters do.
_OF_LETTERS = {NAMED[n][0] for n in ("gpt2", "cl100k", "voyage", "qwen")} | {(p, b) for p in KNOWN if "?[" in p or r"?\p{L}" in p for b in ("isolated", "matches")}


def of_letters(steps: tuple[tuple, ...], pretokenizer) -> bool:
    """Whether a run of letters with at most a space before it is one piece, as it is."""
    own = stages(pretokenizer)
    return not steps and len(own) == 1 and own[0] in _OF_LETTERS


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a character of one or two bytes is a letter."""
    import regex

    is_letter = regex.compile(r"\p{L}").match
    return np.array([bool(is_letter(chr(c))) for c in range(0x800)])


@lru_cache(maxsize=1)
def _marks() -> np.ndarray:
    """The signs before which a piece of letters ends, whatever follows."""
    out = np.zeros(256, bool)
    out[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
    return out


def letter_bytes(buf: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a letter of one or two bytes; what continues a longer character may be told to, its first byte never."""
    table = np.zeros(256, bool)
    table[:128] = _letters()[:128]
    table[0x80:0xC0] = True
    out = table[buf]
    lead = np.flatnonzero((buf >= 0xC2) & (buf < 0xE0))
    out[lead] = _letters()[((buf[lead].astype(np.int64) & 0x1F) << 6) | (buf[np.minimum(lead + 1, len(buf) - 1)] & 0x3F)]
    return out


def cut_places(buf: np.ndarray, off: np.ndarray, letters: np.ndarray | None = None) -> np.ndarray:
    """Starts of the chunks of texts; with ``letter_bytes`` also before signs after ASCII letters."""
    at = np.flatnonzero(buf == 32)
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    at = at[~edge[at]]
    before = buf[at - 1]
    ok = (before > 32) & (before < 127)
    wide = np.flatnonzero(before >= 0x80)
    if len(wide):
        p = at[wide]
        one, two = buf[np.maximum(p - 2, 0)].astype(np.uint32), buf[np.maximum(p - 3, 0)].astype(np.uint32)
        last = buf[p - 1].astype(np.uint32) & 0x3F
        cp = np.where((one >= 0xC2) & (one < 0xE0), ((one & 0x1F) << 6) | last, np.where((two >= 0xE0) & (two < 0xF0) & (one >= 0x80) & (one < 0xC0), ((two & 0x0F) << 12) | ((one & 0x3F) << 6) | last, 0))
        ok[wide] = (cp < 0x3000) & _solid()[np.minimum(cp, 0x2FFF)]
    edge[at[ok]] = True
    if letters is not None:
        edge[1:-1] |= letters[:-1] & (buf[:-1] < 0x80) & _marks()[buf[1:]]
    edge[-1] = False
    return np.flatnonzero(edge)


class Chunks:
    """Results of chunks: (values, sizes), or None, by ``work(text, first, whole)``.

    ``first`` tells that the chunk begins a text; ``whole`` that it is a text of those
    that ``entire`` names by their bytes, which aren't cut.
    ``many`` may do for lists of chunks at once what ``work`` does: (values, sizes, number of them for each chunk, -1 for None).
    ``spans`` may do so for chunks of letters alone (``of_letters``), given as spans of bytes; then texts are cut at signs too.
    """

    def __init__(self, work: Callable[[str, bool, bool], tuple[Sequence[int], Sequence[int]] | None], entire: Callable[[bytes], bool] | None = None, many: Callable | None = None, spans: Callable | None = None):
        self.work, self.entire, self.many, self.spans = work, entire, many or self._one_by_one, spans
        self.hash = np.zeros(PLACES, np.uint64)
        self.first, self.count = np.zeros(PLACES, np.int32), np.zeros(PLACES, np.int32)
        self.values, self.sizes = np.empty(1 << 12, np.int32), np.empty(1 << 12, np.int32)
        self.forget()

    def forget(self) -> None:
        self.count[:] = -2  # an empty place; -1: None
        self.used = 0

    def full(self) -> bool:
        return self.used > KEEP_RESULTS

    def _one_by_one(self, texts: list[str], leads: list[bool], whole: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values: list[int] = []
        sizes: list[int] = []
        count = []
        for text, first, w in zip(texts, leads, whole):
            got = self.work(text, first, w)
            if got is None:
                count.append(-1)
                continue
            values += got[0]
            sizes += got[1]
            count.append(len(got[0]))
        return np.array(values, np.int32), np.array(sizes, np.int32), np.array(count, np.int64)

    def _append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        need = self.used + len(values)
        if need > len(self.values):
            grown = max(need, 2 * len(self.values))
            for name in ("values", "sizes"):
                wider = np.empty(grown, np.int32)
                wider[: self.used] = getattr(self, name)[: self.used]
                setattr(self, name, wider)
        self.values[self.used : need], self.sizes[self.used : need] = values, sizes
        self.used = need

    def _learn(self, start: np.ndarray, end: np.ndarray, leads: np.ndarray, whole: np.ndarray, buf: np.ndarray, letters: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(first result, number of results) of chunks."""
        first, count, rest = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.arange(len(start))

        def put(own: np.ndarray, got: tuple) -> None:
            values, sizes, count[own] = got
            n = np.maximum(count[own], 0)
            first[own] = self.used + np.cumsum(n) - n
            self._append(values, sizes)

        if letters is not None:
            other = np.append(0, np.cumsum(~letters))
            begin = start + (buf[start] == 32)
            easy = (begin < end) & (other[end] == other[np.minimum(begin, end)])
            own, rest = np.flatnonzero(easy), np.flatnonzero(~easy)
            if len(own):
                put(own, self.spans(buf, start[own], end[own]))
        if len(rest):
            raw = buf.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(start[rest].tolist(), end[rest].tolist())]
            put(rest, self.many(texts, leads[rest].tolist(), whole[rest].tolist()))
        return first, count

    def entries(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first result, number of results, or -1) of each chunk, and the chunks of each text as bounds."""
        letters = letter_bytes(buf) if self.spans else None
        start = cut_places(buf, off, letters)
        leads = np.zeros(len(buf) + 1, bool)
        leads[off] = True
        whole = np.zeros(len(start), bool)
        if self.entire:
            raw = buf.tobytes()
            some = [k for k in range(len(off) - 1) if off[k + 1] > off[k] and self.entire(raw[off[k] : off[k + 1]])]
            if some:
                row = np.searchsorted(off, start, "right") - 1
                own = np.isin(row, some)
                keep = ~own | leads[start]
                start, whole = start[keep], own[keep]
        first = leads[start]
        end = np.append(start[1:], len(buf))
        with np.errstate(over="ignore"):
            h = mix(span_hashes(buf, start, end) + first.astype(np.uint64) * U64(0x632BE59BD9B4E019) + whole.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        if self.full():
            self.forget()
        place = (h & U64(len(self.hash) - 1)).astype(np.int64)
        begin, count = self.first[place].astype(np.int64), self.count[place].astype(np.int64)
        new = np.flatnonzero((self.hash[place] != h) | (count == -2))
        if len(new):
            one, at, back = np.unique(h[new], return_index=True, return_inverse=True)
            at = new[at]
            b, n = self._learn(start[at], end[at], first[at], whole[at], buf, letters)
            begin[new], count[new] = b[back], n[back]
            own = place[at]
            self.hash[own] = one
            # of chunks that share a place one stays: what is written to the three arrays must be of the same
            last = np.flatnonzero(self.hash[own] == one)
            self.first[own[last]], self.count[own[last]] = b[last], n[last]
        return begin, count, np.searchsorted(start, off)

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of results of each text, whether it has a chunk without)."""
        out, bad = np.zeros(len(column), np.int64), np.zeros(len(column), bool)
        for a, b, buf, off in slices(column, TOGETHER):
            if len(buf):
                _, n, at = self.entries(buf, off)
                out[a:b] = np.diff(np.append(0, np.cumsum(np.maximum(n, 0)))[at])
                bad[a:b] = np.diff(np.append(0, np.cumsum(n < 0))[at]) > 0
        return out, bad

    @staticmethod
    def _picks(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the places of all results in a row, the number of them up to each chunk)."""
        ends = np.cumsum(n)
        return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0), ends

    def lists(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(values, sizes, bounds of each text's, texts that have a chunk without)."""
        values, sizes, size, bad = [], [], np.zeros(len(column), np.int64), np.zeros(len(column), bool)
        for a, b, buf, off in slices(column, TOGETHER):
            if len(buf):
                first, n, at = self.entries(buf, off)
                bad[a:b] = np.diff(np.append(0, np.cumsum(n < 0))[at]) > 0
                pick, ends = self._picks(first, np.maximum(n, 0))
                values.append(self.values[pick])
                sizes.append(self.sizes[pick])
                size[a:b] = np.diff(np.append(0, ends)[at])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
        return join(values), join(sizes), np.append(0, np.cumsum(size)), bad


class Texts(Chunks):
    """Chunks whose results are texts, kept as places in one buffer of bytes."""

    def __init__(self, work: Callable[[str, bool, bool], Iterable[str]]):
        def many(texts: list[str], leads: list[bool], whole: list[bool]):
            found = [list(work(t, first, w)) for t, first, w in zip(texts, leads, whole)]
            parts = [x.encode() for f in found for x in f]
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            at = self.filled + np.cumsum(size) - size
            need = self.filled + int(size.sum())
            if need > len(self.bytes):
                wider = np.empty(max(need, 2 * len(self.bytes)), np.uint8)
                wider[: self.filled] = self.bytes[: self.filled]
                self.bytes = wider
            self.bytes[self.filled : need] = np.frombuffer(b"".join(parts), np.uint8)
            self.filled = need
            return at, size, np.fromiter(map(len, found), np.int64, len(found))

        self.bytes = np.empty(1 << 16, np.uint8)
        super().__init__(work, None, many)

    def forget(self) -> None:
        super().forget()
        self.filled = 0

    def full(self) -> bool:
        return super().full() or self.filled > KEEP_BYTES

    def texts(self, column: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
        """(results of all texts, in parts; bounds of each text's)."""
        parts, size = [], np.zeros(len(column), np.int64)
        for a, b, buf, off in slices(column, TOGETHER):
            if len(buf):
                first, n, at = self.entries(buf, off)
                pick, ends = self._picks(first, n)
                where, stop = self._picks(self.values[pick].astype(np.int64), self.sizes[pick].astype(np.int64))
                bounds = pa.py_buffer(np.append(0, stop).astype(np.int32))
                parts.append(pa.StringArray.from_buffers(len(pick), bounds, pa.py_buffer(self.bytes[where])))
                size[a:b] = np.diff(np.append(0, ends)[at])
        return parts, np.append(0, np.cumsum(size))


_kept: dict[object, Chunks] = {}


def kept(key: object, make: Callable[[], Chunks]) -> Chunks:
    """This worker's chunks of a kind."""
    if key not in _kept:
        if len(_kept) >= KINDS:
            _kept.clear()
        _kept[key] = make()
    return _kept[key]
