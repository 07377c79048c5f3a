"""Byte-level merges of many pieces at once, in numpy: the same ids as ``cores.bpe``."""

from __future__ import annotations

import numpy as np

from ..spec import ModelSpec
from .cores import SHORT, bpe

_FAR = np.int64(1) << 60
#: Pieces are worked on beside those of about their length.
_LENGTHS = (1, 4, 8, 12, 16, 24, 32, SHORT)


def serves(spec: ModelSpec) -> bool:
    return spec.encoder == "bpe" and not (spec.word_end or spec.fuse_unk)


def single_ids(spec: ModelSpec) -> np.ndarray:
    """The id of each byte; the unknown id or -1 for a byte without a token."""
    out = np.full(256, -1 if spec.unk_id is None else spec.unk_id, np.int32)
    for i, t in reversed(spec.vocab):
        if len(t) == 1:
            out[t[0]] = i
    return out


class Merges:
    """(ids, sizes, number of ids of each piece, -1 if it can't be encoded) of pieces."""

    def __init__(self, spec: ModelSpec):
        self.alone, self.single, self.none = bpe(spec), single_ids(spec), spec.unk_id is None
        self.whole = {t: i for i, t in reversed(spec.vocab)} if spec.ignore_merges else {}
        rules = np.array(spec.merges, np.int64).reshape(-1, 3)
        key, rank = np.unique((rules[:, 0] << 32) | rules[:, 1], return_index=True)  # the first rule for a pair counts
        self.shift = np.uint64(64 - max(8, (4 * len(key)).bit_length()))
        slot = self._slots(key)
        order = np.argsort(slot, kind="stable")
        self.key, self.rank = np.append(key[order], -1), np.append(rank[order], _FAR >> 6)
        places = np.arange((1 << (64 - int(self.shift))) + 1)
        bounds = np.searchsorted(slot[order], places)
        self.count = np.diff(bounds).astype(np.int32)  # of the rules in each slot
        self.head = np.where(self.count > 0, bounds[:-1], len(key)).astype(np.int32)
        self.merged = rules[:, 2].astype(np.int32)
        pair = self.single.astype(np.int64)
        self.bytes = self._ranks(np.repeat(pair, 256), np.tile(pair, 256)) if len(rules) else None

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's rule; a negative id has none."""
        key = np.bitwise_or(left.astype(np.int64) << 32, right)
        slot = self._slots(key)
        at = self.head[slot]
        same = self.key[at] == key
        out = np.where(same & (key >= 0), self.rank[at], _FAR >> 6)
        more, step = np.flatnonzero(~same & (self.count[slot] > 1)), 1
        while len(more):
            here = at[more] + step
            same = self.key[here] == key[more]
            out[more[same]] = self.rank[here[same]]
            step += 1
            more = more[~same & (self.count[slot[more]] > step)]
        return out

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.flat(np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces)))

    def spans(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of pieces that are spans of bytes."""
        size = end - start
        ends = np.cumsum(size)
        return self.flat(buf[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size)

    def flat(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of pieces that lie in a row."""
        start = np.cumsum(size) - size
        ids = self.single[raw]
        if self.bytes is None:
            sizes, count = np.ones(len(raw), np.int32), size.copy()
        else:
            sizes, count = self._merge(raw, ids, start, size)
        if self.none and len(raw) and (self.single[raw] < 0).any():
            bad = np.bincount(np.repeat(np.arange(len(size)), size)[self.single[raw] < 0], minlength=len(size)) > 0
            count[bad], sizes = -1, np.where(np.repeat(bad, size), 0, sizes)
        for k, (a, n) in enumerate(zip(start.tolist(), size.tolist())) if self.whole else ():
            i = self.whole.get(raw[a : a + n].tobytes())
            if i is not None and n:
                sizes[a : a + n], count[k] = 0, 1
                sizes[a], ids[a] = n, i
        own = sizes > 0
        return ids[own], sizes[own], count

    def _merge(self, raw, ids, start, size) -> tuple[np.ndarray, np.ndarray]:
        """Writes each id where its bytes begin; (its number of bytes, else 0, for each byte; ids of each piece)."""
        sizes, count = np.ones(len(raw), np.int32), size.copy()
        for low, high in zip(_LENGTHS, _LENGTHS[1:]):
            own = np.flatnonzero((size > low) & (size <= high))
            if len(own):
                self._round(raw, ids, sizes, count, start[own], size[own], own)
        for k in np.flatnonzero(size > SHORT).tolist():
            got = self.alone(raw[start[k] : start[k] + size[k]].tobytes())
            if got is None:
                continue
            length = np.fromiter((n for _, n in got), np.int32, len(got))
            at = start[k] + np.cumsum(length) - length
            sizes[start[k] : start[k] + size[k]] = 0
            sizes[at], ids[at], count[k] = length, np.fromiter((i for i, _ in got), np.int32, len(got)), len(got)
        return sizes, count

    def _round(self, raw, all_ids, all_sizes, all_count, start, size, own) -> None:
        n, length = len(own), int(size.max())
        row = np.arange(length)[:, None]
        there = row < size
        place = np.minimum(start + row, len(raw) - 1)
        byte = raw[place].astype(np.int64)
        ids = np.where(there, self.single[byte], -1)
        score = np.full((length, n), _FAR, np.int64)
        score[:-1] = np.where(there[1:], (self.bytes[byte[:-1] * 256 + byte[1:]] << 6) | row[:-1], _FAR)
        after, before = np.broadcast_to(row + 1, (length, n)).copy(), np.broadcast_to(row - 1, (length, n)).copy()
        far, col = (_FAR >> 6) << 6, np.arange(n)
        while True:
            best = score[:, col].min(axis=0)
            live = best < far
            col, best = col[live], best[live]
            if not len(col):
                break
            k = best & 63
            j = after[k, col]
            new = self.merged[best >> 6]
            ids[k, col], ids[j, col], score[j, col], score[k, col] = new, -1, _FAR, _FAR
            nxt = after[j, col]
            after[k, col] = nxt
            f = np.flatnonzero(nxt < size[col])
            before[nxt[f], col[f]] = k[f]
            p = before[k, col]
            g = np.flatnonzero(p >= 0)
            left, here = np.append(k[f], p[g]), np.append(col[f], col[g])
            score[left, here] = (self._ranks(ids[left, here], ids[np.append(nxt[f], k[g]), here]) << 6) | left
        kept = ids >= 0  # a byte without a token makes its whole piece null, if it isn't unknown
        all_count[own] = kept.sum(axis=0)
        where = place[there]
        all_ids[where] = ids[there]
        all_sizes[where] = np.where(kept, np.minimum(after, size) - row, 0)[there]


def in_order(spec: ModelSpec) -> bool:
    """Whether each rule comes after those that make what it joins, so that merging rule by rule is exact."""
    made: dict[int, int] = {}
    for rank, (_, _, m) in enumerate(spec.merges):
        made[m] = rank
    return all(made.get(x, -1) < rank for rank, (a, b, _) in enumerate(spec.merges) for x in (a, b))


def merged_flat(ids: np.ndarray, off: np.ndarray, spec: ModelSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sizes, bounds) of texts of any length by few rules that are in order: one after the other, over all texts."""
    starts = np.zeros(len(ids) + 1, bool)
    starts[off] = True
    starts, sizes, seen = starts[:-1], np.ones(len(ids), np.int32), set()
    for a, b, m in spec.merges:
        if (a, b) in seen:
            continue
        seen.add((a, b))
        at = np.flatnonzero((ids[:-1] == a) & (ids[1:] == b) & ~starts[1:])
        if a == b and len(at):  # of a run, every second from the left
            run = np.append(0, np.cumsum(np.diff(at) > 1))
            at = at[(at - at[np.searchsorted(run, run)]) % 2 == 0]
        if len(at):
            ids[at] = m
            sizes[at] += sizes[at + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, sizes, starts = ids[keep], sizes[keep], starts[keep]
    return ids, sizes, np.searchsorted(np.append(0, np.cumsum(sizes)), off)
