"""The encoders: a piece (bytes) as (id, number of bytes) pairs.  Pure Python, without Spark.

Workers call them for distinct pieces only, so what counts is that they are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

from ..spec import ModelSpec

Ids = list[tuple[int, int]]
MARK = "▁".encode()


def _byte_ids(spec: ModelSpec) -> dict[int, int]:
    """Ids of the tokens that stand for a byte: those of one byte, else those spelled ``<0xNN>``."""
    out = {}
    for i, t in spec.vocab:
        if len(t) == 6 and t[:3] == b"<0x" and t[5:] == b">":
            out[int(t[3:5], 16)] = i
    for i, t in spec.vocab:
        if len(t) == 1:
            out[t[0]] = i
    return out


#: Pieces of at most so many symbols are merged by a scan for the least rank in each round, longer ones with a heap.
SHORT = 48
_NONE = (1 << 60, 0)


def _merge_short(symbols: list[tuple[int, int]], rules: dict[tuple[int, int], tuple[int, int]]) -> Ids:
    ids, size = map(list, zip(*symbols))
    get = rules.get
    found = [get(p, _NONE) for p in zip(ids, ids[1:])]
    while found:
        best = min(found)
        if best is _NONE:
            break
        k = found.index(best)
        ids[k] = best[1]
        size[k] += size[k + 1]
        del ids[k + 1], size[k + 1], found[k]
        if k:
            found[k - 1] = get((ids[k - 1], ids[k]), _NONE)
        if k < len(found):
            found[k] = get((ids[k], ids[k + 1]), _NONE)
    return list(zip(ids, size))


def _merge(symbols: list[tuple[int, int]], rules: dict[tuple[int, int], tuple[int, int]]) -> Ids:
    """Joins neighbours by the rule of the least rank, the leftmost on ties, until none applies."""
    n = len(symbols)
    if n < 2 or not rules:
        return symbols
    if n <= SHORT:
        return _merge_short(symbols, rules)
    ids, size = [s[0] for s in symbols], [s[1] for s in symbols]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rule[0], k, ids[k], ids[k + 1]) for k in range(n - 1) if (rule := rules.get((ids[k], ids[k + 1])))]
    heapq.heapify(heap)
    while heap:
        rank, k, left, right = heapq.heappop(heap)
        j = after[k] if ids[k] == left else n
        if j >= n or ids[j] != right:
            continue
        ids[k], size[k], ids[j] = rules[left, right][1], size[k] + size[j], -1
        after[k] = after[j]
        if after[k] < n:
            before[after[k]] = k
            if rule := rules.get((ids[k], ids[after[k]])):
                heapq.heappush(heap, (rule[0], k, ids[k], ids[after[k]]))
        if before[k] >= 0 and (rule := rules.get((ids[before[k]], ids[k]))):
            heapq.heappush(heap, (rule[0], before[k], ids[before[k]], ids[k]))
    return [(i, s) for i, s in zip(ids, size) if i >= 0]


def _rules(spec: ModelSpec) -> dict[tuple[int, int], tuple[int, int]]:
    rules: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, (a, b, m) in enumerate(spec.merges):
        rules.setdefault((a, b), (rank, m))  # the first rule for a pair counts
    return rules


def _fused(ids: Ids, unk: int | None) -> Ids:
    out: Ids = []
    for i, s in ids:
        if out and i == unk and out[-1][0] == unk:
            out[-1] = (i, out[-1][1] + s)
        else:
            out.append((i, s))
    return out


def bpe(spec: ModelSpec) -> Callable[[bytes], Ids | None]:
    """Byte-level merges; a byte without a token is the unknown id, or makes the piece null if there is none."""
    rules, whole = _rules(spec), {t: i for i, t in reversed(spec.vocab)}
    single, end = {t[0]: i for i, t in reversed(spec.vocab) if len(t) == 1}, spec.word_end.encode()
    last = {t[0]: i for i, t in spec.vocab if end and len(t) == 1 + len(end) and t.endswith(end)}

    def run(piece: bytes) -> Ids | None:
        if spec.ignore_merges and piece + end in whole:
            return [(whole[piece + end], len(piece))]
        symbols = [(single.get(b, spec.unk_id), 1) for b in piece]
        if end and piece:
            symbols[-1] = (last.get(piece[-1], spec.unk_id), 1)
        if spec.unk_id is None and any(i is None for i, _ in symbols):
            return None
        out = _merge(symbols, rules)
        return _fused(out, spec.unk_id) if spec.fuse_unk else out

    return run


def sp_bpe(spec: ModelSpec) -> Callable[[bytes], Ids | None]:
    """Merges over characters; one without a token goes to its bytes' tokens, or is unknown."""
    rules, whole, byte = _rules(spec), {t: i for i, t in reversed(spec.vocab)}, _byte_ids(spec)

    def run(piece: bytes) -> Ids | None:
        if spec.ignore_merges and piece in whole:
            return [(whole[piece], len(piece))]
        symbols: Ids = []
        for c in piece.decode(errors="surrogateescape"):
            raw = c.encode(errors="surrogateescape")
            if raw in whole:
                symbols.append((whole[raw], len(raw)))
            elif spec.byte_fallback and all(b in byte for b in raw):
                symbols += [(byte[b], 1) for b in raw]
            elif spec.unk_id is None:
                return None
            else:
                symbols.append((spec.unk_id, len(raw)))
        out = _merge(symbols, rules)
        return _fused(out, spec.unk_id) if spec.fuse_unk else out

    return run


def wordpiece(spec: ModelSpec) -> Callable[[bytes], Ids | None]:
    """The longest token each time; a word that doesn't come out whole is one unknown."""
    prefix = spec.continuing_prefix.encode()
    first, later = {}, {}
    for i, t in reversed(spec.vocab):
        first[t] = i
        if t.startswith(prefix):
            later[t[len(prefix) :]] = i
    longest = max((len(t) for t in first), default=0)

    def run(piece: bytes) -> Ids | None:
        unknown = None if spec.unk_id is None else [(spec.unk_id, len(piece))]
        if len(piece.decode(errors="replace")) > spec.max_chars:
            return unknown
        out: Ids = []
        at = 0
        while at < len(piece):
            table = later if at else first
            for stop in range(min(len(piece), at + longest), at, -1):
                i = table.get(piece[at:stop])
                if i is not None:
                    out.append((i, stop - at))
                    at = stop
                    break
            else:
                return unknown
        return out

    return run


def unigram(spec: ModelSpec) -> Callable[[bytes], Ids | None]:
    """The segmentation of the highest sum of scores; of equal ones that whose last token begins first."""
    score = {}
    for (i, t), s in zip(spec.vocab, spec.scores or [0.0] * len(spec.vocab)):
        if t and t not in score and not (spec.byte_fallback and len(t) == 6 and t[:3] == b"<0x"):
            score[t] = (i, s)
    byte = _byte_ids(spec) if spec.byte_fallback else {}
    longest = max(map(len, score), default=0)
    penalty = min([s for s in spec.scores], default=0.0) - 10.0 if spec.unk_id is not None else 0.0

    def run(piece: bytes) -> Ids | None:
        n = len(piece)
        best = [float("-inf")] * (n + 1)
        back: list[tuple[int, int, bool]] = [(0, 0, False)] * (n + 1)
        best[0] = 0.0
        starts = [k for k in range(n) if piece[k] & 0xC0 != 0x80]
        for at, k in enumerate(starts):
            if best[k] == float("-inf"):
                continue
            stop = starts[at + 1] if at + 1 < len(starts) else n
            alone = False
            for z in range(k + 1, min(n, k + longest) + 1):
                hit = score.get(piece[k:z])
                if hit:
                    alone |= z == stop
                    if best[k] + hit[1] > best[z]:
                        best[z], back[z] = best[k] + hit[1], (hit[0], k, False)
            if not alone and best[k] + penalty > best[stop]:
                best[stop], back[stop] = best[k] + penalty, (-1, k, True)
        out: Ids = []
        z = n
        while z:
            i, k, unknown = back[z]
            raw = piece[k:z]
            if not unknown:
                out.append((i, z - k))
            elif spec.byte_fallback and all(b in byte for b in raw):
                out += [(byte[b], 1) for b in reversed(raw)]
            elif spec.unk_id is None:
                return None
            else:
                out.append((spec.unk_id, z - k))
            z = k
        return _fused(out[::-1], spec.unk_id)

    return run


def core(spec: ModelSpec) -> Callable[[bytes], Ids | None]:
    return {"bpe": bpe, "wordpiece": wordpiece, "sp_bpe": sp_bpe, "unigram": unigram}[spec.encoder](spec)


def splits_at_marks(spec: ModelSpec) -> bool:
    """Whether no token goes on with a ``▁`` after another character, so that text may be cut before each run of them."""
    for _, t in spec.vocab:
        while t.startswith(MARK):
            t = t[len(MARK) :]
        if MARK in t:
            return False
    return True
