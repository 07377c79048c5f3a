"""Secret scans by a linear-chain conditional random field.

Tokens are runs of word characters and, one by one, all other characters that
aren't white space.  Each is tagged secret begin (B), inside (I) or outside (O)
from its shape and word, the words up to three before it and the one after it,
the shapes of its neighbours, how it is glued to them, and features of the whole
file.  Viterbi decoding is exact: where a token's scores for B and I are so low
that no transition could make up for them, every best path has O there, so only
the runs between such tokens are decoded, all runs of a batch at a time.

The field is trained here on windows of a bounded sample of documents, about
``fit_rows`` with ``fit_windows`` windows each, wherever they lie in the text.
Seed rules label what secrets the windows hold, and secrets and decoys made from
a fixed random sequence are put into half of them.

Cost: one pass over the texts, no shuffle; the model that is broadcast has a
fixed size.  Null and empty texts have no secrets; rows without doc_id are told
with a null id; repeated rows are told each.  Spans are in characters, end
exclusive.  With no text to learn from, the windows are the made ones alone.
"""

from __future__ import annotations

import hashlib
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, documents_in
from .text import U64, char_offsets, fold, slices, span_hashes, spans_of

O, B, I = 0, 1, 2  # noqa: E741
BITS = 15
_UPPER, _LOWER, _DIGIT, _OTHER, _WIDE, _NOTHEX = 1, 2, 4, 8, 16, 32
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[95] = _UPPER | _NOTHEX, _LOWER | _NOTHEX, _DIGIT, _OTHER | _NOTHEX
for _c in b"abcdef":
    _CLASS[_c], _CLASS[_c - 32] = _LOWER, _UPPER
_CLASS[128:] = _WIDE | _NOTHEX
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[0xC2:] = True
_BYTES = np.ones(256, np.int64)
_BYTES[0xC2:0xE0], _BYTES[0xE0:0xF0], _BYTES[0xF0:] = 2, 3, 4
_LENGTH = np.searchsorted([1, 2, 3, 5, 7, 9, 12, 15, 19, 24, 31, 39, 47, 63, 95], np.arange(130), "left")  # 16 buckets
_SHAPES = 16 * 64 * 4
_WORDS = 1 << BITS
#: Feature groups: own word, words at -1 -2 -3 +1, shapes at 0 -1 +1, glue, file, and the nearest word before (the marks between them left out) by the token's length.
_SIZES = (_WORDS, _WORDS, _WORDS, _WORDS, _WORDS, _SHAPES, _SHAPES, _SHAPES, 4 * 16, 4 * 4 * 4 * 16, _WORDS)
_FIRST = np.append(0, np.cumsum(_SIZES))


class Tokens:
    """Tokens of a run of texts, with a feature of each group (an index into the weights)."""

    __slots__ = ("at", "end", "features", "start")

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        low, inside = fold(buf)
        ws, we = spans_of(inside, off)
        mark = np.flatnonzero(~inside & _MARK[buf])
        start = np.concatenate([ws, mark])
        order = np.argsort(start, kind="stable")
        self.start = start[order]
        self.end = np.concatenate([we, np.minimum(mark + _BYTES[buf[mark]], len(buf))])[order]
        self.at = np.searchsorted(self.start, off)
        self.features = self._features(buf, off, low, inside) if len(self.start) else np.zeros((len(_SIZES), 0), np.int64)

    def _features(self, buf, off, low, inside):
        start, end, at = self.start, self.end, self.at
        n = len(start)
        kind = np.where(inside, _CLASS[buf], 0)
        bits = np.bitwise_or.reduceat(kind, start)
        plain = kind & ~np.uint8(_NOTHEX)
        change = np.zeros(len(buf), np.int32)
        change[1:] = (plain[1:] != plain[:-1]) & inside[1:] & inside[:-1]
        changes = np.add.reduceat(change, start)
        size = end - start
        changes = np.minimum(np.where(changes * 4 >= size, 3, np.where(changes * 10 >= size, 2, changes > 0)), 3)
        length = _LENGTH[np.minimum(size, 129)]
        word = bits != 0
        shape = np.where(word, (length * 64 + bits) * 4 + changes, buf[start].astype(np.int64))
        word_hash = (span_hashes(low, start, end) >> U64(64 - BITS)).astype(np.int64)
        unlike = (bits & (_DIGIT | _OTHER) == _DIGIT) | (size > 24)  # no two such tokens are alike: their shape stands for them
        word_hash[unlike] = (length[unlike] * 64 + bits[unlike]) & (_WORDS - 1)

        first = np.zeros(n, bool)
        first[at[:-1][at[1:] > at[:-1]]] = True
        # tokens beyond a text's border count as word 0 and shape 0
        place = np.arange(n) - np.repeat(at[:-1], np.diff(at))
        left = np.repeat(at[1:], np.diff(at)) - 1 - np.arange(n)

        def moved(x, by):
            out = np.zeros_like(x)
            if by < 0:
                if n > -by:
                    out[-by:] = x[:by]
                out[place < -by] = 0
            else:
                if n > by:
                    out[:-by] = x[by:]
                out[left < by] = 0
            return out

        glued = np.zeros(n, bool)
        glued[1:] = start[1:] == end[:-1]
        glued &= ~first
        after = moved(glued.astype(np.int64), 1)
        total = np.maximum(np.diff(off), 1)
        share = lambda x: np.diff(np.append(0, np.cumsum(x))[off]) / total
        digits, marks = share((buf >= 48) & (buf < 58)), share(~inside & _MARK[buf])
        lines = np.diff(np.append(0, np.cumsum(buf == 10))[off]) / total
        file = (np.searchsorted([0.01, 0.05, 0.15], digits) * 4 + np.searchsorted([0.02, 0.06, 0.15], marks)) * 4 + np.searchsorted([0.002, 0.01, 0.03], lines)
        # the last token before that is a word, however many marks lie between; 0 where there is none
        where = np.maximum.accumulate(np.where(word, np.arange(n), -1))
        where = np.append(-1, where[:-1])
        key = np.where(where >= np.repeat(at[:-1], np.diff(at)), word_hash[where], 0)
        crossed = ((key * 0x9E3779B1 + length * 0x85EBCA77 + (bits >> 2 & 1)) >> 7) & (_WORDS - 1)
        groups = (
            word_hash, moved(word_hash, -1), moved(word_hash, -2), moved(word_hash, -3), moved(word_hash, 1),
            shape, moved(shape, -1), moved(shape, 1), (glued * 2 + after) * 16 + np.where(word, length, 0), np.repeat(file, np.diff(at)) * 16 + length, crossed,
        )
        return np.stack(groups) + _FIRST[:-1, None]


@dataclass(frozen=True)
class Field:
    """Weights for B and I (those for O are 0) of all features, and transitions [from, to]."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Scores of B and I over that of O, for each token."""
        out = np.zeros((2, features.shape[1]), np.float32)
        for k in range(2):
            w = np.ascontiguousarray(self.weights[:, k])
            for f in features:
                out[k] += w[f]
        return out

    def decode(self, e: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The best tags of texts whose tokens are ``at[i]:at[i+1]``; before and after a text comes O."""
        t = self.moves
        gain = [(t[:, y][:, None] + t[y][None, :] - t[:, O][:, None] - t[O][None, :]).max() for y in (B, I)]
        open_ = (e[0] >= -gain[0]) | (e[1] >= -gain[1])
        tags = np.zeros(e.shape[1], np.int8)
        if not open_.any():
            return tags
        edge = np.zeros(len(open_) + 1, bool)
        edge[at] = True
        head = open_.copy()
        head[1:] &= ~open_[:-1] | edge[1:-1]
        tail = open_.copy()
        tail[:-1] &= ~open_[1:] | edge[1:-1]
        first, last = np.flatnonzero(head), np.flatnonzero(tail)
        size = last - first + 1
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        longest = int(size[0])
        score = lambda i: np.stack([np.zeros(len(i), np.float32), e[0, i], e[1, i]], 1)
        best = t[O][None, :] + score(first)
        back = []
        live = [len(first)]
        ends = np.empty((len(first), 3), np.float64)
        for step in range(1, longest):
            n = int(np.searchsorted(-size, -step, "left"))  # runs longer than step
            ends[n : live[-1]] = best[n:]
            ways = best[:n, :, None] + t[None]
            back.append(ways.argmax(1).astype(np.int8))
            best = ways.max(1) + score(first[:n] + step)
            live.append(n)
        ends[: live[-1]] = best
        tag = (ends + t[:, O]).argmax(1)
        for step in range(longest - 1, -1, -1):
            n = live[step]
            tags[first[:n] + step] = tag[:n]
            if step:
                tag[:n] = back[step - 1][np.arange(n), tag[:n]]
        return tags


def spans(tags: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) tokens of the secrets: a B, or an I that follows neither, and the Is after it."""
    edge = np.zeros(len(tags) + 1, bool)
    edge[at] = True
    before = np.append(O, tags[:-1])
    before[edge[:-1]] = O
    head = (tags == B) | ((tags == I) & (before == O))
    after = np.append(tags[1:], O)
    after[edge[1:]] = O
    tail = (tags != O) & (after != I)
    return np.flatnonzero(head), np.flatnonzero(tail)


class _Batch:
    """Sequences, longest first, laid out by step: those of step s are ``at[s]:at[s+1]``."""

    def __init__(self, own: list[tuple[np.ndarray, np.ndarray]]):
        own = sorted(own, key=lambda x: -len(x[1]))
        size = np.array([len(y) for _, y in own])
        self.live = [int((size > s).sum()) for s in range(int(size[0]))]
        self.at = np.append(0, np.cumsum(self.live))
        place = np.concatenate([self.at[: len(y)] + r for r, (_, y) in enumerate(own)])
        self.x = np.empty((len(_SIZES), len(place)), np.int64)
        self.x[:, place] = np.concatenate([x for x, _ in own], 1)
        self.y = np.empty(len(place), np.int64)
        self.y[place] = np.concatenate([y for _, y in own])
        self.seen = np.zeros((3, 3))
        for _, y in own:
            np.add.at(self.seen, (np.append(O, y), np.append(y, O)), 1)

    def slope(self, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradients of the mean negative log-likelihood by token."""
        e = np.zeros((self.at[-1], 3))
        for k in (0, 1):
            own = np.ascontiguousarray(w[:, k])
            for f in self.x:
                e[:, k + 1] += own[f]
        em, expt = np.exp(e - e.max(1, keepdims=True)), np.exp(t)
        alpha, beta, scale = np.empty_like(em), np.empty_like(em), np.empty(len(em))
        at, live = self.at, self.live
        for s, n in enumerate(live):
            a = (alpha[at[s - 1] : at[s - 1] + n] @ expt if s else np.repeat(expt[O][None], n, 0)) * em[at[s] : at[s + 1]]
            scale[at[s] : at[s + 1]] = a.sum(1)
            alpha[at[s] : at[s + 1]] = a / scale[at[s] : at[s + 1], None]
        both = np.zeros((3, 3))
        for s in range(len(live) - 1, -1, -1):
            now, more = slice(at[s], at[s + 1]), live[s + 1] if s + 1 < len(live) else 0
            beta[now] = expt[:, O]
            beta[at[s] + more : at[s + 1]] /= (alpha[at[s] + more : at[s + 1]] @ expt[:, O])[:, None]
            if more:
                k = slice(at[s + 1], at[s + 1] + more)
                after = em[k] * beta[k] / scale[k, None]
                beta[at[s] : at[s] + more] = after @ expt.T
                both += expt * (alpha[at[s] : at[s] + more].T @ after)
            both[:, O] += (alpha[at[s] + more : at[s + 1]] * beta[at[s] + more : at[s + 1]]).sum(0)
        share = alpha * beta
        both[O] += share[: live[0]].sum(0)
        share[np.arange(len(share)), self.y] -= 1
        gw = np.stack([sum(np.bincount(f, share[:, k], len(w)) for f in self.x) for k in (1, 2)], 1)
        return gw / len(share), (both - self.seen) / len(share)


def train(texts: list[str], marked: list[list[tuple[int, int]]], rounds: int = 16, batch: int = 200, decay: float = 1e-5, rate: float = 0.2) -> Field:
    """A field fitted to texts with character spans of secrets, by AdaGrad on the regularised likelihood."""
    own = []
    for text, found in zip(texts, marked):
        raw = np.frombuffer(text.encode(), np.uint8)
        if not len(raw):
            continue
        t = Tokens(raw, np.array([0, len(raw)]))
        if not len(t.start):
            continue
        a, b = char_offsets(raw, t.start), char_offsets(raw, t.end)
        y = np.zeros(len(a), np.int64)
        for x, z in found:
            inside = np.flatnonzero((a < z) & (b > x))
            y[inside], y[inside[:1]] = I, B
        own.append((t.features, y))
    own.sort(key=lambda x: len(x[1]))
    batches = [_Batch(own[k : k + batch]) for k in range(0, len(own), batch)]
    used = np.unique(np.concatenate([b.x.ravel() for b in batches]))
    for b in batches:
        b.x = np.searchsorted(used, b.x)
    w, t = np.zeros((len(used), 2)), np.zeros((3, 3))
    past_w, past_t = np.full_like(w, 1e-8), np.full_like(t, 1e-6)
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        for k in rng.permutation(len(batches)):
            gw, gt = batches[k].slope(w, t)
            gw += decay * w
            past_w += gw * gw
            past_t += gt * gt
            w -= rate * gw / np.sqrt(past_w)
            t -= rate * gt / np.sqrt(past_t)
    weights = np.zeros((_FIRST[-1], 2), np.float32)
    weights[used] = w
    return Field(weights, t)


SEED = re.compile(
    r"""(?ix)\b[\w-]*(?:token|secret|passw(?:or)?d|passwd|api[_-]?key|access[_-]?key|private[_-]?key)["']?\s*(?:=>|[=:])\s*["']?([a-z0-9+/_.=-]{16,})"""
)
_NAMES = "token secret api_key apikey api-key client_secret password passwd pwd auth_token access_token access_key secret_key SECRET_KEY AWS_SECRET_ACCESS_KEY API_KEY GITHUB_TOKEN db_password private_key signing_key encryption_key session_token refresh_token bot_token webhook_secret".split()
_PLAIN = "sha256 sha1 md5 commit checksum digest etag revision uuid id hash build version order ref tree blob trace".split()
_JOINS = (' = "%s"', '="%s"', ": %s", "=%s", ': "%s"', " => '%s'", " = '%s'", "='%s'", " %s", ' "%s"')


def make(rng: np.random.Generator) -> tuple[str, tuple[int, int] | None]:
    """A made secret in its context, with the secret's span, or a decoy."""
    some = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    pick = lambda x: x[int(rng.integers(len(x)))]
    hexa, alnum, base64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    if rng.random() < 0.5:
        kind = int(rng.integers(10))
        name, join = pick(_NAMES), pick(_JOINS[:8])
        if kind <= 3:
            value = some(hexa, pick([32, 40, 40, 48, 64]) if rng.random() < 0.5 else int(rng.integers(12, 65)))
        elif kind == 4:
            value = some(base64, int(rng.integers(20, 80))) + pick(["", "=", "=="])
        elif kind == 5:
            value = some(alnum, int(rng.integers(16, 48)))
        elif kind == 6:
            value = pick(["ghp_", "sk-", "pk_live_", "xoxb-", "glpat-", "tok_"]) + some(alnum, int(rng.integers(20, 44)))
            join = pick(_JOINS)
            name = pick([name, "key", "with", "use", "is"])
        elif kind == 7:
            value = "eyJ" + some(alnum, 17) + ".eyJ" + some(alnum, int(rng.integers(20, 60))) + "." + some(alnum + "_-", 43)
            name, join = pick([name, "Bearer", "Authorization: Bearer"]), pick([" %s", join])
        elif kind == 8:
            value = some(pick([alnum + "!@#$%^&*", alnum, hexa]), int(rng.integers(10, 24)))
            name = pick(["password", "passwd", "pwd", "db_password"])
        else:
            value = "AKIA" + some(string.ascii_uppercase + string.digits, 16)
            name = pick([name, "aws_access_key_id", "key"])
        text = name + join % value
        a = text.rindex(value)
        return text, (a, a + len(value))
    kind = int(rng.integers(12))
    if kind <= 2:
        return pick(_PLAIN) + pick(_JOINS) % some(hexa, pick([7, 12, 32, 40, 64]) if rng.random() < 0.5 else int(rng.integers(7, 65))), None
    if kind == 3:
        return pick(["uuid", "id", "request", "trace_id"]) + pick(_JOINS) % "-".join(some(hexa, n) for n in (8, 4, 4, 4, 12)), None
    if kind == 4:
        return some(string.ascii_lowercase, 5) + f".{some(string.digits, 2)}@" + some(string.ascii_lowercase, 5) + pick([".example.com", ".org", "7.example.com"]), None
    if kind == 5:
        return f"+1 ({some(string.digits, 3)}) 555-{some(string.digits, 4)}", None
    if kind == 6:
        return some(string.digits, pick([4, 8, 10, 16, 16])), None
    if kind == 7:
        return ".".join(str(x) for x in rng.integers(0, 256, 4)), None
    if kind == 8:
        return "https://" + some(string.ascii_lowercase, 8) + ".com/" + some(alnum.lower(), int(rng.integers(4, 24))) + "/" + some(string.ascii_lowercase, 9), None
    if kind == 9:
        return pick(_NAMES) + pick([" is required", ": none", " = the", "s and ", ' = ""', ": required", " of the", " must not be shared"]), None
    if kind == 10:  # junk of one word again and again
        word = some(pick([string.ascii_lowercase, string.ascii_uppercase, string.ascii_lowercase + "éñüàßö", string.digits]), int(rng.integers(1, 12)))
        return pick([" ", " ", "", ", "]).join([pick([word, word.capitalize()])] * int(rng.integers(3, 40))), None
    return pick(["maxRetryCountPerRequest", "handle_incoming_request_body", "MAX_BUFFER_SIZE_IN_BYTES", "Donaudampfschifffahrtsgesellschaft", "internationalization", "x86_64", "utf8mb4_general_ci", "2024-05-17T10:22:31Z"]), None


def made_windows(snippets: list[str], windows: int = 2400, seed: int = 20240613) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Texts with the spans of secrets: snippets with what the seed rules find and, in most, made secrets or decoys."""
    rng = np.random.default_rng(seed)
    texts, marked = [], []
    for k in range(max(windows, len(snippets))):
        base = snippets[k] if k < len(snippets) else ""
        own = [m.span(1) for m in SEED.finditer(base)]
        for _ in range(int(rng.integers(0, 3)) if base else 2):
            text, span = make(rng)
            places = [m.start() for m in re.finditer(r"(?<=\s)(?=\S)", base)]
            places = [0, len(base)] + [p for p in places if all(p <= a - 20 or p >= b for a, b in own)]
            places = [p for p in places if all(not (a - 20 < p < b) for a, b in own)]
            if not places:
                continue
            p = places[int(rng.integers(len(places)))]
            put = text + (" " if rng.random() < 0.8 else "\n")
            if p and not base[p - 1].isspace():
                put = " " + put
                span = span and (span[0] + 1, span[1] + 1)
            base = base[:p] + put + base[p:]
            own = [(a + len(put), b + len(put)) if a >= p else (a, b) for a, b in own]
            if span:
                own.append((span[0] + p, span[1] + p))
        if rng.random() < 0.1:
            up = "".join(c.upper() if len(c.upper()) == 1 else c for c in base)
            base = up
        if rng.random() < 0.12:  # marks after words, as in junk
            cut, out, moved = [0], [], []
            junk = ["!!", "###", "%%%", "***", "$$$", "&&&", ",!!"]
            for m in re.finditer(r"\s|$", base):
                cut.append(m.start())
            total = 0
            ends = []
            for a, b in zip(cut[:-1], cut[1:]):
                mark = junk[int(rng.integers(len(junk)))] if b > a and rng.random() < 0.8 else ""
                out.append(base[a:b] + mark)
                ends.append((b, total))
                total += len(mark)
            for a, b in own:
                shift = max((s for e, s in ends if e >= a), key=lambda s: -s, default=total)
                last = max((s for e, s in ends if e >= b), key=lambda s: -s, default=total)
                moved.append((a + shift, b + last))
            base, own = "".join(out), moved
        texts.append(base)
        marked.append(own)
    return texts, marked


def snippets_of(docs: DataFrame, fit_rows: int, fit_windows: int, width: int = 200) -> list[str]:
    """Windows of ``width`` characters or so of about ``fit_rows`` documents, at places drawn by doc_id."""
    known = docs.where("text is not null and doc_id is not null")
    n = docs.count()
    if not n:
        return []
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("crf")), 11) / F.lit(float(1 << 53))

    def run(batches):
        for batch in batches:
            out, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rng = np.random.default_rng(abs(doc_id))
                for _ in range(min(fit_windows, len(text) // width + 1)):
                    a = int(rng.integers(0, max(1, len(text) - width)))
                    piece = text[a : a + width]
                    inner = re.sub(r"^\S*\s", "", piece) if a else piece
                    out.append(re.sub(r"\s\S*$", "", inner) if a + width < len(text) else inner)
                    ids.append(doc_id)
            yield {"doc_id": ids, "piece": out}

    got = arrow_map(known.where(place < F.lit(fit_rows / n)), run, "doc_id long, piece string").toArrow()
    return [p for _, p in sorted(zip(got.column("doc_id").to_pylist(), got.column("piece").to_pylist())) if p]


def fit(docs: DataFrame, fit_rows: int = 800, fit_windows: int = 3) -> Field:
    return train(*made_windows(snippets_of(docs, fit_rows, fit_windows)))


def _scan(shared):
    def run(batches):
        field = shared.value
        for batch in batches:
            for a, b, buf, off in slices(batch.column(1)):
                if not len(buf):
                    continue
                t = Tokens(buf, off)
                e = field.emissions(t.features)
                tags = field.decode(e, t.at)
                first, last = spans(tags, t.at)
                if not len(first):
                    continue
                score = np.maximum(e[0], e[1])
                total = np.append(0, np.cumsum(score, dtype=np.float64))
                row = np.searchsorted(t.at, first, "right") - 1
                start, end = t.start[first], t.end[last]
                out = {"doc_id": batch.column(0).slice(a, b - a).take(pa.array(row)), "start": np.empty(len(first), np.int32), "end": np.empty(len(first), np.int32)}
                for r in np.unique(row):
                    own = row == r
                    out["start"][own] = char_offsets(buf[off[r] : off[r + 1]], start[own] - off[r])
                    out["end"][own] = char_offsets(buf[off[r] : off[r + 1]], end[own] - off[r])
                yield out | {"score": (total[last + 1] - total[first]) / (last + 1 - first), "sha256": [hashlib.sha256(buf[x:y].tobytes()).hexdigest() for x, y in zip(start, end)]}

    return run


def scan_secrets(docs: DataFrame, fit_rows: int = 800, fit_windows: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, score, sha256) of the secrets; ``score`` is the mean over its tokens of their tags' lead over O, and the secret itself is told as a digest."""
    d = documents_in(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit(d, fit_rows, fit_windows))
    return arrow_map(d, _scan(shared), "doc_id long, start int, end int, score double, sha256 string")
