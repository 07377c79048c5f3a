"""Text columns to id columns by one Arrow function.

Where a model's stages allow it, texts go to Python as they are, and each
distinct chunk of a text is normalized, split and encoded once by a worker
(``operators.chunks``), many at a time for byte-level merges (``operators.batch``).  Texts of models without merges,
or without a pretokenizer and with few of them, are worked on as flat bytes.  Else
pieces are made by native expressions, and each slice's distinct pieces are
encoded.  A worker keeps the ids of pieces that it has seen (``MEMO`` bytes of
them at most), and looks at a slice of a batch at a time.  There is no shuffle, and
the same columns serve batch and streaming.  ``plans.dedup`` is the other plan, by joins.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.buffers import buffers
from ..functions.pretokenize import NAMED, splitter, stages
from ..functions.pretokenize import pieces as native_pieces
from ..spec import ModelSpec
from ..workers import in_slices, reach
from . import batch, chunks
from .cores import core, splits_at_marks

#: Bytes that a worker's memo of pieces takes in all, about, with what Python needs for each piece and id; pieces of over a 64th of it aren't kept.
MEMO = 3 << 26
#: Bytes of a kept piece beside its own: the object, two lists, a pair and a place in the table; and of an id with its size.
_EACH, _ID = 400, 48
#: Models that a worker keeps at once.
MODELS = 3


class Worker:
    """A model's encoder with its memo."""

    def __init__(self, spec: ModelSpec):
        self.spec, self.run, self.memo, self.size = spec, core(spec), {}, 0
        self.merges = batch.Merges(spec) if batch.serves(spec) else None

    def __call__(self, piece: bytes) -> tuple[list[int], list[int]] | None:
        """The piece's ids and their sizes in bytes."""
        got = self.memo.get(piece, False)
        if got is False:
            pairs = self.run(piece)
            got = pairs if pairs is None else ([i for i, _ in pairs], [n for _, n in pairs])
            size = len(piece) + _EACH + _ID * (len(got[0]) if got else 0)
            if size * 64 > MEMO:
                return got
            self.size += size
            if self.size > MEMO:
                self.memo.clear()
                self.size = size
            self.memo[piece] = got
        return got

    def many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes in bytes, number of ids of each piece, -1 if it can't be encoded)."""
        if self.merges:
            return self.merges(pieces)
        got = [self(p) for p in pieces]
        count = np.array([-1 if g is None else len(g[0]) for g in got], np.int64)
        flat = lambda k: np.fromiter(chain.from_iterable(g[k] for g in got if g), np.int32, int(np.maximum(count, 0).sum()))
        return flat(0), flat(1), count


_workers: dict[str, Worker] = {}


def worker(shared) -> Worker:
    """This process's encoder of a broadcast model."""
    spec = shared.value
    if spec.key not in _workers:
        if len(_workers) >= MODELS:
            _workers.clear()
        _workers[spec.key] = Worker(spec)
    return _workers[spec.key]


_broadcast: dict[tuple[str, str], object] = {}


def share(spec: ModelSpec):
    """The model's broadcast, one for each application."""
    spark = SparkSession.active()
    reach(spark)
    key = (spark.sparkContext.applicationId, spec.key)
    if key not in _broadcast:
        spec.key  # noqa: B018  computed once, and sent along
        _broadcast[key] = spark.sparkContext.broadcast(spec)
    return _broadcast[key]


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(values, bounds by row, whether each row is null) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    null = np.asarray(column.is_null()) if column.null_count else np.zeros(len(column), bool)
    size = np.where(null, 0, np.diff(column.offsets.to_numpy()))
    return column.flatten(), np.append(0, np.cumsum(size)), null


def _tables(encode: Worker, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of the table for each piece; ids, sizes and number of ids of the table's rows, -1 for a piece that can't be encoded)."""
    text = values.field("text") if pa.types.is_struct(values.type) else values
    if values.null_count and pa.types.is_struct(values.type):
        raise ValueError("null pieces")
    coded = text.dictionary_encode() if not pa.types.is_dictionary(text.type) else text
    words = coded.dictionary.to_pylist()
    ids, sizes, count = encode.many([w if isinstance(w, bytes) else w.encode() for w in words])
    code = coded.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_struct(values.type):  # added tokens come with their ids
        given = values.field("id")
        own = np.flatnonzero(np.asarray(given.is_valid()))
        if len(own):
            one, back = np.unique(given.take(pa.array(own)).to_numpy(), return_inverse=True)
            code[own] = len(count) + back
            ids, count = np.append(ids, one), np.append(count, np.ones(len(one), np.int64))
            sizes = np.append(sizes, [len(encode.spec.tokens.get(int(i), b"")) for i in one])
    return code, ids, sizes, count


def _lists(encode: Worker, column: pa.Array):
    """(ids, sizes, bounds by row, null rows, first id of each piece) of a column of pieces; a row with a piece that can't be encoded is null."""
    values, bounds, null = _flat(column)
    if not len(values):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64), null, np.zeros(1, np.int64)
    code, ids, sizes, count = _tables(encode, values)
    bad, count = count < 0, np.maximum(count, 0)
    pick, ends = _gather(count, code)
    if bad.any():
        null = null | (np.diff(np.append(0, np.cumsum(bad[code]))[bounds]) > 0)
    return ids[pick].astype(np.int32), sizes[pick].astype(np.int64), ends[bounds], null, ends


def _gather(count: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the ids of rows of a table with so many ids each, first id of each with the end)."""
    n = count[code]
    ends = np.append(0, np.cumsum(n))
    return np.repeat((np.cumsum(count) - count)[code] - ends[:-1], n) + np.arange(ends[-1]), ends


def _list_array(values: pa.Array, bounds: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values, mask=pa.array(null) if null.any() else None)


def _without_repeated_unknowns(ids, bounds, unk):
    """Keeps of a row's neighbouring unknowns the first."""
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != unk) | (ids[:-1] != unk)
    inner = bounds[(bounds < len(ids))]
    keep[inner] = True
    return keep


def collapses(spec: ModelSpec) -> bool:
    return spec.unk_id is not None and (spec.encoder == "unigram" or spec.fuse_unk)


def ids_of_pieces(c: Column, spec: ModelSpec) -> Column:
    """An array of pieces (or of (text, id) structs) as an array of ids."""
    shared = share(spec)

    @in_slices("array<int>")
    def run(column: pa.Array) -> pa.Array:
        encode = worker(shared)
        ids, _, bounds, null, _ = _lists(encode, column)
        if collapses(encode.spec) and len(ids):
            keep = _without_repeated_unknowns(ids, bounds, encode.spec.unk_id)
            ids, bounds = ids[keep], np.append(0, np.cumsum(keep))[bounds]
        return _list_array(pa.array(ids, pa.int32()), bounds, null)

    return run(c)


def count_of_pieces(c: Column, spec: ModelSpec) -> Column:
    """The number of ids of an array of pieces; the ids stay in the worker."""
    shared = share(spec)

    @in_slices("int")
    def run(column: pa.Array) -> pa.Array:
        encode = worker(shared)
        ids, _, bounds, null, _ = _lists(encode, column)
        if collapses(encode.spec) and len(ids):
            bounds = np.append(0, np.cumsum(_without_repeated_unknowns(ids, bounds, encode.spec.unk_id)))[bounds]
        return pa.array(np.diff(bounds).astype(np.int32), mask=null)

    return run(c)


OFFSETS = "struct<ids: array<int>, offsets: array<struct<start: int, end: int>>>"


def offsets_of_pieces(text: Column, c: Column, spec: ModelSpec) -> Column:
    """Ids with their byte ranges in ``text``, in which the pieces are looked for one after the other."""
    shared = share(spec)

    @in_slices(OFFSETS)
    def run(texts: pa.Array, column: pa.Array) -> pa.Array:
        encode = worker(shared)
        ids, sizes, bounds, null, ends = _lists(encode, column)
        values, piece_bounds, _ = _flat(column)
        words = [None if w is None else w.encode() for w in values.to_pylist()]
        start = np.zeros(len(ids), np.int64)
        for row, text in enumerate(texts.to_pylist()):
            if null[row] or text is None:
                continue
            raw, at = text.encode(), 0
            for p in range(piece_bounds[row], piece_bounds[row + 1]):
                at = max(at, raw.find(words[p], at))
                own = slice(ends[p], ends[p + 1])
                start[own] = at + np.cumsum(sizes[own]) - sizes[own]
                at += len(words[p])
        end = start + sizes
        if collapses(encode.spec) and len(ids):
            keep = _without_repeated_unknowns(ids, bounds, encode.spec.unk_id)
            place = np.flatnonzero(keep)
            end = np.maximum.reduceat(end, place)
            ids, start, bounds = ids[keep], start[keep], np.append(0, np.cumsum(keep))[bounds]
        pair = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["start", "end"])
        return pa.StructArray.from_arrays([_list_array(pa.array(ids, pa.int32()), bounds, null), _list_array(pair, bounds, null)], ["ids", "offsets"], mask=pa.array(null))

    return run(text, c)


# added tokens


@lru_cache(maxsize=64)
def _matcher(contents: tuple[str, ...]):
    return re.compile("|".join(re.escape(c) for c in sorted(contents, key=lambda c: (-len(c), c)))) if contents else None


def split_on_added(text: str, added) -> list[tuple[int | None, str, int]]:
    """(id, text, start) of a text's parts; added tokens by the leftmost, longest match, with their flags."""
    tokens = {t.content: t for t in reversed(added) if t.content}
    matcher = _matcher(tuple(tokens))
    out, at = [], 0
    for m in matcher.finditer(text) if matcher else ():
        t, a, b = tokens[m[0]], m.start(), m.end()
        wordy = lambda c: c.isalnum() or c == "_"
        if t.single_word and ((a and wordy(text[a - 1])) or (b < len(text) and wordy(text[b]))):
            continue
        if t.lstrip:
            while a > at and text[a - 1].isspace():
                a -= 1
        if t.rstrip:
            while b < len(text) and text[b].isspace():
                b += 1
        a = max(a, at)
        if at < a:
            out.append((None, text[at:a], at))
        out.append((t.id, text[a:b], a))
        at = b
    if at < len(text):
        out.append((None, text[at:], at))
    return out


def segments(text: str, spec: ModelSpec, normalize) -> list[tuple[int | None, str]]:
    """Raw added tokens are split off first, then each rest is normalized and split on the others."""
    raw = [t for t in spec.added if not t.normalized]
    later = [t for t in spec.added if t.normalized]
    out = []
    for i, part, start in split_on_added(text, raw):
        if i is not None:
            out.append((i, part))
            continue
        done = normalize(part, start == 0)
        for j, piece, _ in split_on_added(done, later) if later else [(None, done, 0)]:
            if piece:
                out.append((j, piece))
    return out


SEGMENTS = "array<struct<id: int, text: string>>"


def segment_column(c: Column, spec: ModelSpec) -> Column:
    shared = share(spec)

    @in_slices(SEGMENTS)
    def run(texts: pa.Array) -> pa.Array:
        own = shared.value
        f = N.normalizer(own.normalizer)
        kind = pa.list_(pa.struct([("id", pa.int32()), ("text", pa.string())]))
        return pa.array([None if t is None else [{"id": i, "text": x} for i, x in segments(t, own, f)] for t in texts.to_pylist()], kind)

    return run(c)


def _spaced(c: Column, spec: ModelSpec) -> Column:
    return F.when((c == "") | c.rlike(r"^(?U)\s"), c).otherwise(F.concat(F.lit(" "), c)) if spec.add_prefix_space else c


def stages_of(spec: ModelSpec):
    """The pretokenizer; without one, units at ``▁`` where the vocabulary allows it."""
    if spec.pretokenizer is None and spec.encoder in ("sp_bpe", "unigram") and splits_at_marks(spec):
        return "units"
    return spec.pretokenizer


def normalized(c: Column, spec: ModelSpec) -> Column:
    return _spaced(N.normalize(c, spec.normalizer), spec)


def pieces(c: Column, spec: ModelSpec) -> Column:
    """The pieces that get encoded: strings, or (text, id) structs where the model has added tokens."""
    how = stages_of(spec)
    if not spec.added:
        return native_pieces(normalized(c, spec), how)

    def part(s):
        own = F.transform(native_pieces(_spaced(s["text"], spec), how), lambda x: F.struct(x.alias("text"), F.lit(None).cast("int").alias("id")))
        return F.when(s["id"].isNotNull(), F.array(F.struct(F.lit("").alias("text"), s["id"].alias("id")))).otherwise(own)

    return F.flatten(F.transform(segment_column(c, spec), part))


# whole texts


def by_chunks(spec: ModelSpec) -> bool:
    """Whether texts may be worked on by chunks: nothing looks across a cut, and added tokens are looked for in the texts as they are."""
    return chunks.cuts_at_spaces(spec.normalizer, stages_of(spec)) and (not spec.normalizer or not any(t.normalized for t in spec.added))


#: White space by Unicode's property, as Spark's expressions take it.
_BLANKS = frozenset("\t\n\x0b\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}


def _led(text: str, spec: ModelSpec) -> str:
    return " " + text if spec.add_prefix_space and text and text[0] not in _BLANKS else text


def prepared(spec: ModelSpec):
    """A function of a whole text to its (id, piece) parts: an added token has an id."""
    norm, split = N.normalizer(spec.normalizer), splitter(stages_of(spec))

    def run(text: str):
        for i, part in segments(text, spec, norm) if spec.added else [(None, norm(text, True))]:
            if i is not None:
                yield i, part
            else:
                for p in split(_led(part, spec)):
                    yield None, p

    return run


def _encoding_chunks(encode: Worker) -> chunks.Chunks:
    spec = encode.spec
    cut = by_chunks(spec)
    first, later, split, parts = N.normalizer(spec.normalizer), N.normalizer(chunks.later(spec.normalizer)), splitter(stages_of(spec)), prepared(spec)
    plain = not spec.normalizer

    def joined(got: list):
        if len(got) == 1:
            return got[0]
        return None if None in got else (list(chain.from_iterable(x for x, _ in got)), list(chain.from_iterable(y for _, y in got)))

    def work(text: str, leads: bool, whole: bool):
        return joined([encode(piece.encode()) if i is None else ([i], [len(spec.tokens.get(i, b""))]) for i, piece in parts(text)])

    def many(texts: list[str], leads: list[bool], whole: list[bool]):
        """Each distinct piece of the chunks is encoded once."""
        seen: dict[str, int] = {}
        number, code, length = seen.setdefault, [], []
        for text, leading in zip(texts, leads):
            found = split(_led(first(text, True), spec) if leading else text if plain else later(text, False))
            code += [number(p, len(seen)) for p in found]
            length.append(len(found))
        ids, sizes, count = encode.many([p.encode() for p in seen])
        code = np.array(code, np.int64)
        pick, ends = _gather(np.maximum(count, 0), code)
        bounds = np.append(0, np.cumsum(length)).astype(np.int64)
        n = np.diff(ends[bounds])
        bad = np.diff(np.append(0, np.cumsum((count < 0)[code]))[bounds]) > 0
        if bad.any():
            pick, n = pick[~np.repeat(bad, n)], np.where(bad, -1, n)
        return ids[pick], sizes[pick], n

    if not cut:
        return chunks.Chunks(work, lambda raw: True)
    if not any(t.content for t in spec.added) or _splits_first(spec):  # texts come split on added tokens
        of_letters = encode.merges and not spec.add_prefix_space and chunks.of_letters(spec.normalizer, stages_of(spec))
        return chunks.Chunks(work, None, many, encode.merges.spans if of_letters else None)
    found = re.compile(b"|".join(re.escape(t.content.encode()) for t in spec.added if t.content)).search

    def mixed(texts: list[str], leads: list[bool], whole: list[bool]):
        if not any(whole):
            return many(texts, leads, whole)
        alone = [work(t, True, True) if w else None for t, w in zip(texts, whole)]
        rest = [k for k, w in enumerate(whole) if not w]
        ids, sizes, n = many([texts[k] for k in rest], [leads[k] for k in rest], [False] * len(rest)) if rest else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64))
        ends = np.append(0, np.cumsum(np.maximum(n, 0)))
        at = dict(zip(rest, range(len(rest))))
        values, lengths, count = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], []
        for k, w in enumerate(whole):
            if w:
                got = alone[k]
                count.append(-1 if got is None else len(got[0]))
                values.append(np.array(got[0] if got else [], np.int32))
                lengths.append(np.array(got[1] if got else [], np.int32))
            else:
                own = slice(ends[at[k]], ends[at[k] + 1])
                count.append(n[at[k]])
                values.append(ids[own])
                lengths.append(sizes[own])
        return np.concatenate(values), np.concatenate(lengths), np.array(count, np.int64)

    return chunks.Chunks(work, found, mixed)


def _splits_first(spec: ModelSpec) -> bool:
    """Whether a text's parts between added tokens are encoded as texts of their own."""
    return bool(spec.added) and not spec.normalizer


class Flat:
    """Texts as flat bytes: a byte is an id, and few merges go over all of them."""

    def __init__(self, spec: ModelSpec):
        self.spec, self.single = spec, batch.single_ids(spec)

    def lists(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        buf, off = buffers(texts)
        ids = self.single[buf]
        bad = np.zeros(len(texts), bool)
        if self.spec.unk_id is None and (ids < 0).any():
            bad = np.diff(np.append(0, np.cumsum(ids < 0))[off]) > 0
        if not self.spec.merges:
            return ids, np.ones(len(ids), np.int32), off, bad
        return *batch.merged_flat(ids, off, self.spec), bad

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, _, bounds, bad = self.lists(texts)
        return np.where(bad, 0, np.diff(bounds)), bad


#: Pretokenizers that leave nothing of a text out.
_WHOLE = {NAMED[n] for n in ("gpt2", "cl100k", "o200k", "voyage", "smollm", "deepseek", "qwen")}
#: Merges that go over flat bytes one by one, at most.
FEW = 64


def by_bytes(spec: ModelSpec) -> bool:
    """Whether texts are worked on as flat bytes: nothing is normalized, and no merge heeds a border of pieces."""
    if not batch.serves(spec) or spec.normalizer or spec.ignore_merges or spec.add_prefix_space or (spec.added and not _splits_first(spec)):
        return False
    own = stages(stages_of(spec))
    return (not own or own in _WHOLE) if not spec.merges else not own and _few(spec)


def _few(spec: ModelSpec) -> bool:
    return not spec.merges or (len(spec.merges) <= FEW and batch.in_order(spec))


def by_text(spec: ModelSpec) -> bool:
    """Whether texts go to Python as they are."""
    return by_bytes(spec) or by_chunks(spec)


def _of_texts(encode: Worker):
    spec = encode.spec
    return chunks.kept(("encode", spec.key), lambda: Flat(spec) if by_bytes(spec) else _encoding_chunks(encode))


def _one_added(spec: ModelSpec):
    """The only added token, where its places can't overlap and it takes nothing with it, so that flat bytes can be searched for it."""
    own = [t for t in spec.added if t.content]
    if len({t.content for t in own}) != 1 or own[0].lstrip or own[0].rstrip:
        return None
    c = own[0].content
    return None if any(c.startswith(c[k:]) for k in range(1, len(c))) else own[0]


@lru_cache(maxsize=1)
def _word_bytes() -> np.ndarray:
    return np.array([c < 128 and (chr(c).isalnum() or chr(c) == "_") for c in range(256)])


def _places(buf: np.ndarray, off: np.ndarray, token) -> tuple[np.ndarray, np.ndarray]:
    """(starts of a token in texts that lie in a row, the text of each)."""
    own = token.content.encode()
    at = np.flatnonzero(buf[: max(0, len(buf) - len(own) + 1)] == own[0])
    for k, byte in enumerate(own[1:], 1):
        at = at[buf[at + k] == byte]
    row = np.searchsorted(off, at, "right") - 1
    keep = at + len(own) <= off[row + 1]
    if token.single_word and len(at):
        first, end, after = off[row], off[row + 1], at + len(own)
        led, followed = at > first, after < end
        before, behind = buf[np.maximum(at - 1, 0)], buf[np.minimum(after, len(buf) - 1)]
        keep &= ~(led & _word_bytes()[before]) & ~(followed & _word_bytes()[behind])
        wordy = lambda c: c.isalnum()
        for k in np.flatnonzero(keep & led & (before >= 0x80)).tolist():
            keep[k] = not wordy(buf[max(first[k], at[k] - 4) : at[k]].tobytes().decode(errors="ignore")[-1])
        for k in np.flatnonzero(keep & followed & (behind >= 0x80)).tolist():
            keep[k] = not wordy(buf[after[k] : min(end[k], after[k] + 4)].tobytes().decode(errors="ignore")[0])
    return at[keep], row[keep]


def _with_one_added(encode: Worker, texts: pa.Array, token) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_with_added`` for one token, over flat bytes."""
    buf, off = buffers(texts)
    at, row = _places(buf, off, token)
    n, nth = len(token.content.encode()), np.arange(len(at))
    rest = np.ones(len(buf), bool)
    for k in range(n):
        rest[at + k] = False
    before = np.searchsorted(at, off)  # of the tokens, those before each text
    heads, marks = np.arange(len(off)) + before, row + 1 + nth  # of the parts, the first of each text, and that behind each token
    starts = np.zeros(len(texts) + len(at) + 1, np.int32)
    starts[heads], starts[marks] = off - n * before, at - n * nth
    parts = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(buf[rest]))
    ids, sizes, bounds, bad = _of_texts(encode).lists(parts)
    ids = np.insert(ids, bounds[marks], token.id)
    sizes = np.insert(sizes, bounds[marks], len(encode.spec.tokens.get(token.id, b"")))
    return ids, sizes, bounds[heads] + before, np.diff(np.append(0, np.cumsum(bad))[heads]) > 0


def _with_added(encode: Worker, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text_lists`` where a text's parts between added tokens are texts of their own."""
    if one := _one_added(encode.spec):
        return _with_one_added(encode, texts, one)
    spec, parts, given, count, norm = encode.spec, [], [], [], N.normalizer(())
    for text in texts.to_pylist():
        found = segments(text, spec, norm) if text else []
        for i, part in found:
            parts.append("" if i is not None else part)
            given.append(-1 if i is None else i)
        count.append(len(found))
    ids, sizes, bounds, bad = _of_texts(encode).lists(pa.array(parts, pa.string()))
    given = np.array(given, np.int32)
    own, last = np.flatnonzero(given >= 0), np.append(0, np.cumsum(count)).astype(np.int64)
    told = np.array([len(spec.tokens.get(i, b"")) for i in given[own].tolist()], np.int32)
    ids, sizes = np.insert(ids, bounds[own], given[own]), np.insert(sizes, bounds[own], told)
    bounds = bounds + np.append(0, np.cumsum(given >= 0))
    return ids, sizes, bounds[last], np.diff(np.append(0, np.cumsum(bad))[last]) > 0


def text_lists(shared, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sizes, bounds by row, null rows) of a column of texts."""
    encode = worker(shared)
    split = _splits_first(encode.spec) and by_text(encode.spec)
    ids, sizes, bounds, bad = _with_added(encode, texts) if split else _of_texts(encode).lists(texts)
    null = np.asarray(texts.is_null()) | bad
    if collapses(encode.spec) and len(ids):
        keep = _without_repeated_unknowns(ids, bounds, encode.spec.unk_id)
        bounds = np.append(0, np.cumsum(keep))[bounds]
        ids, sizes = ids[keep], sizes[keep]
    return ids, sizes, bounds, null


def byte_lists(shared, column: pa.Array) -> pa.Array:
    """The ids of rows of bytes, each one piece; null for a row that can't be encoded."""
    encode = worker(shared)
    spec = encode.spec
    if batch.serves(spec) and not spec.ignore_merges and _few(spec):
        ids, _, bounds, bad = Flat(spec).lists(column)
    else:
        ids, _, count = encode.many([x or b"" for x in column.to_pylist()])
        bounds, bad = np.append(0, np.cumsum(np.maximum(count, 0))), count < 0
    null = np.asarray(column.is_null()) | bad
    if null.any():
        keep = ~np.repeat(null, np.diff(bounds))
        ids, bounds = ids[keep], np.append(0, np.cumsum(np.where(null, 0, np.diff(bounds))))
    return _list_array(pa.array(ids, pa.int32()), bounds, null)


def text_counts(shared, texts: pa.Array) -> pa.Array:
    encode = worker(shared)
    if collapses(encode.spec) or _splits_first(encode.spec):
        _, _, bounds, null = text_lists(shared, texts)
        return pa.array(np.diff(bounds).astype(np.int32), mask=null)
    n, bad = _of_texts(encode).counts(texts)
    return pa.array(n.astype(np.int32), mask=np.asarray(texts.is_null()) | bad)


def ids_of_text(c: Column, spec: ModelSpec) -> Column:
    """A text column as an array of ids."""
    if not by_text(spec):
        return ids_of_pieces(pieces(c, spec), spec)
    shared = share(spec)

    @in_slices("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        ids, _, bounds, null = text_lists(shared, texts)
        if null.any():  # a null row has no ids
            keep = ~np.repeat(null, np.diff(bounds))
            ids, bounds = ids[keep], np.append(0, np.cumsum(np.where(null, 0, np.diff(bounds))))
        return _list_array(pa.array(ids, pa.int32()), bounds, null)

    return run(c)


def count_of_text(c: Column, spec: ModelSpec) -> Column:
    """The number of ids of a text column."""
    if not by_text(spec):
        return count_of_pieces(pieces(c, spec), spec)
    shared = share(spec)

    @in_slices("int")
    def run(texts: pa.Array) -> pa.Array:
        return text_counts(shared, texts)

    return run(c)


def split_text(c: Column, how: str | tuple | None) -> Column:
    """The pieces of a text column, by chunks where the pretokenizer allows it."""
    if not chunks.cuts_at_spaces((), how):
        return native_pieces(c, how)
    reach(SparkSession.active())

    @in_slices("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        def make():
            split = splitter(how)
            return chunks.Texts(lambda t, leads, whole: split(t))

        parts, bounds = chunks.kept(("split", how), make).texts(texts)
        null = np.asarray(texts.is_null())
        return _list_array(pa.concat_arrays(parts) if parts else pa.array([], pa.string()), bounds, null)

    return run(c)


def spans_of_text(shared, text: str) -> list[tuple[int, int, int]]:
    """(id, start, end) of one text's ids, with byte ranges in the normalized text; none if it can't be encoded."""
    encode = worker(shared)
    spec = encode.spec
    out: list[tuple[int, int, int]] = []
    norm, split, at = N.normalizer(spec.normalizer), splitter(stages_of(spec)), 0
    for i, part in segments(text, spec, norm) if spec.added else [(None, norm(text, True))]:
        part = part if i is not None else _led(part, spec)
        raw, inside = part.encode(), 0
        for piece in [part] if i is not None else split(part):
            own = piece.encode()
            inside = max(inside, raw.find(own, inside))
            got = ([i], [len(own)]) if i is not None else encode(own)
            if got is None:
                return []
            a = at + inside
            for k, size in zip(*got):
                if collapses(spec) and out and k == spec.unk_id == out[-1][0]:
                    out[-1] = (k, out[-1][1], a + size)
                else:
                    out.append((k, a, a + size))
                a += size
            inside += len(own)
        at += len(raw)
    return out


_END, _LENGTH = -2, -3


def offsets_of_text(c: Column, spec: ModelSpec) -> Column:
    """Ids with their byte ranges in the normalized text, for a model without added tokens."""
    if not by_chunks(spec):
        return offsets_of_pieces(normalized(c, spec), pieces(c, spec), spec)
    shared = share(spec)

    def make(encode: Worker) -> chunks.Chunks:
        first, later, split = N.normalizer(spec.normalizer), N.normalizer(chunks.later(spec.normalizer)), splitter(stages_of(spec))

        def many(texts: list[str], leads: list[bool], whole: list[bool]):
            """Of each chunk, each id with its start, then its end; at last the length of the chunk."""
            seen: dict[bytes, int] = {}
            number, code, starts, length, ends = seen.setdefault, [], [], [], []
            for text, leading in zip(texts, leads):
                text = _led(first(text, True), spec) if leading else later(text, False)
                raw, at, n = text.encode(), 0, len(code)
                for piece in split(text):
                    own = piece.encode()
                    at = max(at, raw.find(own, at))
                    code.append(number(own, len(seen)))
                    starts.append(at)
                    at += len(own)
                length.append(len(code) - n)
                ends.append(len(raw))
            ids, sizes, count = encode.many(list(seen))
            code, bounds = np.array(code, np.int64), np.append(0, np.cumsum(length)).astype(np.int64)
            pick, to = _gather(np.maximum(count, 0), code)
            size = sizes[pick].astype(np.int64)
            before = np.append(0, np.cumsum(size))
            start = before[:-1] + np.repeat(np.array(starts, np.int64) - before[to[:-1]], np.diff(to))
            n = np.diff(to[bounds])
            bad = np.diff(np.append(0, np.cumsum((count < 0)[code]))[bounds]) > 0
            if bad.any():
                keep = ~np.repeat(bad, n)
                pick, start, size = pick[keep], start[keep], size[keep]
            n = np.where(bad, 0, n)
            stop = np.cumsum(np.where(bad, 0, 2 * n + 1))
            values, places = (np.empty(stop[-1] if len(stop) else 0, np.int32) for _ in range(2))
            chunk = np.repeat(np.cumsum(~bad) - 1, n)
            at = 2 * np.arange(len(pick)) + chunk
            values[at], places[at], values[at + 1], places[at + 1] = ids[pick], start, _END, start + size
            good = stop[~bad] - 1
            values[good], places[good] = _LENGTH, np.array(ends, np.int64)[~bad]
            return values, places, np.where(bad, -1, 2 * n + 1)

        return chunks.Chunks(None, None, many)

    @in_slices(OFFSETS)
    def run(texts: pa.Array) -> pa.Array:
        encode = worker(shared)
        values, places, bounds, bad = chunks.kept(("offsets", encode.spec.key), lambda: make(encode)).lists(texts)
        null = np.asarray(texts.is_null()) | bad
        length = np.where(values == _LENGTH, places, 0).astype(np.int64)
        before = np.append(0, np.cumsum(length))
        base = before[:-1] - np.repeat(before[bounds[:-1]], np.diff(bounds))
        own = values >= 0
        ids, start, end = values[own], (places + base)[own], (places + base)[values == _END]
        bounds = np.append(0, np.cumsum(own))[bounds]
        if null.any():
            keep = ~np.repeat(null, np.diff(bounds))
            ids, start, end, bounds = ids[keep], start[keep], end[keep], np.append(0, np.cumsum(np.where(null, 0, np.diff(bounds))))
        if collapses(encode.spec) and len(ids):
            keep = _without_repeated_unknowns(ids, bounds, encode.spec.unk_id)
            end = np.maximum.reduceat(end, np.flatnonzero(keep))
            ids, start, bounds = ids[keep], start[keep], np.append(0, np.cumsum(keep))[bounds]
        pair = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["start", "end"])
        return pa.StructArray.from_arrays([_list_array(pa.array(ids, pa.int32()), bounds, null), _list_array(pair, bounds, null)], ["ids", "offsets"], mask=pa.array(null))

    return run(c)
