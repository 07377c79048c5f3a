"""Ids back to bytes and text, by flat gathers from the vocabulary."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column

from ..operators.encode import share
from ..spec import ModelSpec
from ..workers import in_slices

MARK = "▁"


def _bytes_of(spec: ModelSpec) -> dict[int, bytes]:
    """Tokens as bytes; ``<0xNN>`` is its byte where the model falls back to bytes."""
    if not spec.byte_fallback:
        return spec.tokens
    return {i: bytes([int(t[3:5], 16)]) if len(t) == 6 and t[:3] == b"<0x" and t[5:] == b">" else t for i, t in spec.tokens.items()}


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bounds of each row's, whether each row is null) of a column of id arrays; a null id is -1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    null = np.asarray(column.is_null())
    n = np.where(null, 0, np.diff(column.offsets.to_numpy()))
    ids = column.flatten()
    ids = (ids.fill_null(-1) if ids.null_count else ids).to_numpy(zero_copy_only=False)
    return ids if ids.dtype == np.int32 else ids.astype(np.int64), np.append(0, np.cumsum(n)), null


class Pool:
    """Tokens by id, as an Arrow array with a null at the end for unknown ids."""

    def __init__(self, tokens: dict[int, bytes | str], kind: pa.DataType):
        self.size = max(tokens, default=-1) + 1
        table: list = [None] * (self.size + 1)
        for i, t in tokens.items():
            table[i] = t
        self.values = pa.array(table, kind)
        self.known = np.asarray(self.values.is_valid())

    def take(self, ids: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(the ids' tokens, whether each is known)."""
        at = np.minimum(ids.view(np.uint32 if ids.dtype == np.int32 else np.uint64), self.size)  # a negative id is beyond the end
        return self.values.take(pa.array(at)), self.known[at]


@lru_cache(maxsize=8)
def _pool(key: str, form: str) -> Pool:
    return _pools[key](form)


_pools: dict[str, object] = {}


def pool(spec: ModelSpec, form: str) -> Pool:
    """This process's pool of a model: ``bytes``, ``text``, or ``words`` with a space before each word's beginning."""

    def make(form: str) -> Pool:
        if form == "bytes":
            return Pool(_bytes_of(spec), pa.binary())
        text = {i: t.decode(errors="replace") for i, t in spec.tokens.items()}
        if form == "words":
            p = spec.continuing_prefix
            text = {i: t[len(p) :] if t.startswith(p) else " " + t for i, t in text.items()}
        return Pool(text, pa.string())

    _pools[spec.key] = make
    return _pool(spec.key, form)


def _kept(keep: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The bounds of rows of which only some values are kept."""
    return np.append(0, np.cumsum(keep))[bounds]


def _decodable(values: pa.Array, known: np.ndarray, bounds: np.ndarray, null: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(values, bounds, whether each row is null): a row with an unknown id is null, and has no values."""
    if known.all():
        return values, bounds, null
    bad = null | (np.diff(_kept(~known, bounds)) > 0)
    keep = ~np.repeat(bad, np.diff(bounds))
    return values.filter(pa.array(keep)), _kept(keep, bounds), bad


def _joined(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The values of each row, one after the other: their bytes stay where they are.  No value is null."""
    _, off, data = values.buffers()
    if not len(values):
        return pa.array([b"" if pa.types.is_binary(values.type) else ""] * (len(bounds) - 1), values.type)
    off = np.frombuffer(off, np.int32)[values.offset :]
    return pa.Array.from_buffers(values.type, len(bounds) - 1, [None, pa.py_buffer(off[bounds]), data or pa.py_buffer(b"")])


def _unless(column: pa.Array, null: np.ndarray) -> pa.Array:
    return pc.if_else(pa.array(~null), column, None) if null.any() else column


def bytes_array(column: pa.Array, spec: ModelSpec) -> pa.Array:
    """The ids' bytes, one after the other; null if an id is unknown."""
    ids, bounds, null = flat(column)
    values, bounds, bad = _decodable(*pool(spec, "bytes").take(ids), bounds, null)
    return _unless(_joined(values, bounds), bad)


def decode_bytes(ids: Column, spec: ModelSpec) -> Column:
    """The ids' bytes, one after the other; null if an id is unknown."""
    shared = share(spec)

    @in_slices("binary")
    def run(column: pa.Array) -> pa.Array:
        return bytes_array(column, shared.value)

    return run(ids)


def _as_text(raw: pa.Array) -> pa.Array:
    """UTF-8 bytes as text; null where they aren't valid."""
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:

        def one(x: bytes | None) -> str | None:
            try:
                return x if x is None else x.decode()
            except UnicodeDecodeError:
                return None

        return pa.array([one(x) for x in raw.to_pylist()], pa.string())


def text_array(column: pa.Array, spec: ModelSpec, skip: frozenset[int]) -> pa.Array:
    """The rows' texts; null if an id is unknown or the bytes aren't UTF-8."""
    ids, bounds, null = flat(column)
    if skip:
        keep = ~np.isin(ids, np.fromiter(skip, np.int64))
        ids, bounds = ids[keep], _kept(keep, bounds)
    form = "words" if spec.decoder == "wordpiece" else "bytes" if spec.decoder == "byte_level" or spec.byte_fallback else "text"
    values, bounds, bad = _decodable(*pool(spec, form).take(ids), bounds, null)
    out = _joined(values, bounds)
    if spec.decoder == "byte_level":
        if spec.word_end:
            out = pc.binary_join_element_wise(out, b"", b"")
            out = pc.replace_substring(_as_text(out), spec.word_end, " ")
            out = pc.utf8_rtrim(out, " ")
        else:
            out = _as_text(out)
        return _unless(out, bad)
    if form == "bytes":
        out = _as_text(out)
    if spec.decoder != "wordpiece":
        out = pc.replace_substring(out, MARK, " ")
    # the space before the first word goes
    return _unless(pc.if_else(pc.starts_with(out, " "), pc.utf8_slice_codeunits(out, 1), out), bad)


def skipped(spec: ModelSpec, skip_special_tokens: bool | None = None) -> frozenset[int]:
    """The ids that decoding leaves out.

    By default those of the template, but none by byte-level models; True leaves
    out all special tokens, False none.
    """
    if skip_special_tokens is None:
        return frozenset(spec.template.specials) if spec.decoder != "byte_level" else frozenset()
    return frozenset(spec.template.specials) | {t.id for t in spec.added if t.special} if skip_special_tokens else frozenset()


def decode(ids: Column, spec: ModelSpec, skip_special_tokens: bool | None = None) -> Column:
    """The text of an id array, without the ids that ``skipped`` tells."""
    shared, skip = share(spec), skipped(spec, skip_special_tokens)

    @in_slices("string")
    def run(column: pa.Array) -> pa.Array:
        return text_array(column, shared.value, skip)

    return run(ids)


def token_strings(ids: Column, spec: ModelSpec) -> Column:
    """Each id's token as text, invalid UTF-8 repaired; null for an unknown id."""
    shared = share(spec)

    @in_slices("array<string>")
    def run(column: pa.Array) -> pa.Array:
        own, bounds, null = flat(column)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pool(shared.value, "text").take(own)[0], mask=pa.array(null))

    return run(ids)
