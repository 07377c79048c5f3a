"""Comparing two tokenizations of a text, and whole models over a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.buffers import buffers
from ..spec import ModelSpec
from ..workers import in_slices
from .encode import _flat, share

_TOKEN = "struct<id: int, start: int, end: int, text: string>"
DIFF = f"struct<text_bytes: int, tokens_a: int, tokens_b: int, diff_count: int, diff_bytes: int, match_rate: double, truncated: boolean, regions: array<struct<start: int, end: int, text: string, a: array<{_TOKEN}>, b: array<{_TOKEN}>>>>"

_NAMES = ["text_bytes", "tokens_a", "tokens_b", "diff_count", "diff_bytes", "match_rate", "truncated", "regions"]


def is_identical(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def first_difference(a: Column, b: Column) -> Column:
    """The first index at which two arrays differ, the shorter's length if one begins the other; null if they are equal."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True) - 1
    return F.when(at >= 0, at.cast("int"))


class Spans:
    """Rows of ids with their byte ranges in each row's text; an id that isn't known is as long as what is shown for it."""

    def __init__(self, column: pa.Array, tokens: dict[int, bytes]):
        ids, self.bounds, _ = _flat(column)
        self.ids = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        one, self.code = np.unique(self.ids, return_inverse=True)
        shown = [tokens.get(i, f"<unk:{i}>".encode()) for i in one.tolist()]
        size = np.fromiter(map(len, shown), np.int64, len(shown))[self.code]
        self.shown = pa.array([t.decode(errors="replace") for t in shown], pa.string())
        ends = np.append(0, np.cumsum(size))
        self.length = np.diff(ends[self.bounds])
        self.end = ends[1:] - np.repeat(ends[self.bounds[:-1]], np.diff(self.bounds))
        self.start = self.end - size

    def told(self, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """The tokens of ranges of tokens, as lists."""
        n = b - a
        stop = np.append(0, np.cumsum(n))
        at = np.repeat(a - stop[:-1], n) + np.arange(stop[-1])
        told = [pa.array(v[at], pa.int32()) for v in (self.ids, self.start, self.end)]
        return pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.StructArray.from_arrays([*told, self.shown.take(pa.array(self.code[at]))], ["id", "start", "end", "text"]))


def regions(a: Spans, b: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What lies between tokens that both have in the same place: (row, range of tokens of the one, of the other)."""
    n = len(a.length)
    base = np.append(0, np.cumsum(np.maximum(a.length, b.length) + 1))
    key = [np.repeat(base[:-1], np.diff(s.bounds)) + s.start for s in (a, b)]
    kept = [np.flatnonzero(s.end > s.start) for s in (a, b)]
    there = np.full(base[-1], -1, np.int64)
    there[key[1][kept[1]]] = kept[1]
    x = kept[0]
    y = there[key[0][x]]
    x, y = x[y >= 0], y[y >= 0]
    same = (a.ids[x] == b.ids[y]) & (a.end[x] == b.end[y])
    x, y = x[same], y[same]
    before = np.searchsorted(x, a.bounds)  # the common tokens before each row
    first, last = before[:-1] + np.arange(n), before[1:] + np.arange(n)
    begins, ends = np.ones((2, len(x) + n), bool)
    begins[first], ends[last] = False, False
    out = [np.repeat(np.arange(n), np.diff(before) + 1)]
    for s, common in ((a, x), (b, y)):
        p, p_end = np.empty((2, len(begins)), np.int64)
        p[first], p[begins], p_end[last], p_end[ends] = s.bounds[:-1], common + 1, s.bounds[1:], common
        out += [p, p_end]
    some = (out[2] > out[1]) | (out[4] > out[3])
    return tuple(v[some] for v in out)


def _parts(texts: pa.Array, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte ranges of texts as texts, invalid UTF-8 repaired."""
    buf, off = buffers(texts)
    a, b = (np.minimum(off[row] + v, off[row + 1]) for v in (start, end))
    stop = np.append(0, np.cumsum(b - a))
    raw = buf[np.repeat(a - stop[:-1], b - a) + np.arange(stop[-1])]
    parts = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(stop.astype(np.int32)), pa.py_buffer(raw)])
    try:
        return parts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode(errors="replace") for x in parts.to_pylist()], pa.string())


def compared(texts: pa.Array, xs: pa.Array, ys: pa.Array, ta: dict[int, bytes], tb: dict[int, bytes], limit: int) -> pa.Array:
    """``diff`` of columns, on their flat arrays."""
    good = np.asarray(texts.is_valid()) & np.asarray(xs.is_valid()) & np.asarray(ys.is_valid())
    if not good.all():
        own = pa.array(np.flatnonzero(good))
        return compared(*(c.take(own) for c in (texts, xs, ys)), ta, tb, limit).take(pa.array(np.cumsum(good) - 1, pa.int64(), mask=~good))
    n, a, b = len(texts), Spans(xs, ta), Spans(ys, tb)
    row, p, p_end, q, q_end = regions(a, b)
    far = np.iinfo(np.int64).max
    at = lambda v, k, there, none: np.where(there, np.append(v, none)[np.where(there, k, -1)], none)
    start = np.minimum(at(a.start, p, p_end > p, far), at(b.start, q, q_end > q, far))
    end = np.maximum(at(a.end, p_end - 1, p_end > p, -1), at(b.end, q_end - 1, q_end > q, -1))
    first = np.searchsorted(row, np.arange(n + 1))
    count, size = np.diff(first), np.diff(np.append(0, np.cumsum(end - start))[first])
    listed = np.arange(len(row)) - first[row] < limit
    row, p, p_end, q, q_end, start, end = (v[listed] for v in (row, p, p_end, q, q_end, start, end))
    found = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), _parts(texts, row, start, end), a.told(p, p_end), b.told(q, q_end)], ["start", "end", "text", "a", "b"])
    length = np.diff(buffers(texts)[1])
    rate = np.where(length > 0, 1 - size / np.maximum(length, 1), 1.0)
    whole = [pa.array(v, pa.int32()) for v in (length, np.diff(a.bounds), np.diff(b.bounds), count, size)]
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), found)
    return pa.StructArray.from_arrays([*whole, pa.array(rate), pa.array(count > limit), lists], _NAMES)


def diff(text: Column, a: Column, b: Column, model_a: ModelSpec, model_b: ModelSpec, limit: int = 100) -> Column:
    """A summary of two id arrays of one text and their first ``limit`` differing regions; null where one of the three is.

    The counts are of all regions; ``truncated`` tells that not all are listed.
    """
    left, right = share(model_a), share(model_b)
    kind = to_arrow_type(T._parse_datatype_string(DIFF))

    @in_slices(DIFF)
    def run(texts: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
        return compared(texts, xs, ys, left.value.tokens, right.value.tokens, limit).cast(kind)

    return run(text, a, b)


def verify(df: DataFrame, text: Column, a: Column, b: Column) -> DataFrame:
    """One row: how many texts two tokenizations agree on, and how many they don't."""
    same = is_identical(a, b)
    return df.select(text.alias("t"), same.alias("same"), F.size(a).alias("n")).agg(F.count("*").alias("texts"), F.count_if("same").alias("passed"), F.count_if(~F.col("same")).alias("failed"), F.sum("n").alias("tokens"))


def mismatches(df: DataFrame, key: str, text: Column, a: Column, b: Column, limit: int = 5) -> DataFrame:
    """The first few texts, by ``key``, that two tokenizations disagree on."""
    rows = df.select(F.col(key), text.alias("text"), a.alias("a"), b.alias("b"))
    return rows.where(~F.col("a").eqNullSafe(F.col("b"))).select(key, "text", first_difference(F.col("a"), F.col("b")).alias("at"), "a", "b").orderBy(key).limit(limit)
