"""Truncation, templates, padding and masks of id arrays, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import Padding, Template, Truncation


def literal(ids) -> Column:
    return F.array(*[F.lit(int(i)) for i in ids]).cast("array<int>")


def keep(ids: Column, n: Column | int, direction: str = "right") -> Column:
    """At most ``n`` ids; truncation on the right drops the last, on the left the first."""
    n = F.greatest(F.lit(n) if isinstance(n, int) else n, F.lit(0))
    start = F.lit(1) if direction == "right" else F.greatest(F.size(ids) - n, F.lit(0)) + 1
    return F.slice(ids, start, n)


def truncate(ids: Column, t: Truncation, specials: int = 0) -> Column:
    return keep(ids, max(0, t.max_length - specials), t.direction)


def pair_lengths(a: Column, b: Column, budget: int, strategy: str) -> tuple[Column, Column]:
    """The lengths to which a pair of lengths is cut.

    ``longest_first`` cuts the longer down to the shorter, and then both in turn, the
    first before the second.
    """
    m = F.lit(max(0, budget))
    over = F.greatest(a + b - m, F.lit(0))
    if strategy == "only_first":
        return F.greatest(a - over, F.lit(0)), b
    if strategy == "only_second":
        return a, F.greatest(b - over, F.lit(0))
    least = F.least(a, b)
    one = F.floor(m / 2).cast("int")
    fits, room = over == 0, least * 2 <= m
    return F.when(fits, a).when(room, F.when(a >= b, m - b).otherwise(a)).otherwise(one), F.when(fits, b).when(room, F.when(a >= b, b).otherwise(m - a)).otherwise(m - one)


def truncate_pair(a: Column, b: Column, t: Truncation, specials: int = 0) -> tuple[Column, Column]:
    la, lb = pair_lengths(F.size(a), F.size(b), t.max_length - specials, t.strategy)
    return keep(a, la, t.direction), keep(b, lb, t.direction)


def single(ids: Column, t: Template) -> Column:
    return F.concat(literal(t.single_prefix), ids, literal(t.single_suffix)) if t.single_prefix or t.single_suffix else ids


def pair(a: Column, b: Column, t: Template) -> Column:
    return F.concat(literal(t.pair_a_prefix), a, literal(t.pair_a_suffix), literal(t.pair_b_prefix), b, literal(t.pair_b_suffix))


def repeated(value: int, n: Column, kind: str = "tinyint") -> Column:
    return F.array_repeat(F.lit(value).cast(kind), F.greatest(n, F.lit(0)))


def pair_types(a: Column, b: Column, t: Template) -> Column:
    """0 for the first text with its specials, 1 for the second with its."""
    return F.concat(repeated(0, F.size(a) + len(t.pair_a_prefix) + len(t.pair_a_suffix)), repeated(1, F.size(b) + len(t.pair_b_prefix) + len(t.pair_b_suffix)))


def attention_mask(ids: Column) -> Column:
    return F.when(ids.isNotNull(), repeated(1, F.size(ids)))


def type_ids(ids: Column) -> Column:
    return F.when(ids.isNotNull(), repeated(0, F.size(ids)))


def special_tokens_mask(ids: Column, specials) -> Column:
    """1 where an id is one of ``specials``, in the content too."""
    own = literal(specials)
    return F.transform(ids, lambda x: F.array_contains(own, x).cast("tinyint"))


def pad(values: Column, target: Column | int, filler: Column, direction: str = "right") -> Column:
    """An array with ``filler`` up to ``target`` elements; a longer one stays."""
    more = F.array_repeat(filler, F.greatest((F.lit(target) if isinstance(target, int) else target) - F.size(values), F.lit(0)))
    return F.concat(values, more) if direction == "right" else F.concat(more, values)


def rounded(n: Column, multiple: int | None) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("int") if multiple and multiple > 1 else n


ENCODING = "struct<ids: array<int>, attention_mask: array<tinyint>, type_ids: array<tinyint>, offsets: array<struct<start: int, end: int>>>"


def encoding(ids: Column, types: Column | None = None, offsets: Column | None = None) -> Column:
    """The arrays of one encoding; null where the ids are."""
    none = F.array().cast("array<struct<start: int, end: int>>")
    return F.when(ids.isNotNull(), F.struct(ids.alias("ids"), attention_mask(ids).alias("attention_mask"), (type_ids(ids) if types is None else types).alias("type_ids"), (none if offsets is None else offsets).alias("offsets")))


def pad_encoding(e: Column, p: Padding, target: Column | int) -> Column:
    """An encoding padded to ``target``: mask 0, offsets (0, 0) where there are offsets."""
    tiny = lambda v: F.lit(v).cast("tinyint")
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    padded = F.struct(
        pad(e["ids"], target, F.lit(p.pad_id), p.direction).alias("ids"), pad(e["attention_mask"], target, tiny(0), p.direction).alias("attention_mask"), pad(e["type_ids"], target, tiny(p.pad_type_id), p.direction).alias("type_ids"),
        F.when(F.size(e["offsets"]) == 0, e["offsets"]).otherwise(pad(e["offsets"], target, zero, p.direction)).alias("offsets"),
    )
    return F.when(e.isNotNull(), padded)
