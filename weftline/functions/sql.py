"""The columns as SQL functions and a table function, for one model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import encode as E
from ..spec import ModelSpec
from ..workers import in_batches
from .decode import skipped, text_array


def register(spark: SparkSession, spec: ModelSpec, prefix: str = "tok") -> None:
    """``tok_encode_ids(text)``, ``tok_count(text)``, ``tok_decode(ids)``, ``tok_pieces(text)`` and the table function ``tok_tokens(text)``: (pos, id, token, start, end), with byte ranges in the normalized text.

    In SQL the whole of a function runs in Python, on Arrow batches and by
    distinct chunks where the model allows it.
    """
    shared = E.share(spec)

    @in_batches("array<int>")
    def encode_ids(texts: pa.Array) -> pa.Array:
        ids, _, bounds, null = E.text_lists(shared, texts)
        t = shared.value.template
        if t.added():
            n = np.where(null, 0, np.diff(bounds))
            keep = ~np.repeat(null, np.diff(bounds))
            ids, bounds = ids[keep], np.append(0, np.cumsum(n))
            k = int((~null).sum())
            first, last = bounds[:-1][~null], bounds[1:][~null]
            ids = np.insert(ids, np.append(np.repeat(first, len(t.single_prefix)), np.repeat(last, len(t.single_suffix))), np.append(np.tile(t.single_prefix, k), np.tile(t.single_suffix, k)))
            bounds = np.append(0, np.cumsum(np.where(null, 0, n + t.added())))
        return E._list_array(pa.array(ids, pa.int32()), bounds, null)

    @in_batches("int")
    def count(texts: pa.Array) -> pa.Array:
        return E.text_counts(shared, texts)

    @in_batches("array<string>")
    def pieces(texts: pa.Array) -> pa.Array:
        parts = E.prepared(shared.value)
        return pa.array([None if t is None else [p for _, p in parts(t)] for t in texts.to_pylist()], pa.list_(pa.string()))

    @in_batches("string")
    def decode(ids: pa.Array) -> pa.Array:
        own = shared.value
        return text_array(ids, own, skipped(own))

    @F.udtf(returnType="pos int, id int, token string, start int, end int")
    class Tokens:
        def eval(self, text: str):
            for pos, (i, a, b) in enumerate(E.spans_of_text(shared, text) if text is not None else []):
                yield pos, i, shared.value.tokens[i].decode(errors="replace"), a, b

    for name, f in (("encode_ids", encode_ids), ("count", count), ("pieces", pieces), ("decode", decode)):
        spark.udf.register(f"{prefix}_{name}", f)
    spark.udtf.register(f"{prefix}_tokens", Tokens)
