"""Encoding by distinct pieces: each is encoded once in the whole cluster, and joined back.

For models whose pieces cost much (Unigram, long merges) on corpora whose pieces
repeat.  Counts need no reassembly.  The row-local plan of ``operators.encode``
gives the same ids without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import encode as E
from ..spec import ModelSpec

def _exploded(df: DataFrame, spec: ModelSpec, key: str, text: str) -> DataFrame:
    if spec.added:
        raise ValueError("pieces with added tokens go by the row-local plan")
    return df.select(F.col(key).alias("key"), F.posexplode(E.pieces(F.col(text), spec)).alias("pos", "piece"))


def piece_ids(pieces: DataFrame, spec: ModelSpec) -> DataFrame:
    """(piece, ids) of distinct pieces."""
    return pieces.select("piece").distinct().withColumn("ids", E.ids_of_pieces(F.array("piece"), spec))


def count_by_key(df: DataFrame, spec: ModelSpec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) of all rows with a text; repeated pieces of a row are counted before the join."""
    if E.collapses(spec):
        raise ValueError("unknowns that run together over pieces go by the row-local plan")
    own = _exploded(df, spec, key, text).groupBy("key", "piece").agg(F.count("*").alias("times"))
    sizes = piece_ids(own, spec).select("piece", F.size("ids").alias("n"))
    n = own.join(sizes, "piece").groupBy("key").agg(F.sum(F.col("times") * F.col("n")).alias("n_tokens"))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key")).distinct()
    return rows.join(n, "key", "left").select(F.col("key").alias(key), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def encode_by_key(df: DataFrame, spec: ModelSpec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of all rows with a text; keys must not repeat."""
    own = _exploded(df, spec, key, text)
    joined = own.join(piece_ids(own, spec), "piece")
    ids = joined.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))
    if E.collapses(spec):
        unk = F.lit(spec.unk_id)
        ids = ids.withColumn("ids", F.filter("ids", lambda x, i: ~((x == unk) & (i > 0) & (F.get("ids", i - 1) == unk))))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"))
    return rows.join(ids, "key", "left").select(F.col("key").alias(key), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def piece_counts(df: DataFrame, spec: ModelSpec, text: str = "text") -> DataFrame:
    """(piece, n): how often each piece occurs, in all texts."""
    return df.select(F.explode(E.pieces(F.col(text), spec)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def token_counts(df: DataFrame, spec: ModelSpec, text: str = "text") -> DataFrame:
    """(id, n): how often each id occurs; the pieces are counted first, so that each is encoded once."""
    counted = piece_counts(df, spec, text)
    return counted.select(F.explode(E.ids_of_pieces(F.array("piece"), spec)).alias("id"), "n").groupBy("id").agg(F.sum("n").alias("n"))
