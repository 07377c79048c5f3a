"""The tokenizer: a model with columns and tables to encode, decode, count and look up."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, decode
from ..names import fresh
from ..sources.documents import read_documents, scan_documents
from ..spec import ModelSpec, Padding
from ..workers import in_slices
from . import encode as E


class Tokenizer:
    """All methods take and return columns or tables; a null text or array gives null."""

    def __init__(self, spec: ModelSpec):
        self.spec = spec

    # stages

    def normalize(self, text: Column) -> Column:
        return E.normalized(text, self.spec)

    def pieces(self, text: Column) -> Column:
        return E.pieces(text, self.spec)

    def raw_ids(self, text: Column) -> Column:
        """Ids without specials or truncation."""
        return E.ids_of_text(text, self.spec)

    # documents

    def encode_ids(self, text: Column, add_special_tokens: bool = True) -> Column:
        """Ids with truncation and specials, never padded."""
        ids = self.raw_ids(text)
        if self.spec.truncation:
            ids = arrays.truncate(ids, self.spec.truncation, self.spec.template.added() if add_special_tokens else 0)
        return arrays.single(ids, self.spec.template) if add_special_tokens else ids

    def _fixed(self, e: Column) -> Column:
        p = self.spec.padding
        return arrays.pad_encoding(e, p, p.length) if p and p.length is not None else e

    def encode(self, text: Column, add_special_tokens: bool = True) -> Column:
        """Ids, masks and type ids; padding to a fixed length only, as to the longest is a matter of a batch."""
        return self._fixed(arrays.encoding(self.encode_ids(text, add_special_tokens)))

    def encode_with_offsets(self, text: Column, add_special_tokens: bool = True) -> Column:
        """With byte ranges in the normalized text; added tokens aren't looked for, and specials have (0, 0)."""
        plain = ModelSpec(**{k: getattr(self.spec, k) for k in ModelSpec.__dataclass_fields__ if k != "added"})
        both = E.offsets_of_text(text, plain)
        t, zero = self.spec.template, F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
        ids, offsets = both["ids"], both["offsets"]
        if self.spec.truncation:
            ids, offsets = (arrays.truncate(x, self.spec.truncation, t.added() if add_special_tokens else 0) for x in (ids, offsets))
        if add_special_tokens and t.added():
            ids, offsets = arrays.single(ids, t), F.concat(F.array_repeat(zero, len(t.single_prefix)), offsets, F.array_repeat(zero, len(t.single_suffix)))
        return self._fixed(arrays.encoding(ids, None, offsets))

    def encode_pair(self, a: Column, b: Column, add_special_tokens: bool = True) -> Column:
        """Two texts as one encoding, never padded."""
        a, b, t = self.raw_ids(a), self.raw_ids(b), self.spec.template
        if self.spec.truncation:
            a, b = arrays.truncate_pair(a, b, self.spec.truncation, t.added(True) if add_special_tokens else 0)
        if not add_special_tokens:
            return arrays.encoding(F.concat(a, b), F.concat(arrays.repeated(0, F.size(a)), arrays.repeated(1, F.size(b))))
        return arrays.encoding(arrays.pair(a, b, t), arrays.pair_types(a, b, t))

    def encode_bytes(self, data: Column) -> Column:
        """Raw bytes through the encoder alone."""
        shared = E.share(self.spec)

        @in_slices("array<int>")
        def run(column: pa.Array) -> pa.Array:
            return E.byte_lists(shared, column)

        return run(data)

    # counts

    def count_tokens(self, text: Column) -> Column:
        """Without specials or truncation."""
        return E.count_of_text(text, self.spec)

    def exceeds(self, text: Column, limit: int) -> Column:
        """Whether a text has more than ``limit`` ids."""
        return self.count_tokens(text) > limit

    def compare_count(self, text: Column, limit: int) -> Column:
        """-1, 0 or 1 as a text has fewer than, as many as or more than ``limit`` ids."""
        n = self.count_tokens(text)
        return F.signum(n - limit).cast("int")

    # back

    def decode(self, ids: Column, skip_special_tokens: bool | None = None) -> Column:
        return decode.decode(ids, self.spec, skip_special_tokens)

    def decode_bytes(self, ids: Column) -> Column:
        return decode.decode_bytes(ids, self.spec)

    def tokens(self, ids: Column) -> Column:
        return decode.token_strings(ids, self.spec)

    def special_tokens_mask(self, ids: Column) -> Column:
        return arrays.special_tokens_mask(ids, self.spec.template.specials)

    # vocabulary

    def vocab(self) -> DataFrame:
        """(id, token, token_str, n_bytes, score, special)."""
        return SparkSession.active().createDataFrame(self.spec.vocab_rows(), "id int, token binary, token_str string, n_bytes int, score double, special boolean")

    def merges(self) -> DataFrame:
        rows = [(k, *m) for k, m in enumerate(self.spec.merges)]
        return SparkSession.active().createDataFrame(rows, "rank int, left int, right int, merged int")

    def token_to_id(self, df: DataFrame, token: str = "token", out: str = "id") -> DataFrame:
        """``df`` with the id of its token column, the highest of tokens that look alike, or null."""
        (key,) = fresh(df, "token_str")
        known = self.vocab().groupBy(F.col("token_str").alias(key)).agg(F.max("id").alias(out))
        return df.join(F.broadcast(known), F.col(f"`{token}`") == F.col(key), "left").drop(key)

    def id_to_token(self, df: DataFrame, ids: str = "id", out: str = "token_str") -> DataFrame:
        """``df`` with the token of its id column, or null."""
        (key,) = fresh(df, "known")
        known = self.vocab().select(F.col("id").alias(key), F.col("token_str").alias(out))
        return df.join(F.broadcast(known), F.col(f"`{ids}`") == F.col(key), "left").drop(key)

    def adjacent(self, df: DataFrame, left: str = "left", right: str = "right", out: str = "valid") -> DataFrame:
        """``df`` with whether two ids may stand side by side: no merge rule joins them."""
        a, b, rule = fresh(df, "a", "b", "rule")
        rules = self.merges().select(F.col("left").alias(a), F.col("right").alias(b), F.lit(True).alias(rule)).distinct()
        joined = df.join(F.broadcast(rules), (F.col(f"`{left}`") == F.col(a)) & (F.col(f"`{right}`") == F.col(b)), "left")
        return joined.withColumn(out, F.col(rule).isNull()).drop(a, b, rule)

    # tables

    def encode_batch(self, df: DataFrame, text: str = "text", out: str = "encoding", add_special_tokens: bool = True, batch: Sequence[str] = ()) -> DataFrame:
        """``df`` with encodings, padded to the longest of all, or of each group of the columns ``batch``.

        The longest is an aggregate of the texts' counts, for which no ids are made,
        joined back as one row, or one for each group.
        """
        p, t = self.spec.padding, self.spec.template
        done = df.withColumn(out, arrays.encoding(self.encode_ids(F.col(f"`{text}`"), add_special_tokens)))
        if not p:
            return done
        if p.length is not None:
            return done.withColumn(out, arrays.pad_encoding(F.col(out), p, arrays.rounded(F.lit(p.length), p.pad_to_multiple_of)))
        (target,) = fresh(done, "target")
        more = t.added() if add_special_tokens else 0
        n = self.count_tokens(F.col(f"`{text}`"))
        if self.spec.truncation:
            n = F.least(n, F.lit(max(0, self.spec.truncation.max_length - more)))
        if batch:
            keys = fresh(done, *(f"by_{k}" for k in range(len(batch))))
            longest = df.groupBy(*[F.col(f"`{c}`").alias(k) for c, k in zip(batch, keys)]).agg(F.max(n + more).alias(target))
            same = [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip(batch, keys)]
            done = done.join(longest, reduce(and_, same), "left").drop(*keys)
        else:
            done = done.crossJoin(F.broadcast(df.agg(F.max(n + more).alias(target))))
        return done.withColumn(out, arrays.pad_encoding(F.col(out), p, arrays.rounded(F.col(target), p.pad_to_multiple_of))).drop(target)

    def encode_batch_flat(self, df: DataFrame, key: str, text: str = "text", add_special_tokens: bool = True) -> DataFrame:
        """(key, ids, n, start): with the place of each row's ids if all rows' ids lie in a row, by key.

        Rows with a null key come first; those of one key lie in the order of
        their ids' hashes.  A null text has null ids, and n 0.
        """
        done = df.select(F.col(f"`{key}`"), self.encode_ids(F.col(f"`{text}`"), add_special_tokens).alias("ids")).withColumn("n", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint"))
        return with_starts(done, key, tie="ids")

    def encode_files(self, spark: SparkSession, paths, separator: str = "<|endoftext|>", add_special_tokens: bool = False) -> DataFrame:
        """(path, doc_pos, ids) of the documents in files, each file read by one task."""
        return read_documents(spark, paths, separator).select("path", "doc_pos", self.encode_ids(F.col("text"), add_special_tokens).alias("ids"))

    def encode_files_flat(self, spark: SparkSession, paths, separator: str = "<|endoftext|>", add_special_tokens: bool = False) -> DataFrame:
        """(path, doc_pos, ids, n, start): with the place of each document's ids among those of all files, in the order of their paths."""
        done = self.encode_files(spark, paths, separator, add_special_tokens)
        return with_starts(done.select(F.struct("path", "doc_pos").alias("key"), "ids", F.size("ids").cast("bigint").alias("n")), "key").select("key.path", "key.doc_pos", "ids", "n", "start")

    def count_tokens_files(self, spark: SparkSession, paths, separator: str = "<|endoftext|>") -> DataFrame:
        """One row: the number of documents and tokens in files; with a separator, files are split among tasks."""
        read = scan_documents if separator else read_documents
        n = read(spark, paths, separator).select(self.count_tokens(F.col("text")).alias("n"))
        return n.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))

    def stream_tokens(self, df: DataFrame, text: str = "text", add_special_tokens: bool = False) -> DataFrame:
        """A row for each id: the columns of ``df`` but the text, pos and id."""
        kept = [F.col(f"`{c}`") for c in df.columns if c != text]
        return df.select(*kept, F.posexplode(self.encode_ids(F.col(f"`{text}`"), add_special_tokens)).alias("pos", "id"))

    def stream_bytes(self, df: DataFrame, data: str = "content") -> DataFrame:
        """A row for each id of raw bytes: the columns of ``df`` but the bytes, pos and id."""
        kept = [F.col(f"`{c}`") for c in df.columns if c != data]
        return df.select(*kept, F.posexplode(self.encode_bytes(F.col(f"`{data}`"))).alias("pos", "id"))

    def encode_any(self, text: Column, pair: Column | None = None, add_special_tokens: bool = True) -> Column:
        """The encoding of one text, or of two as a pair; where the second is null, of the first alone."""
        if pair is None:
            return self.encode(text, add_special_tokens)
        return F.when(pair.isNull(), self.encode(text, add_special_tokens)).otherwise(self.encode_pair(text, pair, add_special_tokens))

    def with_padding(self, padding: Padding | None = None, **options) -> Tokenizer:
        return Tokenizer(self.spec.with_padding(padding, **options))

    def with_truncation(self, truncation=None, **options) -> Tokenizer:
        return Tokenizer(self.spec.with_truncation(truncation, **options))


def with_starts(df: DataFrame, key: str, tie: str | None = None, ranges: int = 64) -> DataFrame:
    """``df`` (with ``n``) and ``start``, the sum of n over the rows before, by key; null keys come first.

    Any type that can be ordered will do.  Keys are put in ``ranges`` between bounds
    drawn from keys of the least hashes; sums of ranges come first, then those
    inside each range, so no task sees all rows.  Rows of one key are in one
    range, in the order of the hash of ``tie`` if given; keys are thought to be
    mostly distinct.
    """
    where, before, hashed = fresh(df, "range", "before", "hash")
    k = F.col(f"`{key}`")
    drawn = df.select(k.alias("k")).where("k is not null").distinct().orderBy(F.xxhash64("k")).limit(ranges * 32).agg(F.array_sort(F.collect_list("k")).alias("all"))
    bounds = drawn.select(F.expr(f"filter(all, (x, i) -> i % 32 = 31)").alias(before))
    placed = df.crossJoin(F.broadcast(bounds)).withColumn(where, F.when(k.isNull(), -1).otherwise(F.size(F.filter(before, lambda x: x <= k)))).drop(before)
    placed = placed.withColumn(hashed, F.xxhash64(F.col(tie)) if tie else F.lit(0).cast("bigint")).repartition(F.col(where))
    # the same columns are read on both sides, so that the rows are made and shuffled once: a count of what is never null, or that nothing asks for, would go
    own = [F.count_if(F.xxhash64(F.col(f"`{c}`")) != 0).alias(f"c{i}") for i, c in enumerate(x for x in placed.columns if x not in ("n", where))]
    sums = placed.groupBy(where).agg(F.sum("n").alias("n"), *own)
    sums = sums.where(reduce(add, [F.col(f"c{i}") for i in range(len(own))]) >= 0).select(F.col(where).alias(hashed), (F.sum("n").over(Window.orderBy(where)) - F.col("n")).alias(before))
    own = F.sum("n").over(Window.partitionBy(where).orderBy(k, hashed).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    done = placed.withColumn("start", own).drop(hashed)
    return done.join(F.broadcast(sums), F.col(where) == F.col(hashed)).withColumn("start", F.col("start") + F.col(before)).drop(where, before, hashed)
