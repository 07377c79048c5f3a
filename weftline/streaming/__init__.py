"""Encoding of streams: the same columns, with what needs a whole batch done by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.tokenizer import Tokenizer


def encode_stream(stream: DataFrame, tokenizer: Tokenizer, text: str = "text", out: str = "ids", add_special_tokens: bool = True) -> DataFrame:
    """The stream with ids; row-local, so nothing is kept between batches."""
    return stream.withColumn(out, tokenizer.encode_ids(F.col(text), add_special_tokens))


def count_stream(stream: DataFrame, tokenizer: Tokenizer, by: str, text: str = "text") -> DataFrame:
    """Running numbers of texts and tokens by a column; for ``update`` or ``complete`` mode."""
    return stream.select(F.col(by), tokenizer.count_tokens(F.col(text)).alias("n")).groupBy(by).agg(F.count("*").alias("texts"), F.sum("n").alias("tokens"))


def windowed_counts(stream: DataFrame, tokenizer: Tokenizer, time: str, width: str, late: str, text: str = "text") -> DataFrame:
    """Tokens by event-time window; rows later than ``late`` are dropped, and a window is told once it is over."""
    own = stream.withWatermark(time, late).select(F.col(time), tokenizer.count_tokens(F.col(text)).alias("n"))
    return own.groupBy(F.window(time, width).alias("window")).agg(F.count("*").alias("texts"), F.sum("n").alias("tokens"))


def padded_batches(stream: DataFrame, tokenizer: Tokenizer, write: Callable[[DataFrame, int], None], text: str = "text") -> DataStreamWriter:
    """A writer that pads each micro-batch to its own longest text and gives it to ``write``."""
    return stream.writeStream.foreachBatch(lambda df, k: write(tokenizer.encode_batch(df, text), k))
