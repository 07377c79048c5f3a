"""Python workers' access to this package, and what they hold at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf

_ROOT = str(Path(__file__).resolve().parent.parent)

#: Bytes of a batch's columns that a worker looks at together; a larger row goes alone.
STEP = 1 << 20


def reach(spark: SparkSession) -> None:
    """Puts this package's folder on the path of the session's Python workers.

    Enough where executors see the folder (one machine, a shared file system);
    elsewhere install the package or ship it with ``--py-files``.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if _ROOT not in paths:
        environment["PYTHONPATH"] = ":".join(p for p in [*paths, _ROOT] if p)


def _row_bytes(column: pa.Array) -> np.ndarray:
    kind = column.type
    if pa.types.is_list(kind):
        values = column.flatten()
        return np.diff(column.offsets.to_numpy()) * (values.nbytes / max(1, len(values)))
    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        if not len(column) or column.buffers()[1] is None:
            return np.zeros(len(column), np.int64)
        return np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64))
    return np.full(len(column), column.nbytes / max(1, len(column)))


def sliced(columns: tuple[pa.Array, ...], step: int | None = None) -> Iterator[tuple[pa.Array, ...]]:
    """The columns in runs of rows of about ``step`` bytes; no row is cut."""
    columns = tuple(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns)
    ends, step = np.cumsum(sum(_row_bytes(c) for c in columns)), step or STEP
    a, n = 0, len(columns[0])
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, "right")))
        yield tuple(c.slice(a, b - a) for c in columns)
        a = b


def in_slices(kind: str) -> Callable[[Callable], Callable]:
    """An Arrow function of columns, called on slices of each batch, whose results are sent off one by one.

    So a worker holds the results of ``STEP`` bytes, not those of a batch of many rows.
    """

    def wrap(f: Callable[..., pa.Array]) -> Callable:
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for columns in batches:
                for own in sliced(columns if isinstance(columns, tuple) else (columns,)):
                    yield f(*own)

        return arrow_udf(run, kind)

    return wrap


def in_batches(kind: str) -> Callable[[Callable], Callable]:
    """The same for columns that are asked for together: they stay in one worker, which puts a batch's results in a row."""

    def wrap(f: Callable[..., pa.Array]) -> Callable:
        def run(*columns: pa.Array) -> pa.Array:
            return pa.concat_arrays([f(*own) for own in sliced(columns)] or [f(*columns)])

        return arrow_udf(run, kind)

    return wrap
