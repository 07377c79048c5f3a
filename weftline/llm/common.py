"""Spark helpers of the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..names import fresh as fresh
from ..workers import reach


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; where unset, a temporary one, on one machine (``local[...]``) only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _local:
        held = tempfile.TemporaryDirectory(prefix="weftline-")
        atexit.register(held.cleanup)
        _local.append(f"file://{held.name}")
    return _local[0]


def _place(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


#: Paths of the tables that are there, in the order of writing.
_written: dict[str, DataFrame] = {}


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder, which survives the loss of executors; deleted by ``free``, or when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weftline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, where = _place(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _written[path] = out
    out._weftline_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote; what is still to be computed from them can't be."""
    for df in tables:
        system, where = _place(df.sparkSession, df._weftline_path)
        system.delete(where, True)
        _written.pop(df._weftline_path, None)


@contextmanager
def freeing() -> Iterator[Callable[[DataFrame], None]]:
    """Within it, ``done(table)`` frees what ``cut`` has written since it began, but for ``table``."""
    before = set(_written)

    def done(table: DataFrame) -> None:
        free(*[t for path, t in list(_written.items()) if path not in before and t is not table])

    yield done


def pick(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """Only the named columns, cast, under the operator's own names, so that no other column can clash."""
    return df.select(*[F.col(f"`{source}`").cast(kind).alias(name) for name, (source, kind) in columns.items()])


def documents_in(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pick(df, doc_id=(id_col, "bigint"), text=(text_col, "string"))


def arrow_map(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with a generator of dicts of columns."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches):
        arrow = to_arrow_schema(kind)
        for columns in rows(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for x, f in ((columns[f.name], f) for f in arrow)], schema=arrow)

    reach(df.sparkSession)
    return df.mapInArrow(run, kind)


def lists(values, bounds, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
