"""Folders on shared storage, by Hadoop's file systems: a path with a scheme is copied to or from a local folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def is_remote(path: str | Path) -> bool:
    return "://" in str(path)


def _there(path: str):
    spark = SparkSession.active()
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm.org.apache.hadoop.fs.Path


def put(local: Path, path: str) -> None:
    """Copies a local folder to its place; written beside it first, and then renamed."""
    system, where, to_path = _there(path)
    beside = to_path(f"{path.rstrip('/')}.writing")
    system.delete(beside, True)
    system.copyFromLocalFile(False, True, to_path(f"file://{local}"), beside)
    system.delete(where, True)
    if not system.rename(beside, where):
        raise OSError(f"{path} could not be written")


@contextmanager
def fetched(path: str) -> Iterator[Path]:
    """A local copy of a folder or file for as long as it is looked at."""
    system, where, to_path = _there(path)
    with tempfile.TemporaryDirectory(prefix="weftline-fetch-") as folder:
        target = Path(folder) / where.getName()
        system.copyToLocalFile(False, where, to_path(f"file://{target}"), True)
        yield target
