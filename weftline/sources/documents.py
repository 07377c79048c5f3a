"""Documents in corpus files, split at a separator."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, paths, separator: str = "<|endoftext|>") -> DataFrame:
    """(path, doc_pos, text): the documents of each file in order; empty ones are left out, and none spans files.

    Invalid UTF-8 is repaired.  With an empty separator a file is one document.  A
    missing file is an error.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    if not separator:
        return files.where(F.length("text") > 0).select("path", F.lit(0).alias("doc_pos"), "text")
    parts = F.filter(F.split("text", "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1), lambda x: F.length(x) > 0)
    return files.select("path", F.posexplode(parts).alias("doc_pos", "text"))


def scan_documents(spark: SparkSession, paths, separator: str = "<|endoftext|>") -> DataFrame:
    """(text) of the documents in files that may be larger than a task's memory: files are split among tasks, order is not kept."""
    return spark.read.text(paths, lineSep=separator).where(F.length("value") > 0).select(F.make_valid_utf8("value").alias("text"))


#: A file of at most so many bytes is taken to be one row group, which no scan can share among tasks.
ONE_GROUP = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, of a table of files, over as many tasks as there are cores where it comes in fewer files, each too small to be split; else as it is.

    So at most ``ONE_GROUP`` bytes a core are ever shuffled for this, and a large table never.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    sizes = [(p := path(f)).getFileSystem(conf).getFileStatus(p).getLen() for f in files]
    return df.repartition(cores) if max(sizes) <= ONE_GROUP and sum(sizes) > 1 << 20 else df


_local: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share, in ``spark.checkpoint.dir``; where that is unset, a temporary one, on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return f"{folder.rstrip('/')}/weftline-files"
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        held = tempfile.TemporaryDirectory(prefix="weftline-files-")
        atexit.register(held.cleanup)
        _local.append(f"file://{held.name}")
    return _local[0]
