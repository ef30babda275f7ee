"""Tables that a job writes for itself: read more than once, and kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir; where that is unset, one of this machine in local mode, else an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: a folder that all executors share is needed")
        root = tempfile.mkdtemp(prefix="tables-")
    return f"{root}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table: what reads it doesn't run its plan again, and a lost executor loses nothing."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read, over as many tasks as there are cores if its files give it fewer: a small file is one task's.

    Not for what a shuffle made, which would run for its partitions to be known.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def fingerprint(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """(path, bytes, time of the last change) of a file or folder: tells whether what was made from it still holds."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return path, fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()
