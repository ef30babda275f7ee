"""Shared helpers: what outlives an executor lies in the shared folder, and joins survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A salted task holds about 1 / HOT_SHARE of all rows, but not under LEAST_ROWS; keys with more are hot. So there are at
#: most HOT_SHARE hot keys, and at most twice as many salted ones.
HOT_SHARE, LEAST_ROWS = 10_000, 2_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine in local mode, else an error."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: a folder that all executors share is needed")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: written as Parquet in the shared folder, and read from there.

    Unlike a checkpoint's, the plan that goes on knows the table's size and carries none of the constraints before it, of
    which loops would gather ever more.
    """
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder: its partitions stay as they are.

    For tables of many rows a step whose work is worth as many tasks again; a Parquet table of the same bytes is read by few.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_keys(counted: DataFrame, key: str, n: str) -> list[tuple]:
    """(key, salts) of the hot keys of ``counted`` (a row a key, with its count ``n``); at most HOT_SHARE of them."""
    total, most = counted.filter(F.col(key).isNotNull()).agg(F.sum(n), F.max(n)).first()
    unit = max(LEAST_ROWS, -(-(total or 0) // HOT_SHARE))
    if not most or most <= unit:
        return []
    found = counted.filter((F.col(n) > unit) & F.col(key).isNotNull())
    return [tuple(r) for r in found.select(key, F.ceil(F.col(n) / unit).cast("int")).collect()]


def salted_join(many: DataFrame, one: DataFrame, key: str, hot: list[tuple], how: str = "inner", spread: str | None = None) -> DataFrame:
    """Join ``many`` with ``one`` (one row a key) on ``key``; rows of the ``hot`` keys are dealt over their salts.

    Without hot keys it is a plain join. ``spread`` names the column of ``many`` whose hash deals its rows; by default
    all its columns count.
    """
    if not hot:
        return many.join(one, key, how)
    kind = dict(many.dtypes)[key]
    salts = F.broadcast(many.sparkSession.createDataFrame(hot, f"`{key}` {kind}, _salts int"))  # at most HOT_SHARE rows
    by = [F.col(spread)] if spread else [F.col(c) for c in many.columns if not c.startswith("_")]
    left = many.join(salts, key, "left").withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*by), F.col("_salts").cast("long")).cast("int")).otherwise(F.lit(0))).drop("_salts")
    right = one.join(salts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def fresh(df: DataFrame, name: str) -> str:
    """A name for a column that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
