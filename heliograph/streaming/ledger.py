"""A ledger of annotated items, fed by a stream: what was done is known by the stream's own state, not by reading it again.

An item is known by its id and the digest of its contents, so that a new version of a file is annotated anew. Which were seen
is kept in the state store, where looking up a batch's keys costs as much as the batch, however much was written before. An
item that fails comes back by a second stream, of retries, with its next attempt; after ``attempts`` it is a failure. What a
batch writes lies in folders named by the batch, so that a batch that is run again after a crash replaces its own.

    done/epoch=N       annotated items
    retries/epoch=N    items to be tried again by the next start
    failures/epoch=N   items that failed for good
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heliograph.sources.tables import kept

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ("item_id", "sha256")


def annotate_new(spark: SparkSession, source: str, schema: str | StructType, prepare: Callable[[DataFrame], DataFrame], annotate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, attempts: int = 3, key: tuple[str, ...] = KEY, files_a_batch: int = 1_000):
    """Start the stream over what is there, and return it.

    ``prepare`` makes items of the source's rows: ``key``'s columns, valid, and what ``annotate`` needs; that takes items with
    ``attempt`` and returns them with answer and error, of which one is null.
    """
    if attempts < 1:
        raise ValueError("attempts must be positive")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    fresh = prepare(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)).filter("valid").withColumn("attempt", F.lit(1))
    spark.createDataFrame([], fresh.schema).write.mode("append").parquet(f"{out}/retries/epoch=none")  # so that there is something to watch
    again = spark.readStream.schema(fresh.schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{out}/retries/*")
    items = fresh.unionByName(again).dropDuplicates([*key, "attempt"])

    def step(batch: DataFrame, epoch: int) -> None:
        answered = kept(annotate(batch).select(*batch.columns, "answer", "error"))  # nobody is asked twice for a batch's items
        good, bad = answered.filter("error is null"), answered.filter("error is not null")
        good.drop("error").write.mode("overwrite").parquet(f"{out}/done/epoch={epoch}")
        bad.filter(F.col("attempt") < attempts).withColumn("attempt", F.col("attempt") + 1).select(*batch.columns).write.mode("overwrite").parquet(f"{out}/retries/epoch={epoch}")
        bad.filter(F.col("attempt") >= attempts).drop("answer").write.mode("overwrite").parquet(f"{out}/failures/epoch={epoch}")

    return items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, out: str, what: str) -> DataFrame:
    return spark.read.option("basePath", f"{out}/{what}").parquet(f"{out}/{what}/epoch=[0-9]*")


def done(spark: SparkSession, out: str) -> DataFrame:
    """Annotated items, of all versions, with the batch (``epoch``) that they came in."""
    return _read(spark, out, "done")


def failures(spark: SparkSession, out: str) -> DataFrame:
    return _read(spark, out, "failures")


def current(spark: SparkSession, out: str, id: str = "item_id") -> DataFrame:
    """The version of each item that came last."""
    rows = done(spark, out)
    rest = [c for c in rows.columns if c not in (id, "epoch")]
    one = rows.groupBy(id).agg(F.max(F.struct("epoch", *rest)).alias("r"))
    return one.select(id, "r.*")
