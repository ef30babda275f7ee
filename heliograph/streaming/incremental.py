"""Streams: annotation of new files only, and windowed logs with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.sources.tables import kept


def annotate_stream(spark: SparkSession, source: str, schema: str, annotate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Each valid item that the stream hasn't seen yet is annotated, once; failures go aside (``ledger`` tries them again).

    What was seen is the stream's state, so a batch costs the same however much is written. A batch's rows lie in a folder of
    its own, which a batch that is run again after a crash replaces.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        answered = kept(annotate(batch))
        answered.filter("error is null").write.mode("overwrite").json(f"{out}/epoch={epoch}")
        answered.filter("error is not null").write.mode("overwrite").json(f"{out}.failures/epoch={epoch}")

    stream = spark.readStream.schema(schema).parquet(source).filter("valid").dropDuplicates(["item_id"])
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """From (ts, event_type, value), a stream or a table: counts, failures and latencies by window and type."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("slowest")).select(F.col("w.start").alias("start"), "event_type", "n", "total", "slowest")
