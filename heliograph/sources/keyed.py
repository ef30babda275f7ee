"""Tables of facts by key that grow by whole batches: what was found out once is looked up, not found out again.

A table is a folder of batches, each dealt over buckets of keys. A batch is written aside and put in place by one rename, so
that it is there whole or not at all, and is named by the work that made it: the same work done again replaces its own batch.
Of a key in several batches the last one counts. A lookup reads only the buckets that its keys fall into.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class KeyedTable:
    """``schema`` is DDL of keys and values; ``buckets`` is fixed with the first batch."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: str
    buckets: int = 64

    def __post_init__(self):
        self.columns = self.spark.createDataFrame([], self.schema).columns
        if lacking := set(self.keys) - set(self.columns):
            raise ValueError(f"keys that the schema lacks: {sorted(lacking)}")
        if "batch" in self.columns or "bucket" in self.columns:
            raise ValueError("batch and bucket are names of the table's own")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path
        root = p(self.path)
        return p, root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Names of the batches in place, the oldest first."""
        _, root, fs = self._fs()
        if not fs.exists(root):
            return []
        return sorted(n.removeprefix("batch=") for n in (s.getPath().getName() for s in fs.listStatus(root)) if n.startswith("batch="))

    def rows(self) -> DataFrame:
        """All rows of all batches, with ``batch`` and ``bucket``."""
        shape = f"{self.schema}, batch string, bucket int"
        if not self.batches():
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(self.path)

    def _latest(self, rows: DataFrame) -> DataFrame:
        values = [c for c in self.columns if c not in self.keys]
        one = rows.groupBy(*self.keys).agg(F.max(F.struct("batch", *values)).alias("_r"))
        return one.select(*self.keys, *[F.col("_r")[c].alias(c) for c in values]).select(*self.columns)

    def read(self) -> DataFrame:
        """A row a key."""
        return self._latest(self.rows())

    def lookup(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows of the wanted keys that the table has, the keys that it lacks)."""
        keys = wanted.select(*self.keys).dropna().distinct().withColumn("bucket", self._bucket())
        touched = [r[0] for r in keys.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        near = self.rows().filter(F.col("bucket").isin(touched)) if touched else self.rows().limit(0)
        found = self._latest(near.join(keys, [*self.keys, "bucket"], "left_semi"))
        return found, keys.drop("bucket").join(found.select(*self.keys), list(self.keys), "left_anti")

    def upsert(self, rows: DataFrame, work: str) -> None:
        """Put ``rows`` in place as the batch of ``work``; of rows that share a key one counts, rows without a key none.

        A batch that the same work left before is replaced, in its place among the others.
        """
        p, root, fs = self._fs()
        have = self.batches()
        name = next((b for b in have if b.split("-", 1)[1] == work), f"{1 + max((int(b.split('-', 1)[0]) for b in have), default=0):08d}-{work}")
        values = [c for c in self.columns if c not in self.keys]
        one = rows.dropna(subset=list(self.keys)).groupBy(*self.keys).agg(F.max(F.struct(*values)).alias("_r")).select(*self.keys, "_r.*")
        aside = p(root, f".{uuid.uuid4().hex}")
        one.select(*self.columns).withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(str(aside))
        self._place(aside, p(root, f"batch={name}"), fs)

    def _place(self, aside, target, fs) -> None:
        if fs.exists(target):
            fs.delete(target, True)
        if not fs.rename(aside, target):
            raise OSError(f"can't put {target} in place")

    def compact(self) -> None:
        """One batch in place of all; readers see the same rows throughout."""
        have = self.batches()
        if len(have) < 2:
            return
        p, root, fs = self._fs()
        aside = p(root, f".{uuid.uuid4().hex}")
        self.read().withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(str(aside))
        last = have[-1].split("-", 1)[0]
        self._place(aside, p(root, f"batch={int(last):08d}-{uuid.uuid4().hex}"), fs)  # as old as the last one, and the same
        for b in have:
            fs.delete(p(root, f"batch={b}"), True)
