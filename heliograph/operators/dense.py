"""Exact nearest neighbours by inner product, by blocks of queries against all items; vector indexes as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from heliograph.functions.vectors import is_sound, l2_normalize
from heliograph.operators.fusion import ranked

#: Queries held in a task, and those that meet a batch at a time.
BLOCK, TILE = 10_000, 500


def prepared(vectors: DataFrame, id: str = "item_id", vector: str = "vector") -> DataFrame:
    """item_id and unit vector; rows whose vector isn't sound are left out (see ``unsound``)."""
    return vectors.select(F.col(id).alias("item_id"), l2_normalize(F.col(vector)).alias("vector")).filter(F.col("vector").isNotNull())


def unsound(vectors: DataFrame, id: str = "item_id", vector: str = "vector") -> DataFrame:
    """What is wrong with an index's input: unsound vectors, repeated ids, lengths that differ from the most common one."""
    bad = vectors.filter(~F.coalesce(is_sound(F.col(vector)), F.lit(False))).select(F.col(id).alias("item_id"), F.lit("unsound vector").alias("error"))
    twice = vectors.groupBy(F.col(id).alias("item_id")).count().filter("count > 1").select("item_id", F.lit("repeated id").alias("error"))
    sizes = vectors.groupBy(F.size(vector).alias("s")).count().orderBy(F.desc("count"), "s").limit(1)
    odd = vectors.join(F.broadcast(sizes), F.size(vector) != F.col("s")).select(F.col(id).alias("item_id"), F.lit("length").alias("error"))  # one row
    return bad.unionByName(twice).unionByName(odd)


def save(vectors: DataFrame, path: str, model: str = "", kind: str = "text") -> None:
    """A vector index in ``path``: unit vectors, and one row of metadata. Unsound input is refused, and so is none."""
    first = unsound(vectors).orderBy("item_id").limit(3).collect()
    if first:
        raise ValueError(f"unsound vectors: {[tuple(r) for r in first]}")
    prepared(vectors).write.mode("overwrite").parquet(f"{path}/vectors")
    stored = vectors.sparkSession.read.parquet(f"{path}/vectors")
    n, dimension = stored.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        raise ValueError("no vectors to index")
    vectors.sparkSession.createDataFrame([(kind, model, n, dimension, "inner_product")], "kind string, model string, n long, dimension int, metric string").write.mode("overwrite").json(f"{path}/metadata")


def load(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """Prepared items of a saved index. Its rows must be as many as its metadata says, and its model the one expected."""
    told = spark.read.schema("kind string, model string, n long, dimension int, metric string").json(f"{path}/metadata").first()
    items = spark.read.parquet(f"{path}/vectors")
    if items.count() != told["n"]:
        raise ValueError(f"{path} doesn't hold {told['n']} vectors")
    if model is not None and told["model"] != model:
        raise ValueError(f"{path} was made by {told['model']!r}, not {model!r}")
    return items


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, read from Arrow's buffer."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    if (np.diff(offsets) != width).any():
        raise ValueError(f"vectors and queries differ in dimensions: {sorted(set(np.diff(offsets).tolist()) | {width})}")
    return flat[offsets[0] : offsets[-1]].reshape(len(column), width)


def _best(query: np.ndarray, name: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (query, name, score): the k best of each query, by score and name."""
    place = np.unique(name, return_inverse=True)[1]
    order = np.lexsort((place, -score, query))
    q = query[order]
    first = np.searchsorted(q, q)
    order = order[np.arange(len(q)) - first < k]
    return query[order], name[order], score[order]


def search(items: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best items a query: query_id, item_id, score, rank, from prepared items and (query_id, vector).

    Each task multiplies batches of items with a block of queries and keeps k rows a query, so what is shuffled is k
    rows a query and task, whatever the corpus holds. Items are read once for every BLOCK queries.
    """
    spark, out = items.sparkSession, None
    held = queries.select("query_id", l2_normalize(F.col("vector")).alias("vector")).filter("vector is not null")
    blocks = max(1, -(-held.count() // BLOCK))
    kinds = queries.schema["query_id"].dataType, items.schema["item_id"].dataType
    schema = f"query_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, score double"
    query_type = to_arrow_type(kinds[0])
    for n in range(blocks):
        rows = held.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in rows], np.array([r["vector"] for r in rows])))  # BLOCK queries

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            kind, held = None, (np.zeros(0, int), None, np.zeros(0))
            for b in batches:
                if not b.num_rows:
                    continue
                kind = b.schema.field(0).type
                names, x = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), q.shape[1])
                found = [held] if held[1] is not None else []
                for lo in range(0, len(q), TILE):
                    score = np.round(q[lo : lo + TILE] @ x.T, digits)
                    least = np.partition(score, -k, axis=1)[:, -k] if k < score.shape[1] else np.full(len(score), -np.inf)
                    r, c = np.nonzero(score >= least[:, None])  # ties with the k-th too
                    found.append((r + lo, names[c], score[r, c]))
                held = _best(*(np.concatenate(part) for part in zip(*found)), k)
            if held[1] is not None:
                yield pa.RecordBatch.from_arrays([pa.array(ids, query_type).take(pa.array(held[0])), pa.array(held[1], kind), pa.array(held[2])], names=["query_id", "item_id", "score"])

        one = items.select("item_id", "vector").mapInArrow(best, schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], schema)
    return ranked(out, by=("query_id",), k=k)
