"""Nearest neighbours by inverted lists: items lie in cells about centroids, and a query reads the cells near it only.

An index is a table of unit vectors partitioned by cell, with each cell's centroid, size and radius (the greatest angle between
its centroid and an item). Centroids are fitted to a sample of at most SAMPLE_MB; all items are put in cells. Cells are at
most CELLS, so that a query's distances to all centroids are a small matrix.

``search`` is approximate: it reads the ``probes`` cells nearest each query and ranks their items by exact scores. With
``exact`` a second pass reads what can still hold a better item: a cell cannot if even an item at its edge, as near to the
query as the cell's radius allows, scores below the query's k-th so far. ``recall`` and ``tuned`` measure what is missed without.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from heliograph.functions.vectors import l2_normalize
from heliograph.operators.dense import BLOCK, TILE, _best, _matrix, prepared
from heliograph.operators.fusion import ranked
from heliograph.sources.tables import kept

CELLS, SAMPLE_MB, ROUNDS, PER_CELL = 4_096, 64, 10, 64


@dataclass
class Index:
    items: DataFrame  # item_id, vector (unit), cell; partitioned by cell
    centroids: np.ndarray  # a row a cell
    radius: np.ndarray  # in radians; below 0 for a cell without items
    sizes: np.ndarray

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        rows = sorted(spark.read.parquet(f"{path}/cells").collect())  # at most CELLS
        columns = list(zip(*((r["centroid"], r["radius"], r["n"]) for r in rows)))
        return cls(spark.read.parquet(f"{path}/items"), *map(np.array, columns))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, score) of each row, a tile at a time."""
    cell, score = np.empty(len(x), np.int64), np.empty(len(x))
    for lo in range(0, len(x), TILE):
        s = x[lo : lo + TILE] @ centroids.T
        cell[lo : lo + TILE] = s.argmax(axis=1)
        score[lo : lo + TILE] = s.max(axis=1)
    return cell, score


def fitted(sample: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Unit centroids of spherical k-means; cells that lose all rows begin anew at the rows that lie worst."""
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].astype(np.float64)
    for _ in range(ROUNDS):
        cell, score = _nearest(sample, at)
        sums = np.zeros_like(at)
        np.add.at(sums, cell, sample)
        norms = np.linalg.norm(sums, axis=1)
        lost = np.flatnonzero(norms == 0)
        sums[lost], norms[lost] = sample[np.argsort(score, kind="stable")[: len(lost)]], 1.0
        at = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return at


def build(vectors: DataFrame, path: str, cells: int | None = None, seed: int = 0) -> Index:
    """The index of (item_id, vector) in ``path``; about the root of the number of items is the number of cells, if none is given."""
    spark, items = vectors.sparkSession, prepared(vectors)
    n, width = items.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        raise ValueError("no vectors to index")
    cells = min(CELLS, cells or max(1, round(n**0.5)), n)
    wanted = min(n, max(cells, min(PER_CELL * cells, (SAMPLE_MB << 20) // (8 * width))))
    drawn = items if wanted == n else items.sample(fraction=min(1.0, 1.2 * wanted / n), seed=seed)
    sample = np.array([r["vector"] for r in drawn.select("vector").limit(wanted).toLocalIterator()])  # at most SAMPLE_MB
    centroids = fitted(sample, cells, seed)
    shared = spark.sparkContext.broadcast(centroids)  # at most CELLS rows
    kind = items.schema["item_id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, score = _nearest(_matrix(b.column(1), shared.value.shape[1]), shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(np.arccos(np.clip(score, -1, 1)))], names=["item_id", "vector", "cell", "angle"])

    put = items.select("item_id", "vector").mapInArrow(assign, f"item_id {kind}, vector array<double>, cell int, angle double")
    # a cell that holds much lies in several files: rows are dealt by cell and a hash of the id
    put.repartition("cell", F.pmod(F.xxhash64("item_id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/items")
    stored = spark.read.parquet(f"{path}/items").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    every = spark.createDataFrame([(k, [float(v) for v in c]) for k, c in enumerate(centroids)], "cell int, centroid array<double>")
    every.join(stored, "cell", "left").select("cell", "centroid", F.coalesce("radius", F.lit(-1.0)).alias("radius"), F.coalesce("n", F.lit(0)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return Index.load(spark, path)


def _pass(index: Index, ids: list, q: np.ndarray, asked: np.ndarray, k: int, digits: int, query_kind) -> DataFrame:
    """The k best of each query among the items of the cells that it asks (a matrix of queries and cells)."""
    spark, item_kind = index.items.sparkSession, index.items.schema["item_id"].dataType.simpleString()
    schema = f"query_id {query_kind.simpleString()}, item_id {item_kind}, score double"
    touched = np.flatnonzero(asked.any(axis=0)).tolist()
    if not touched:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((ids, q, {c: np.flatnonzero(asked[:, c]) for c in touched}))  # of at most BLOCK queries
    query_type = to_arrow_type(query_kind)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, by = shared.value
        kind, held = None, (np.zeros(0, int), None, np.zeros(0))
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.schema.field(0).type
            names, x, cells = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), q.shape[1]), b.column(2).to_numpy(zero_copy_only=False)
            found = [held] if held[1] is not None else []
            for cell in np.unique(cells):
                rows, who = np.flatnonzero(cells == cell), by[int(cell)]
                for lo in range(0, len(who), TILE):
                    part = who[lo : lo + TILE]
                    score = np.round(q[part] @ x[rows].T, digits)
                    least = np.partition(score, -k, axis=1)[:, -k] if k < score.shape[1] else np.full(len(score), -np.inf)
                    r, c = np.nonzero(score >= least[:, None])
                    found.append((part[r], names[rows[c]], score[r, c]))
            held = _best(*(np.concatenate(p) for p in zip(*found)), k)
        if held[1] is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids, query_type).take(pa.array(held[0])), pa.array(held[1], kind), pa.array(held[2])], names=["query_id", "item_id", "score"])

    return index.items.filter(F.col("cell").isin(touched)).select("item_id", "vector", "cell").mapInArrow(best, schema)


def search(index: Index, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, digits: int = 6) -> DataFrame:
    """query_id, item_id, score, rank: the k best items a query, from (query_id, vector), in the cells read."""
    if probes < 1:
        raise ValueError("probes must be positive")
    spark = index.items.sparkSession
    kind = queries.schema["query_id"].dataType
    held = queries.select("query_id", l2_normalize(F.col("vector")).alias("vector")).filter("vector is not null")
    out = spark.createDataFrame([], f"query_id {kind.simpleString()}, item_id {index.items.schema['item_id'].dataType.simpleString()}, score double")
    blocks = max(1, -(-held.count() // BLOCK))
    for n in range(blocks):
        rows = held.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).collect()
        if not rows:
            continue
        ids, q = [r["query_id"] for r in rows], np.array([r["vector"] for r in rows])
        near = q @ index.centroids.T  # BLOCK times CELLS at most
        full = np.where(index.sizes > 0, near, -np.inf)
        most = min(probes, int((index.sizes > 0).sum()))
        asked = np.zeros(near.shape, bool)
        np.put_along_axis(asked, np.argpartition(-full, most - 1, axis=1)[:, :most], True, axis=1)
        found = _pass(index, ids, q, asked, k, digits, kind)
        if exact:
            first = kept(ranked(found, by=("query_id",), k=k))
            last = {r["query_id"]: r["score"] for r in first.filter(F.col("rank") == k).select("query_id", "score").collect()}  # a number a query
            least = np.array([last.get(i, -np.inf) for i in ids])
            edge = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - index.radius))
            # scores are rounded, and ties go by id: what may reach the k-th counts
            more = ~asked & (index.sizes > 0) & (edge >= least[:, None] - 2 * 10.0**-digits)
            found = first.drop("rank").unionByName(_pass(index, ids, q, more, k, digits, kind))
        out = out.unionByName(found)
    return ranked(out, by=("query_id",), k=k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, recall: the share of the true neighbours that were found."""
    hits = truth.select("query_id", "item_id").join(found.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def tuned(index: Index, queries: DataFrame, k: int, target: float = 0.95) -> tuple[int, float]:
    """(probes, mean recall): the fewest probes, doubled from 1 on, that find ``target`` of the true neighbours of these queries."""
    truth = kept(search(index, queries, k, exact=True))
    probes, most = 1, int((index.sizes > 0).sum())
    while True:
        mean = recall(search(index, queries, k, probes), truth).agg(F.avg("recall")).first()[0]
        if mean is None or mean >= target or probes >= most:
            return probes, 1.0 if mean is None else mean
        probes = min(most, 2 * probes)
