"""Rank fusion. The form of all rankings is long: query_id, branch, item_id, score, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Branches in the order in which they are told.
BRANCHES = ("image", "text", "bm25")


def ranked(scored: DataFrame, by: tuple[str, ...] = ("query_id", "branch"), k: int | None = None, digits: int | None = None) -> DataFrame:
    """Rank by score, ties by id; the ``k`` best. Spark prunes to k a partition before the shuffle (window group limit)."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(score.desc(), F.col("item_id"))))
    return out.filter(F.col("rank") <= k) if k is not None else out


def first_of_each(rankings: DataFrame) -> DataFrame:
    """An item counts once a branch, where it stands first; ranks stay as they are."""
    return rankings.groupBy("query_id", "branch", "item_id").agg(F.min(F.struct("rank", "score")).alias("r")).select("query_id", "branch", "item_id", F.col("r.score").alias("score"), F.col("r.rank").alias("rank"))


def compacted(rankings: DataFrame) -> DataFrame:
    """First places only, ranks counted anew from 1: what filters leave behind."""
    return compacted_rows(first_of_each(rankings))


def compacted_rows(rankings: DataFrame) -> DataFrame:
    """Ranks counted anew, of rankings that hold an item once a branch."""
    by = Window.partitionBy("query_id", "branch").orderBy("rank", "item_id")
    return rankings.withColumn("rank", F.row_number().over(by))


def rrf(rankings: DataFrame, k: int = 60, carry: tuple[str, ...] = ()) -> DataFrame:
    """query_id, item_id, fused_score, branch_scores, branch_ranks: sums of 1 / (k + rank).

    ``carry``: columns that depend on query and item alone; rankings that have them hold an item once a branch.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    return _fused(rankings if carry else first_of_each(rankings), F.sum(1.0 / (k + F.col("rank"))), carry)


def min_max(rankings: DataFrame) -> DataFrame:
    """With ``norm``: scores from 0 to 1 in each branch, 1 where all are equal."""
    w = Window.partitionBy("query_id", "branch")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return rankings.withColumn("norm", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def weighted(rankings: DataFrame, weights: dict[str, float], active: tuple[str, ...] = BRANCHES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean of min-max scores; weights of all active branches count, of those without rows too. ``carry`` as in ``rrf``."""
    unknown = set(weights) - set(active)
    if unknown:
        raise ValueError(f"weights of inactive branches: {sorted(unknown)}")
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must be non-negative")
    full = {b: float(weights.get(b, 1.0)) for b in active}
    total = sum(full.values())
    if total <= 0:
        raise ValueError("weights must not be all zero")
    weight = F.create_map(*[F.lit(x) for kv in full.items() for x in kv])[F.col("branch")]
    return _fused(min_max(rankings if carry else first_of_each(rankings)), F.sum(weight * F.col("norm")) / total, carry)


def _fused(rankings: DataFrame, score: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """One aggregation by query and item: no chain of outer joins over branches."""
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("branch", c))))  # noqa: E731  at most one entry a branch
    return rankings.groupBy("query_id", "item_id").agg(score.alias("fused_score"), entries("score").alias("branch_scores"), entries("rank").alias("branch_ranks"), *[F.first(c).alias(c) for c in carry])


def top(fused: DataFrame, n: int, digits: int = 9) -> DataFrame:
    """The n best a query, by score and id. Scores are rounded so that the order of sums decides no tie."""
    return ranked(fused.withColumnRenamed("fused_score", "score"), by=("query_id",), k=n, digits=digits).withColumnRenamed("score", "fused_score")
