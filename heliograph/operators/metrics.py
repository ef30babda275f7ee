"""Retrieval metrics over a ranking (query_id, item_id, rank) and judgments (query_id, item_id, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(ranking: DataFrame, judged: DataFrame, ks: tuple[int, ...] = (1, 5, 10), ndcg_at: int = 10) -> DataFrame:
    """A row for each judged query: recall_k, mrr, ap, ndcg. A query without results scores 0 everywhere.

    Ranks are those of the ranking with each item's first place only. The ideal gain is over all judgments; average
    precision divides by all relevant items.
    """
    first = ranking.groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("grade"), "item_id")
    ideal = judged.withColumn("_r", F.row_number().over(by_query)).groupBy("query_id").agg(
        F.count_if(F.col("grade") > 0).alias("relevant"),
        F.sum(F.when(F.col("_r") <= ndcg_at, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("_r") + 1.0))).alias("ideal"),
    )
    hits = first.join(judged.filter("grade > 0"), ["query_id", "item_id"])
    seen = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    found = hits.withColumn("_seen", seen).groupBy("query_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks],
        F.min("rank").alias("first"),
        F.sum(F.col("_seen") / F.col("rank")).alias("precision"),
        F.sum(F.when(F.col("rank") <= ndcg_at, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0))).alias("dcg"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0.0)) / F.col(b)).otherwise(0.0)
    return ideal.join(found, "query_id", "left").select(
        "query_id", *[ratio(f"hits_{k}", "relevant").alias(f"recall_{k}") for k in ks], F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), ratio("precision", "relevant").alias("ap"), ratio("dcg", "ideal").alias("ndcg")
    )


def summary(details: DataFrame, category: str, metrics: list[str], latency: str | None = None, success: str | None = None) -> DataFrame:
    """Overall (scope 'overall') and by category, in one pass of grouping sets: means, exact percentiles and failures."""
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics]]
    if latency:
        aggs += [F.avg(latency).alias("latency_mean"), F.percentile(latency, 0.5).alias("latency_p50"), F.percentile(latency, 0.95).alias("latency_p95")]
    if success:
        aggs += [F.count_if(~F.col(success)).alias("failures"), (F.count_if(~F.col(success)) / F.count(F.lit(1))).alias("failure_rate")]
    grouped = details.rollup(category).agg(F.grouping_id().alias("_g"), *aggs)
    return grouped.select(F.when(F.col("_g") == 1, "overall").otherwise("category").alias("scope"), F.col(category).alias("category"), *[c for c in grouped.columns if c not in ("_g", category)])


def overlap(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Of two rankings a query: shared items over those of either (at most k), and the mean shift of shared ranks.

    Without a shared item the shift is the length of the longer list.
    """
    a, b = (x.filter(F.col("rank") <= k).select("query_id", "item_id", F.col("rank").alias(n)) for x, n in ((left, "a"), (right, "b")))
    both = a.join(b, ["query_id", "item_id"], "full").groupBy("query_id").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count(F.lit(1)).alias("either"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("shift"), F.greatest(F.count("a"), F.count("b")).alias("longer"))
    return both.select("query_id", (F.col("shared") / F.greatest(F.lit(1), F.least(F.lit(k), "either"))).alias("overlap"), F.coalesce("shift", F.col("longer").cast("double")).alias("rank_shift"))


def overlap_summary(per_query_: DataFrame, category: str = "category") -> DataFrame:
    """Overall and by category: queries, mean overlap and mean rank shift, and the mean latencies that there are."""
    latencies = [c for c in per_query_.columns if c.endswith("latency")]
    return summary(per_query_, category, ["overlap", "rank_shift", *latencies])


def by_variant(rankings: DataFrame, judged: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Of rankings with ``variant``: variant, n and the mean of each metric over all judged queries; one plan for all variants."""
    variants = rankings.select("variant").distinct()
    keyed = lambda df: df.withColumn("query_id", F.struct("variant", "query_id")).drop("variant")
    # variants are a short list
    every = per_query(keyed(rankings), keyed(judged.crossJoin(F.broadcast(variants))), ks)
    names = [c for c in every.columns if c != "query_id"]
    return every.groupBy(F.col("query_id.variant").alias("variant")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in names])
