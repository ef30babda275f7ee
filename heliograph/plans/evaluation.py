"""Evaluation of searches: guarded, by query, by category, and by variant of a search."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.operators import dense, judging, metrics
from heliograph.plans.search import Searcher
from heliograph.sources import tables
from heliograph.sources.tables import kept

METRICS = ("recall_1", "recall_5", "recall_10", "mrr", "ap", "ndcg")


def evaluate(ranking: DataFrame, queries: DataFrame, judged: DataFrame, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(details by query, summary overall and by category).

    From a ranking (query_id, item_id, rank), queries (query_id, text, category, reviewed) and judgments (query_id, item_id,
    grade). ``runs`` has latency and success of each query; a query that failed has no results. Queries that may not be
    evaluated are refused.
    """
    judging.refuse(queries, judged)
    if runs is not None:
        ranking = ranking.join(runs.filter(~F.col("success")).select("query_id"), "query_id", "left_anti")
    details = queries.select("query_id", "text", "category").join(metrics.per_query(ranking, judged), "query_id", "left").fillna(0.0, list(METRICS))
    if runs is None:
        return details, metrics.summary(details, "category", list(METRICS))
    details = details.join(runs.select("query_id", "latency", "success"), "query_id", "left")
    return details, metrics.summary(details, "category", list(METRICS), "latency", "success")


def ablation(searcher: Searcher, queries: DataFrame, judged: DataFrame, weights: dict[str, float], candidates: int = 50, results: int = 30) -> DataFrame:
    """variant, fusion_method, branches, n and the mean metrics: each branch alone, all by rank, all by weight."""
    rankings = searcher.ablation(queries, candidates, results, weights).select("variant", "query_id", "item_id", "rank")
    rankings = searcher.keep(rankings) if searcher.keep else rankings
    asked = judged.join(queries.select("query_id"), "query_id", "left_semi")
    out = metrics.by_variant(rankings, asked)
    active = searcher.active()
    branches = F.when(F.col("variant").isin("rrf", "weighted"), F.lit(",".join(active))).otherwise(F.col("variant"))
    return out.withColumn("fusion_method", F.when(F.col("variant") == "weighted", "weighted").otherwise("rrf")).withColumn("branches", branches)


def compared_fusion(searcher: Searcher, queries: DataFrame, weights: dict[str, float], candidates: int = 50, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """(overlap and rank shift of both fusion methods by query, summary overall and by category), from one recall."""
    both = searcher.ablation(queries, candidates, k, weights, branches=False)
    both = searcher.keep(both) if searcher.keep else both
    per = metrics.overlap(both.filter("variant = 'rrf'"), both.filter("variant = 'weighted'"), k)
    category = F.coalesce("category", F.lit("unknown")) if "category" in queries.columns else F.lit("unknown")
    per = per.join(queries.select("query_id", category.alias("category")), "query_id")
    return per, metrics.overlap_summary(per)


def compared_encoders(branches: dict[str, Callable[[DataFrame, int], DataFrame]], queries: DataFrame, k: int = 10) -> tuple[list[dict], DataFrame]:
    """(a row an encoder: cold and warm seconds of the same queries; overlap and rank shift by query of each with the first one).

    Branches search the same items by vectors of different encoders. Each is run twice; the second run is the warm one.
    """
    asked, runs, found = kept(queries), [], {}
    n = asked.count()
    for name, search in branches.items():
        took = []
        for _ in range(2):
            began = time.perf_counter()
            found[name] = kept(search(asked, k).select("query_id", "item_id", "rank"))
            took.append(time.perf_counter() - began)
        runs.append({"encoder": name, "queries": n, "cold_seconds": took[0], "warm_seconds": took[1], "warm_seconds_a_query": took[1] / max(1, n)})
    first, *others = found
    out = metrics.overlap(found[first], found[first], k).withColumn("encoder", F.lit(first))
    for name in others:
        out = out.unionByName(metrics.overlap(found[first], found[name], k).withColumn("encoder", F.lit(name)))
    return runs, out


def encoder_costs(items: DataFrame, queries: DataFrame, encoders: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]], path: str, k: int = 5, batch: dict[str, int] | None = None, clock=time.perf_counter) -> dict:
    """What encoders cost on the same items and queries: a report with a row an encoder.

    Each is a pair of functions, from (item_id, ...) to (item_id, vector), and from (query_id, ...) to (query_id, vector). Its index
    is built and written under ``path``; counted are the seconds of that, items a second, the bytes of the files written, the
    dimension, and the seconds of the queries after an unmeasured one. All must index the same ids. The report makes no claim
    about quality: no judgment is looked at.
    """
    spark, ids = items.sparkSession, kept(items.select("item_id"))
    n, asked = ids.count(), kept(queries)
    wanted = asked.count()
    if not n or not wanted or not encoders:
        raise ValueError("items, queries and encoders are needed")
    rows, heads = [], []
    for name, (encode, encode_query) in encoders.items():
        began = clock()
        dense.save(encode(items), f"{path}/{name}", model=name, kind="image")
        built = clock() - began
        stored = dense.load(spark, f"{path}/{name}", name)
        met = stored.select("item_id", F.lit(1).alias("a")).join(ids.select("item_id", F.lit(1).alias("b")), "item_id", "full")
        if not met.filter("a is null or b is null").isEmpty():
            raise ValueError(f"{name} doesn't index the same items as the others")
        dense.search(stored, encode_query(asked.limit(1)), k).count()  # not measured
        began = clock()
        found = kept(dense.search(stored, encode_query(asked), k))
        took = clock() - began
        heads.append(found.select(F.lit(name).alias("encoder"), "query_id", "rank", "item_id", "score"))
        dimension = stored.select(F.size("vector").alias("d")).first()["d"]
        rows.append({"encoder": name, "items": n, "batch_size": (batch or {}).get(name), "dimension": dimension, "build_seconds": built, "items_per_second": n / built if built else None, "index_bytes": tables.fingerprint(spark, f"{path}/{name}/vectors")[1], "queries": wanted, "mean_warm_query_seconds": took / wanted})
    top = heads[0]
    for h in heads[1:]:
        top = top.unionByName(h)
    return {"encoders": rows, "items": n, "has_relevance_judgments": False, "quality_claim_allowed": False, "note": "costs only; quality needs judgments by people", "top": top}
