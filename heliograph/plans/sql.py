"""Search and metrics in SQL text: views and table functions of a session.

``register`` makes, under a prefix of the caller's,

    rankings                                    what recall found and filters left, a row a query, branch and item
    hybrid_search(results, rrf_k)               fused by rank
    weighted_search(w_image, w_text, w_bm25, results)
                                                fused by min-max scores and weights
    ranking_metrics(TABLE(...) PARTITION BY query_id)
                                                of rows (query_id, rank, grade): recall_1, recall_5, recall_10, mrr, ap, ndcg

so that ``spark.sql("SELECT * FROM hybrid_search(results => 10)")`` is what ``Searcher.search`` gives. Functions are SQL, and are
planned with the query around them; only the metrics, which go along a query's ranking, are Python, with a few numbers for
state. All are temporary: they go with the session.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from heliograph.operators.fusion import BRANCHES
from heliograph.plans.search import Searcher

METRICS = "query_id {0}, recall_1 double, recall_5 double, recall_10 double, mrr double, ap double, ndcg double"


class RankingMetrics:
    """A query's judged items, in any order: rank is null for those that weren't found; unjudged items don't matter."""

    def __init__(self):
        self.query, self.grades, self.hits = None, [], []

    def eval(self, row):
        self.query = row["query_id"]
        if row["grade"] is None:
            return
        self.grades = sorted([*self.grades, row["grade"]], reverse=True)[:10] if len(self.grades) < 10 or row["grade"] > self.grades[-1] else self.grades
        self.relevant = getattr(self, "relevant", 0) + (row["grade"] > 0)
        if row["rank"] is not None and row["grade"] > 0:
            self.hits.append((row["rank"], row["grade"]))

    def terminate(self):
        if not self.grades:
            return
        hits, gain = sorted(self.hits), lambda grade, place: (2**grade - 1) / math.log2(place + 1)
        n = self.relevant
        ideal = sum(gain(g, k) for k, g in enumerate(self.grades, 1))
        yield (
            self.query, *((sum(r <= k for r, _ in hits) / n if n else 0.0) for k in (1, 5, 10)), 1 / hits[0][0] if hits else 0.0,
            sum(k / r for k, (r, _) in enumerate(hits, 1)) / n if n else 0.0, sum(gain(g, r) for r, g in hits if r <= 10) / ideal if ideal else 0.0,
        )


def register_metrics(spark: SparkSession, kind: str = "long", prefix: str = "") -> None:
    """``ranking_metrics``, for queries whose ids are of this type."""
    spark.udtf.register(f"{prefix}ranking_metrics", udtf(RankingMetrics, returnType=METRICS.format(kind)))


def register(searcher: Searcher, queries: DataFrame, candidates: int = 50, prefix: str = "") -> None:
    """The views and functions over a searcher's recall for these (parsed) queries."""
    spark = queries.sparkSession
    found = searcher.compacted(searcher.decided(searcher.recall(queries, candidates), queries))
    found.createOrReplaceTempView(f"{prefix}rankings")
    kinds = dict(found.dtypes)
    shape = f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, rank INT, fused_score DOUBLE"
    best = "SELECT query_id, item_id, rank, fused_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused_score, {digits}) DESC, item_id) AS rank FROM ({fused})) WHERE rank <= {name}.results"
    name = f"{prefix}hybrid_search"
    summed = "SELECT query_id, item_id, sum(part) AS fused_score FROM ({parts}) GROUP BY query_id, item_id"  # arguments stay outside of the sum
    fused = summed.format(parts=f"SELECT query_id, item_id, 1.0D / ({name}.rrf_k + rank) AS part FROM {prefix}rankings")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(results INT DEFAULT 30, rrf_k INT DEFAULT 60) RETURNS TABLE ({shape}) RETURN {best.format(digits=9, fused=fused, name=name)}")
    name = f"{prefix}weighted_search"
    active = searcher.active()
    weight = "CASE branch " + " ".join(f"WHEN '{b}' THEN {name}.w_{b}" for b in BRANCHES) + " ELSE 1.0D END"
    total = " + ".join(f"{name}.w_{b}" if b in BRANCHES else "1.0D" for b in active)
    norm = f"SELECT *, max(score) OVER (PARTITION BY query_id, branch) AS high, min(score) OVER (PARTITION BY query_id, branch) AS low FROM {prefix}rankings"
    fused = summed.format(parts=f"SELECT query_id, item_id, {weight} * CASE WHEN high = low THEN 1.0D ELSE (score - low) / (high - low) END / ({total}) AS part FROM ({norm})")
    arguments = ", ".join(f"w_{b} DOUBLE DEFAULT 1.0" for b in BRANCHES)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}, results INT DEFAULT 30) RETURNS TABLE ({shape}) RETURN {best.format(digits=6, fused=fused, name=name)}")
    register_metrics(spark, kinds["query_id"], prefix)
