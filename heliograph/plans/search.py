"""Hybrid search for a DataFrame of queries: recall, filter, fuse, explain and cut, as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.aliases import Catalog
from heliograph.operators import filters, fusion
from heliograph.operators.delivery import with_fallback
from heliograph.operators.documents import FIELDS, fields, normalized_fields, query_document

ASKED = (*filters.SLOTS, "excluded_terms", "required_terms", "ocr_terms", "count_target", "count_value", "count_operator")
REASONS = ("matched_fields", "evidence", "mismatch")


@dataclass
class Searcher:
    """``branches``: name -> function from (queries, k) to (query_id, item_id, score, rank).

    ``keep`` is called with each branch's ranking; tables.kept writes it, so that a branch which fails while it runs is
    left out too, and rankings that several plans read are made once. Without it a plan is made for all at once.
    """

    annotations: DataFrame
    branches: dict[str, Callable[[DataFrame, int], DataFrame]]
    catalog: Catalog = field(default_factory=Catalog)
    mode: str = "hybrid"
    method: str = "rrf"
    rrf_k: int = 60
    weights: dict[str, float] = field(default_factory=dict)
    keep: Callable[[DataFrame], DataFrame] | None = None
    errors: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.method not in ("rrf", "weighted"):
            raise ValueError("method must be 'rrf' or 'weighted'")
        if self.mode not in filters.MODES:
            raise ValueError(f"mode must be one of {filters.MODES}")

    def active(self) -> tuple[str, ...]:
        known = [b for b in fusion.BRANCHES if b in self.branches and b not in self.errors]
        return (*known, *[b for b in self.branches if b not in known and b not in self.errors])

    def recall(self, queries: DataFrame, candidates: int) -> DataFrame:
        """Rankings of all branches, by the query's document. A branch that fails is left out and noted; none left is an error.

        Queries have query_id and either text, or the columns of a parsed query.
        """
        if "raw_text" not in queries.columns:
            queries = queries.withColumn("raw_text", F.col("text"))
        if "semantic_text" not in queries.columns:
            queries = queries.withColumn("semantic_text", F.col("raw_text"))
        queries = queries.withColumn("text", query_document(queries.columns))
        self.errors, out = {}, None
        for name, search in self.branches.items():
            try:
                one = search(queries, candidates).select("query_id", F.lit(name).alias("branch"), "item_id", "score", "rank")
                one.schema  # noqa: B018  analyses the plan now
                one = self.keep(one) if self.keep else one
            except Exception as e:
                self.errors[name] = f"{type(e).__name__}: {e}"
                continue
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise RuntimeError(f"all retrieval branches failed: {self.errors}")
        return out

    def decided(self, rankings: DataFrame, queries: DataFrame, mode: str | None = None) -> DataFrame:
        """A row for each recalled pair of query and item: hits (branch, rank, score), and what the filter decides of it, once."""
        hits = rankings.groupBy("query_id", "item_id").agg(F.collect_list(F.struct("branch", "rank", "score")).alias("hits"))  # a few a branch
        path = [c for c in ("relative_path",) if c in self.annotations.columns]
        # annotations meet the hits as they are: those that weren't recalled needn't be normalized
        annotated = normalized_fields(fields(hits.join(self.annotations, "item_id"))).select("query_id", "item_id", "hits", "object_counts", "f", "n", *path)
        pairs = annotated.join(queries.select("query_id", *[c for c in queries.columns if c in ASKED]), "query_id")
        return filters.decide(pairs, self.catalog, mode or self.mode).select("query_id", "item_id", "hits", "allowed", *path, *REASONS)

    def compacted(self, decided: DataFrame) -> DataFrame:
        """Rankings of what is allowed: an item counts where it first stands in a branch, and ranks are counted anew."""
        first = F.transform(F.array_distinct(F.transform("hits", lambda h: h["branch"])), lambda b: F.array_min(F.filter("hits", lambda h: h["branch"] == b)))
        carry = [c for c in decided.columns if c not in ("query_id", "item_id", "hits", "allowed")]
        rows = decided.filter("allowed").select("query_id", "item_id", *carry, F.inline(first))
        return fusion.compacted_rows(rows)

    def _fused(self, kept: DataFrame, method: str, weights: dict[str, float], results: int) -> DataFrame:
        carry = tuple(c for c in kept.columns if c not in ("query_id", "item_id", "branch", "rank", "score"))
        active = self.active()
        fused = fusion.rrf(kept, self.rrf_k, carry) if method == "rrf" else fusion.weighted(kept, {b: weights.get(b, 1.0) for b in active}, active, carry)
        return fusion.top(fused, results).withColumn("active_branches", F.array(*map(F.lit, active)))

    def search(self, queries: DataFrame, candidates: int = 50, results: int = 30) -> DataFrame:
        """query_id, rank, item_id, relative_path (if annotations have it), fused_score, branch_scores, branch_ranks,
        matched_fields, evidence, mismatch, active_branches.

        Recall takes ``candidates`` a branch before the filter, which may not move below it; ranks are counted anew after.
        Without candidates or results there are no rows.
        """
        if candidates <= 0 or results <= 0:
            return self.search(queries, 1, 1).limit(0)
        return self.fuse(self.recall(queries, candidates), queries, results)

    def fuse(self, rankings: DataFrame, queries: DataFrame, results: int, mode: str | None = None) -> DataFrame:
        return self._fused(self.compacted(self.decided(rankings, queries, mode)), self.method, self.weights, results)

    def with_fallback(self, queries: DataFrame, candidates: int, results: int) -> DataFrame:
        """search(), and for queries with fewer results than asked for, what the soft mode finds; recall is the same."""
        rankings = self.recall(queries, candidates)
        return with_fallback(self.fuse(rankings, queries, results), self.fuse(rankings, queries, results, "soft"), results)

    def ablation(self, queries: DataFrame, candidates: int, results: int, weights: dict[str, float], branches: bool = True) -> DataFrame:
        """``variant`` by variant - each branch alone, all by rank, all by weight - from one recall and one filter."""
        kept = self.compacted(self.decided(self.recall(queries, candidates), queries)).select("query_id", "item_id", "branch", "rank", "score")
        kept = self.keep(kept) if self.keep else kept
        out = None
        for name, part, method in [*[(b, kept.filter(F.col("branch") == b), "rrf") for b in self.active() if branches], ("rrf", kept, "rrf"), ("weighted", kept, "weighted")]:
            one = self._fused(part, method, weights, results).withColumn("variant", F.lit(name))
            out = one if out is None else out.unionByName(one)
        return out


__all__ = ["FIELDS", "Searcher"]
