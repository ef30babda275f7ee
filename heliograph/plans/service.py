"""The service: search with optional reranking, cited answers and visual stories, for DataFrames of requests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.operators import documents, manifest, parsing, rerank, story
from heliograph.plans import answers, generation
from heliograph.plans.search import Searcher
from heliograph.sources.keyed import KeyedTable
from heliograph.sources.tables import kept


@dataclass
class Settings:
    candidate_count: int = 50
    result_count: int = 30
    rerank_count: int = 20
    rerank_method: str = "pointwise"
    fused_weight: float = 0.35
    scorer_weight: float = 0.65

    def __post_init__(self):
        if self.rerank_method not in ("pointwise", "listwise"):
            raise ValueError("rerank_method must be 'pointwise' or 'listwise'")


@dataclass
class Service:
    """``scorer``: from candidates to (query_id, item_id, answer), or for listwise to (query_id, answer)."""

    searcher: Searcher
    settings: Settings = field(default_factory=Settings)
    scorer: Callable[[DataFrame], DataFrame] | None = None
    parser_prompt: str = ""
    generate: generation.Generator | None = None

    def parse(self, queries: DataFrame) -> DataFrame:
        """From (query_id, text): parsed queries, with backend and error."""
        return generation.parsed_with(parsing.parse(queries, self.searcher.catalog), self.parser_prompt, self.generate)

    def search(self, queries: DataFrame, reranked: bool = False) -> DataFrame:
        """From (query_id, text): the searcher's rows; reranked ones also have rerank_score and their new rank."""
        s = self.settings
        parsed = kept(self.parse(queries).drop("error", "backend"))
        found = self.searcher.search(parsed, s.candidate_count, s.rerank_count if reranked else s.result_count)
        if not reranked:
            return found
        if self.scorer is None:
            raise ValueError("reranking needs a scorer")
        found = kept(found)  # what the scorer sees is what is ranked
        answers = kept(self.scorer(found))
        if s.rerank_method == "pointwise":
            scored = rerank.pointwise(rerank.pointwise_answers(found, answers), s.fused_weight, s.scorer_weight).drop("combined", "response", "error")
        else:
            new = rerank.listwise(found.select("query_id", "item_id", "rank"), answers).withColumnRenamed("score", "rerank_score")
            scored = found.join(new, ["query_id", "item_id"])
        return scored.withColumn("rank", F.col("new_rank")).drop("new_rank").filter(F.col("rank") <= s.result_count)

    def answer(self, candidates: DataFrame, asked: DataFrame, evidence: Callable[[DataFrame], DataFrame], top_k: int = 3) -> tuple[DataFrame, DataFrame]:
        """(answers made of the evidence itself, or refusals, by query_id; (query_id, error) of selections that can't be answered).

        ``evidence`` takes (query_id, item_id, place) to (query_id, item_id, relevant, facts).
        """
        taken, errors = self._selected(candidates, asked, top_k)
        return story.fallback_answers(evidence(taken).withColumnRenamed("query_id", "question_id"), top_k).withColumnRenamed("question_id", "query_id"), errors

    def cited_answer(self, questions: DataFrame, candidates: DataFrame, asked: DataFrame, ask: generation.Generator, generate: generation.Generator, store: KeyedTable, work: str, top_k: int = 3, retries: int = 1) -> tuple[DataFrame, DataFrame]:
        """(generated answers with checked citations, by query_id; (query_id, error) of questions that can't be answered).

        ``ask`` gives evidence of an item and question, each asked for once: ``store`` (``answers.cache``) keeps it for later
        runs; ``generate`` writes answers. ``questions`` has query_id and question.
        """
        taken, errors = self._selected(candidates, asked, top_k)
        known = documents.fields(self.searcher.annotations).select("item_id", documents.dense_document().alias("context"))
        open_ = questions.join(errors, "query_id", "left_anti")
        found, failed = answers.answer(open_, taken, ask, generate, store, work, known, retries)
        return found, errors.unionByName(failed)

    def _selected(self, candidates: DataFrame, asked: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame]:
        if not 1 <= top_k <= answers.MOST:
            raise ValueError(f"answers are made of 1 to {answers.MOST} items")
        return manifest.chosen(candidates, asked, 1, top_k)

    def stories(self, candidates: DataFrame, asked: DataFrame, fill: Callable[[DataFrame], DataFrame] | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(stories: story_id, sections, gaps; their gaps, filled if ``fill`` is given; (query_id, error) of selections that make none)."""
        taken, errors = manifest.chosen(candidates, asked, story.FEWEST, story.MOST)
        about = documents.fields(self.searcher.annotations).select(
            "item_id", "scene", story.bucket_of(F.col("scene"), F.col("summary"), F.array_join("f.time_of_day", " ")).alias("bucket"), story.features(F.col("scene"), F.col("f.objects"), F.col("f.actions"), F.col("f.colors")).alias("features")
        )
        items = taken.join(about, "item_id").select(F.col("query_id").alias("story_id"), "item_id", F.col("place").alias("position"), "scene", "bucket", "features")
        ordered = items.join(story.order(items), ["story_id", "item_id"])
        found = story.gaps(ordered)
        gaps = found if fill is None else story.filled(found, fill, seed)
        return story.written(ordered, found), gaps, errors
