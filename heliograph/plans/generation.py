"""Work of a generator (a language or vision model), which is a function of the caller's: tried again, parsed, and accounted for.

A generator takes a DataFrame with a column ``prompt`` and returns its rows with ``raw`` (what it said, or null) and
``error`` (why it said nothing, or null). It may be a pandas UDF, a mapInPandas, or a table of answers joined in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.payloads import extract_object
from heliograph.functions.text import none_of_strings
from heliograph.operators.parsing import LISTS, merged
from heliograph.sources.tables import kept

Generator = Callable[[DataFrame], DataFrame]
#: What is added to a prompt after an answer that can't be used.
AGAIN = "\nThe last answer could not be used. Answer with a single JSON object that has all fields, and nothing else."
# What a picture's prompt falls back on.
ANCHORS = "documentary photo, coherent transition, natural light, balanced composition, "
UNWANTED = "low quality, blurry, deformed, duplicate, text, watermark, logo, signature, oversaturated"


def attempted(rows: DataFrame, generate: Generator, wrong: Callable[[Column], Column], retries: int = 2, again: str = AGAIN) -> tuple[DataFrame, DataFrame]:
    """(rows with ``answer``, a JSON object's text, and ``attempts``; rows without a usable answer, with ``error`` and attempts).

    ``wrong`` gives the reason why an answer can't be used, or null. Only rows that failed are asked again, with ``again``
    after their prompt; each round's answers are kept, so that no generator is asked twice for the same.
    """
    columns, done, todo = rows.columns, None, rows
    for attempt in range(1, retries + 2):
        said = kept(generate(todo).select(*columns, F.lit(attempt).alias("attempts"), extract_object(F.col("raw")).alias("answer"), F.col("error").alias("_failed")))
        reason = F.coalesce("_failed", F.when(F.col("answer").isNull(), "no JSON object"), wrong(F.col("answer")))
        judged = said.withColumn("error", reason).drop("_failed")
        good, bad = judged.filter("error is null").drop("error"), judged.filter("error is not null")
        done = good if done is None else done.unionByName(good)
        if attempt <= retries:
            if bad.isEmpty():
                break
            todo = bad.select(*columns).withColumn("prompt", F.concat("prompt", F.lit(again)) if attempt == 1 else F.col("prompt"))
    return done, bad.drop("answer")


def annotation_faults(answer: Column) -> Column:
    """Why an annotation can't be used: no summary, or fewer than three search queries."""
    queries = F.size(F.coalesce(F.from_json(F.get_json_object(answer, "$.search_queries"), "array<string>"), none_of_strings()))
    return F.when(F.coalesce(F.trim(F.get_json_object(answer, "$.summary")), F.lit("")) == "", "no summary").when(queries < 3, "fewer than three search queries")


def annotated(items: DataFrame, prompt: str | Column, generate: Generator, version: str, retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """(item_id, answer, attempts, prompt_version, prompt_sha256; item_id, error, attempts) of items that are valid."""
    text = F.lit(prompt) if isinstance(prompt, str) else prompt
    rows = items.filter("valid").select("item_id", text.alias("prompt"))
    digests = rows.select("item_id", F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256"))
    good, bad = attempted(rows, generate, annotation_faults, retries)
    return good.drop("prompt").join(digests, "item_id").withColumn("prompt_version", F.lit(version)), bad.select("item_id", "error", "attempts")


def parsed_with(parsed: DataFrame, prompt: str, generate: Generator | None) -> DataFrame:
    """Queries that the rules parsed, with a generator's answers merged in: backend (rules, generator or rules_fallback) and error.

    What a generator fails at stays as the rules found it.
    """
    if generate is None:
        return parsed.withColumn("backend", F.lit("rules")).withColumn("error", F.lit(None).cast("string"))
    rows = parsed.select("query_id", F.concat(F.lit(prompt + "\n"), F.col("raw_text")).alias("prompt"))
    good, bad = attempted(rows, generate, query_faults, retries=0)
    met = parsed.join(good.select("query_id", "answer"), "query_id", "left").join(bad.select("query_id", "error"), "query_id", "left")
    out = merged(met).drop("answer")
    return out.withColumn("backend", F.when(F.col("backend") == "generator", "generator").otherwise("rules_fallback"))


def query_faults(answer: Column) -> Column:
    """Why a parsed query can't be used: types, operators and counts outside of what a query may have."""
    at = lambda name: F.get_json_object(answer, f"$.{name}")
    kinds = ("simple", "compositional", "negative", "count", "ocr")
    count = at("count_value").try_cast("int")
    return F.when(at("query_type").isNotNull() & ~at("query_type").isin(*kinds), "query_type").when(at("count_operator").isNotNull() & ~at("count_operator").isin("eq", "gte", "lte"), "count_operator").when(at("count_value").isNotNull() & (count.isNull() | (count < 0)), "count_value")


def picture_prompts(requests: DataFrame, template: str, generate: Generator) -> DataFrame:
    """From (request_id, query, context): positive_prompt, negative_prompt and source (generator or fallback).

    A generator is asked twice; what it fails at gets the query's beginning with stable anchors.
    """
    prompt = F.concat(F.lit(template + "\n"), F.col("query"), F.lit("\n"), F.coalesce("context", F.lit("")))
    faults = lambda a: F.when(F.coalesce(F.trim(F.get_json_object(a, "$.positive_prompt")), F.lit("")) == "", "no positive_prompt").when(F.get_json_object(a, "$.negative_prompt").isNull(), "no negative_prompt")
    good, _ = attempted(requests.select("request_id", prompt.alias("prompt")), generate, faults, retries=1)
    met = requests.join(good.select("request_id", "answer"), "request_id", "left")
    at = lambda name: F.get_json_object("answer", f"$.{name}")
    return met.select(
        "request_id", F.coalesce(at("positive_prompt"), F.concat(F.lit(ANCHORS), F.substring(F.trim("query"), 1, 24))).alias("positive_prompt"),
        F.coalesce(at("negative_prompt"), F.lit(UNWANTED)).alias("negative_prompt"), F.when(F.col("answer").isNull(), "fallback").otherwise("generator").alias("source"),
    )


def compared_prompts(items: DataFrame, prompts: dict[str, str], generate: Generator) -> DataFrame:
    """item_id, name, raw, error: every item under every prompt of a short list."""
    each = items.select("item_id", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("prompt")) for k, v in prompts.items()])).alias("p")).select("item_id", "p.*")
    return generate(each).select("item_id", "name", "raw", "error")
