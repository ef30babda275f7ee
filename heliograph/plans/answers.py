"""Answers that cite their evidence: evidence is extracted an item and question once, answers are checked, and repaired or refused.

A question's way: its selected items give evidence (from the cache, or from a generator asked about item and question); without
usable evidence it is refused. Else a generator answers from the evidence alone. An answer that can't be read, cites an item
outside the evidence, or claims something without a citation is asked for again, ``retries`` times; what still can't be used
is replaced by the evidence itself, each fact with its citation. Each step is a table, so that no generator is asked twice for
the same, and the cache is a table that outlives the job.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from heliograph.functions.payloads import extract_object, first_object, string_list
from heliograph.plans import generation
from heliograph.sources.keyed import KeyedTable
from heliograph.sources.tables import kept

# What a refusal says, and how evidence is joined to an answer.
REFUSAL = "在当前检索到的图片中没有足够依据回答这个问题。你可以扩大检索范围或换一种描述。"
BETWEEN, END = "；", "。"
CITATION = r"\[img_([^\]]+)\]"
_STRINGS = ArrayType(StringType())
#: Items of an answer.
MOST = 3
EVIDENCE = "item_id {0}, question string, relevant boolean, facts array<string>, uncertainty array<string>, used_annotation boolean"
ASK_EVIDENCE = "Tell only what can be seen in this item and bears on the question; guess no names, places or events. Answer with one JSON object: relevant (boolean), facts (strings), uncertainty (strings)."
ASK_ANSWER = "Answer from the evidence alone, and put [img_ID] after each fact; refuse if the evidence is not enough. Answer with one JSON object: answer, citations, confidence, refused."


def cache(spark: SparkSession, path: str, kind: str = "string", buckets: int = 64) -> KeyedTable:
    """The evidence found so far, by item and question; ``kind`` is the type of item ids."""
    return KeyedTable(spark, path, ("item_id", "question"), EVIDENCE.format(kind), buckets)


@F.pandas_udf(StructType().add("relevant", "boolean").add("facts", _STRINGS).add("uncertainty", _STRINGS))
def _evidence_fields(payload: pd.Series) -> pd.DataFrame:
    read = [json.loads(p) if p else {} for p in payload]
    return pd.DataFrame({"relevant": [bool(r.get("relevant", True)) for r in read], "facts": [string_list(r.get("facts")) for r in read], "uncertainty": [string_list(r.get("uncertainty")) for r in read]})


@F.pandas_udf(StructType().add("answer", "string").add("citations", _STRINGS).add("confidence", "double").add("refused", "boolean"))
def _answer_fields(payload: pd.Series) -> pd.DataFrame:
    def number(value):
        try:
            return float(value)
        except (TypeError, ValueError):
            return None

    read = [first_object(p) or {} for p in payload]
    return pd.DataFrame(
        {
            "answer": [str(r.get("answer", "")).strip() for r in read],
            "citations": [string_list(r.get("citations")) for r in read],
            "confidence": pd.Series([number(r.get("confidence", 0.0)) for r in read], dtype="float64").astype(object).where(lambda s: s.notna(), None),
            "refused": [bool(r.get("refused", False)) for r in read],
        }
    )


def evidence(requests: DataFrame, generate: generation.Generator, store: KeyedTable, work: str, annotations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, place, item_id, question, relevant, facts, uncertainty, used_annotation, asked; query_id, error of items that failed).

    ``requests`` has query_id, question, item_id and place. Only items and questions that ``store`` lacks are asked about, each
    once however many requests share it, and what was learned is put into the store as the batch of ``work``. Failures aren't
    kept: they are asked again next time. ``annotations`` has item_id and context, what is known of an item beforehand.
    """
    requests = kept(requests.withColumn("question", F.trim("question")))  # read by each step; the search behind it runs once
    known, lacking = store.lookup(requests)
    known = kept(known)
    rows = lacking.join(annotations.select("item_id", "context"), "item_id", "left") if annotations is not None else lacking.withColumn("context", F.lit(None).cast("string"))
    told = F.concat(F.lit(ASK_EVIDENCE + "\nQuestion: "), F.col("question"), F.coalesce(F.concat(F.lit("\nKnown, to be checked: "), F.col("context")), F.lit("")))
    rows = rows.select("item_id", "question", (F.coalesce("context", F.lit("")) != "").alias("used_annotation"), told.alias("prompt"))
    said = kept(generate(rows).select("item_id", "question", "used_annotation", extract_object(F.col("raw")).alias("payload"), F.col("error")))
    fault = F.coalesce("error", F.when(F.col("payload").isNull(), "no JSON object"))
    new = said.filter(fault.isNull()).withColumn("e", _evidence_fields("payload")).select("item_id", "question", "e.*", "used_annotation")
    new = kept(new)
    if not new.isEmpty():
        store.upsert(new, work)
    every = known.withColumn("asked", F.lit(False)).unionByName(new.withColumn("asked", F.lit(True)))
    failed = requests.join(said.filter(fault.isNotNull()).select("item_id", "question", fault.alias("error")), ["item_id", "question"])
    return requests.join(every, ["item_id", "question"]).select("query_id", "place", *every.columns), failed.select("query_id", F.concat(F.col("item_id").cast("string"), F.lit(": "), F.col("error")).alias("error"))


def citation_faults(answer: Column, allowed: Column) -> Column:
    """Why an answer (a JSON object's text) can't be used beside the ids ``allowed``, or null."""
    f = _answer_fields(answer)
    cited = _cited(f)
    outside = F.array_sort(F.array_except(cited, allowed))
    return (
        F.when(F.size(outside) > 0, F.concat(F.lit("cites outside the evidence: "), F.array_join(outside, ", ")))
        .when(~f["refused"] & (F.size(cited) == 0), "claims without a citation")
        .when(f["confidence"].isNull() | ~f["confidence"].between(0, 1), "confidence is not within 0 and 1")
    )


def _cited(fields: Column) -> Column:
    return F.array_distinct(F.concat(fields["citations"], F.regexp_extract_all(fields["answer"], F.lit(CITATION), F.lit(1))))


def answered(questions: DataFrame, found: DataFrame, generate: generation.Generator, retries: int = 1) -> DataFrame:
    """query_id, answer, citations, confidence, refused, source (generator, evidence or refusal), attempts: a row a question.

    ``questions`` has query_id and question, ``found`` evidence as ``evidence`` gives it, of MOST items a question at most.
    """
    usable = found.filter("relevant and size(facts) > 0").filter(F.col("place") <= MOST)
    one = F.struct("place", F.col("item_id").cast("string").alias("item_id"), "facts", "uncertainty")
    grouped = usable.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("evidence"))  # at most MOST a question
    rows = questions.join(grouped, "query_id", "left")
    told = F.concat(F.lit(ASK_ANSWER + "\nQuestion: "), F.trim("question"), F.lit("\nEvidence: "), F.to_json(F.transform("evidence", lambda e: e.dropFields("place"))))
    ready = rows.filter("evidence is not null").select("query_id", F.transform("evidence", lambda e: e["item_id"]).alias("allowed"), "evidence", told.alias("prompt"))
    good, bad = generation.attempted(kept(ready), generate, lambda a: citation_faults(a, F.col("allowed")), retries)
    f = F.col("f")
    said = good.withColumn("f", _answer_fields("answer")).select(
        "query_id", F.when(f["answer"] == "", REFUSAL).otherwise(f["answer"]).alias("answer"), _cited(f).alias("citations"), f["confidence"].alias("confidence"), f["refused"].alias("refused"), F.lit("generator").alias("source"), "attempts"
    )
    lines = F.transform("evidence", lambda e: F.concat(e["facts"][0], F.lit("[img_"), e["item_id"], F.lit("]")))
    instead = bad.select("query_id", F.concat(F.array_join(lines, BETWEEN), F.lit(END)).alias("answer"), F.col("allowed").alias("citations"), F.lit(0.5).alias("confidence"), F.lit(False).alias("refused"), F.lit("evidence").alias("source"), "attempts")
    none = F.array().cast("array<string>")
    refused = rows.filter("evidence is null").select("query_id", F.lit(REFUSAL).alias("answer"), none.alias("citations"), F.lit(0.0).alias("confidence"), F.lit(True).alias("refused"), F.lit("refusal").alias("source"), F.lit(0).alias("attempts"))
    return said.unionByName(instead).unionByName(refused)


def answer(questions: DataFrame, selected: DataFrame, ask: generation.Generator, generate: generation.Generator, store: KeyedTable, work: str, annotations: DataFrame | None = None, retries: int = 1) -> tuple[DataFrame, DataFrame]:
    """(answers, (query_id, error) of questions of which an item's evidence failed; these have no answer).

    ``questions`` has query_id and question; ``selected`` query_id, item_id and place, from 1 on.
    """
    requests = selected.filter(F.col("place") <= MOST).join(questions, "query_id")
    found, failed = evidence(requests, ask, store, work, annotations)
    failed = failed.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("error"))  # at most MOST a question
    open_ = questions.join(failed, "query_id", "left_anti")
    return answered(open_, found, generate, retries), failed


def about_item(requests: DataFrame, generate: generation.Generator) -> DataFrame:
    """From (request_id, item_id, question): raw and error of a free answer about one item, which tells what it isn't sure of."""
    prompt = F.concat(F.lit("Answer from this item alone, and say so where you are not sure.\nQuestion: "), F.trim("question"))
    return generate(requests.withColumn("prompt", prompt)).select("request_id", "item_id", F.col("raw").alias("answer"), "error")


def written_content(requests: DataFrame, annotations: DataFrame, template: str, generate: generation.Generator, retries: int = 1, wrong: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(request_id, content: a JSON object's text, attempts; request_id, error) of texts of a kind and tone about an item.

    ``requests`` has request_id, item_id, kind and tone, ``annotations`` item_id and context; an item without one is an error.
    """
    rows = requests.join(annotations.select("item_id", "context"), "item_id", "left")
    prompt = F.concat(F.lit(template + "\nKind: "), F.col("kind"), F.lit("\nTone: "), F.col("tone"), F.lit("\nItem: "), F.col("context"))
    ready = rows.filter("context is not null").select("request_id", prompt.alias("prompt"))
    good, bad = generation.attempted(ready, generate, wrong or (lambda a: F.lit(None).cast("string")), retries)
    unknown = rows.filter("context is null").select("request_id", F.lit("unknown item").alias("error"))
    return good.select("request_id", F.col("answer").alias("content"), "attempts"), bad.select("request_id", "error").unionByName(unknown)
