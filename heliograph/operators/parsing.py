"""Query understanding by rules, over a DataFrame of queries; a generator's answer may be merged in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.aliases import Catalog
from heliograph.functions.payloads import as_list
from heliograph.functions.text import count_phrase, none_of_strings, quoted_terms, unique_strings

LISTS = ("objects", "actions", "scene", "time_of_day", "weather", "mood", "colors", "style", "required_terms", "excluded_terms", "ocr_terms")
#: What a generator may add to: the rest of a query stays as the rules found it.
OPEN = ("actions", "mood", "style")


def parse(queries: DataFrame, catalog: Catalog | None = None, night: tuple[str, str] = ("夜", "夜晚")) -> DataFrame:
    """From (query_id, text): the slots of each query, and its type (negative, ocr, count, compositional or simple)."""
    catalog = catalog or Catalog()
    text = F.col("text")
    found = queries.withColumn("excluded_terms", catalog.find_excluded(text)).withColumn("ocr_terms", quoted_terms(text)).withColumn("_count", count_phrase(text))
    kept = lambda home: F.array_except(catalog.find(text, home), F.col("excluded_terms"))
    target = catalog.canonicalize(F.col("_count.target"))
    times = catalog.find(text, "time_of_day")
    out = found.select(
        "query_id", text.alias("raw_text"), catalog.remove_negative(text, F.col("excluded_terms")).alias("semantic_text"),
        F.when(F.col("_count.target").isNotNull(), F.array_union(kept("objects"), F.array(target))).otherwise(kept("objects")).alias("objects"),
        none_of_strings().alias("actions"), kept("scene").alias("scene"),
        F.when((F.size(times) == 0) & text.contains(night[0]), F.array(F.lit(night[1]))).otherwise(times).alias("time_of_day"),
        catalog.find(text, "weather").alias("weather"), none_of_strings().alias("mood"), kept("colors").alias("colors"), none_of_strings().alias("style"),
        none_of_strings().alias("required_terms"), "excluded_terms", "ocr_terms",
        F.when(F.col("_count.target").isNotNull(), target).alias("count_target"), F.col("_count.value").alias("count_value"), F.col("_count.operator").alias("count_operator"),
    )
    return with_type(out)


def with_type(parsed: DataFrame) -> DataFrame:
    filled = sum(F.when(F.size(c) > 0, 1).otherwise(0) for c in ("objects", "scene", "time_of_day", "weather", "colors", "ocr_terms"))
    kind = F.when(F.size("excluded_terms") > 0, "negative").when(F.size("ocr_terms") > 0, "ocr").when(F.col("count_value").isNotNull(), "count").when(filled >= 2, "compositional").otherwise("simple")
    return parsed.withColumn("query_type", kind)


def merged(parsed: DataFrame, answer: str = "answer") -> DataFrame:
    """``parsed`` with a generator's JSON ``answer`` (null: it failed) merged in.

    Actions, mood and style grow; the semantic text and a simple type are replaced; a count is taken only where the
    rules found none. Filters that the rules found stay.
    """
    a = F.col(answer)
    at = lambda name: F.nullif(F.trim(F.get_json_object(a, f"$.{name}")), F.lit(""))
    types = ("simple", "compositional", "negative", "count", "ocr")
    out = parsed
    for c in OPEN:
        out = out.withColumn(c, F.when(a.isNotNull(), unique_strings(F.concat(F.col(c), as_list(a, c)))).otherwise(F.col(c)))
    new_count = F.col("count_value").isNull() & at("count_target").isNotNull() & at("count_value").try_cast("int").isNotNull()
    out = out.withColumn("_new", F.coalesce(new_count, F.lit(False)))
    out = out.withColumn("semantic_text", F.coalesce(at("semantic_text"), "semantic_text")).withColumn("query_type", F.when((F.col("query_type") == "simple") & at("query_type").isin(*types), at("query_type")).otherwise(F.col("query_type")))
    out = out.withColumn("count_target", F.when(F.col("_new"), at("count_target")).otherwise(F.col("count_target"))).withColumn("count_operator", F.when(F.col("_new"), F.coalesce(at("count_operator"), F.lit("eq"))).otherwise(F.col("count_operator")))
    out = out.withColumn("count_value", F.when(F.col("_new"), at("count_value").try_cast("int")).otherwise(F.col("count_value")))
    return out.withColumn("backend", F.when(a.isNotNull(), "generator").otherwise("rules")).drop("_new")
