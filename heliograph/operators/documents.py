"""Annotations as searchable documents, and parsed queries as retrieval strings.

An annotation row has: item_id, summary, objects, object_counts (array of struct(name, count), whose order matters),
actions, scene, attributes, spatial_relations, style, mood, colors, ocr_text. Generated search queries never get in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.text import none_of_strings, normalize

#: Fields in their order.
FIELDS = ("summary", "objects", "object_counts", "actions", "scene", "time_of_day", "weather", "attributes", "spatial_relations", "style", "mood", "colors", "ocr_text")
# The labels by which a document names its fields.
LABELS = {"summary": "摘要", "objects": "主体", "object_counts": "数量", "actions": "动作", "scene": "场景", "time_of_day": "时间", "weather": "天气", "attributes": "属性", "spatial_relations": "关系", "style": "风格", "mood": "情绪", "colors": "颜色", "ocr_text": "文字"}
QUERY_LABELS = (("objects", "主体"), ("count", "数量"), ("actions", "动作"), ("scene", "场景"), ("time_of_day", "时间"), ("weather", "天气"), ("mood", "情绪"), ("colors", "颜色"), ("style", "风格"), ("required_terms", "必须"), ("ocr_terms", "文字"))


def with_prefix(attributes: Column, prefix: str) -> Column:
    mark = prefix + ":"
    return F.transform(F.filter(F.coalesce(attributes, none_of_strings()), lambda a: a.startswith(mark)), lambda a: F.substring(a, len(mark) + 1, 1 << 30))


def fields(annotations: DataFrame) -> DataFrame:
    """``annotations`` with a struct ``f`` of the thirteen fields, each an array of strings."""
    plain = lambda c: F.coalesce(F.col(c), none_of_strings())
    parts = {
        "summary": F.array("summary"),
        "object_counts": F.transform(F.coalesce("object_counts", F.array().cast("array<struct<name:string,count:int>>")), lambda x: F.concat_ws(":", x["name"], x["count"].cast("string"))),
        "scene": F.array("scene"),
        "time_of_day": with_prefix(F.col("attributes"), "time_of_day"),
        "weather": with_prefix(F.col("attributes"), "weather"),
    }
    return annotations.withColumn("f", F.struct(*[parts.get(c, plain(c) if c not in parts else None).alias(c) for c in FIELDS]))


def normalized_fields(annotated: DataFrame) -> DataFrame:
    """``annotated`` with a struct ``n`` of its fields in normalized form, made once and used by every query."""
    return annotated.withColumn("n", F.struct(*[F.transform(F.col(f"f.{c}"), normalize).alias(c) for c in FIELDS]))


def labelled(parts: list[tuple[str, Column]]) -> Column:
    """`label:values` of the parts that have any non-empty value."""
    return F.concat_ws(" ", *[F.when(F.exists(v, lambda x: x != ""), F.concat(F.lit(label + ":"), F.array_join(v, " "))) for label, v in parts])


def dense_document() -> Column:
    return labelled([(LABELS[c], F.col(f"f.{c}")) for c in FIELDS])


def sparse_document() -> Column:
    """The same fields, the summary last."""
    return labelled([(LABELS[c], F.col(f"f.{c}")) for c in (*FIELDS[1:], "summary")])


def query_document(columns: list[str]) -> Column:
    """Of a parsed query: its semantic text and its labelled slots; slots that aren't among ``columns`` are left out."""
    parts = []
    for slot, label in QUERY_LABELS:
        if slot == "count" and {"count_target", "count_value"} <= set(columns):
            parts.append((label, F.when(F.col("count_target").isNotNull() & F.col("count_value").isNotNull(), F.array(F.concat_ws(":", "count_target", F.coalesce("count_operator", F.lit("eq")) if "count_operator" in columns else F.lit("eq"), F.col("count_value").cast("string"))))))
        elif slot in columns:
            parts.append((label, F.col(slot)))
    slots = F.concat_ws(" ", *[F.when(F.size(F.coalesce(v, none_of_strings())) > 0, F.concat(F.lit(label + ":"), F.array_join(v, " "))) for label, v in parts])
    return F.trim(F.concat_ws(" ", F.coalesce(F.nullif(F.trim("semantic_text"), F.lit("")), F.col("raw_text")), F.nullif(slots, F.lit(""))))


def placeholders(manifest: DataFrame) -> DataFrame:
    """Items that have no annotation yet, in the shape of one."""
    none = none_of_strings()
    return manifest.select("item_id", F.lit("").alias("summary"), none.alias("objects"), F.array().cast("array<struct<name:string,count:int>>").alias("object_counts"), none.alias("actions"), F.lit("").alias("scene"), *[none.alias(c) for c in ("attributes", "spatial_relations", "style", "mood", "colors", "ocr_text")])
