"""Visual stories: order, gaps, and answers that cite their evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.text import time_bucket, time_label

#: Items of a story.
FEWEST, MOST = 3, 8


def features(scene: Column, *lists: Column) -> Column:
    cleaned = F.transform(F.concat(F.array(scene), *lists), lambda v: F.lower(F.trim(v)))
    return F.array_distinct(F.filter(cleaned, lambda v: v != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct lists; 0 where both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def order(items: DataFrame) -> DataFrame:
    """From (story_id, item_id, position, bucket, features): with ``place``.

    Buckets in order; in each a greedy chain from its first item to the one most alike, ties to the earlier one. A chain
    depends on all its steps, so a story - of at most MOST items - is one group of rows.
    """

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in sorted(pdf.groupby("bucket"), key=lambda g: g[0]):
            left = sorted(part.to_dict("records"), key=lambda r: r["position"])
            here = left.pop(0)
            out.append(here)
            while left:
                def score(r, here=here):
                    a, b = set(here["features"]), set(r["features"])
                    return (len(a & b) / len(a | b) if a | b else 0.0, -r["position"])

                here = max(left, key=score)
                left.remove(here)
                out.append(here)
        return pd.DataFrame({"story_id": [r["story_id"] for r in out], "item_id": [r["item_id"] for r in out], "place": range(1, len(out) + 1)})

    types = dict(items.dtypes)
    sized = items.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("story_id")))
    kept = sized.filter(F.col("_n").between(FEWEST, MOST)).select("story_id", "item_id", "position", "bucket", "features")
    return kept.groupBy("story_id").applyInPandas(chain, f"story_id {types['story_id']}, item_id {types['item_id']}, place int")


def gaps(ordered: DataFrame, most: int = 2, least_alike: float = 0.15) -> DataFrame:
    """From (story_id, item_id, place, scene, bucket, features): the first ``most`` gaps of each story.

    A gap lies between neighbours two buckets or more apart, or of different scenes with too little in common.
    """
    w = Window.partitionBy("story_id").orderBy("place")
    nxt = ordered.select("story_id", "place", "item_id", "scene", "bucket", "features", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("item_id", "scene", "bucket", "features")]).filter("next_item_id is not null")
    known = (F.col("bucket") < 6) & (F.col("next_bucket") < 6)
    jump = known & (F.col("next_bucket") - F.col("bucket") >= 2)
    cut = (F.trim("scene") != "") & (F.trim("next_scene") != "") & (F.col("scene") != F.col("next_scene")) & (jaccard(F.col("features"), F.col("next_features")) < least_alike)
    reasons = F.concat_ws("; ", F.when(jump, F.concat(F.lit("time "), time_label(F.col("bucket")), F.lit(" to "), time_label(F.col("next_bucket")))), F.when(cut, F.concat(F.lit("scene "), F.col("scene"), F.lit(" to "), F.col("next_scene"))))
    found = nxt.withColumn("reason", reasons).filter("reason <> ''").withColumn("gap", F.row_number().over(w))
    return found.filter(F.col("gap") <= most).select("story_id", "gap", F.col("item_id").alias("after_item_id"), F.col("next_item_id").alias("before_item_id"), "reason")


def sections(ordered: DataFrame, gapped: DataFrame) -> DataFrame:
    """Ordered items with the gap that follows each, if any."""
    return ordered.join(gapped.select("story_id", F.col("after_item_id").alias("item_id"), "gap", "reason"), ["story_id", "item_id"], "left")


def filled(gapped: DataFrame, generate, seed: int = 0) -> DataFrame:
    """``gapped`` with status (generated or failed), generated and error: what ``generate`` gives for each gap.

    ``generate`` takes rows with story_id, gap, reason and seed (``seed`` and the gap's place from 0 on) and returns
    story_id, gap, generated and error; a gap that it returns nothing for has failed.
    """
    made = generate(gapped.withColumn("seed", F.lit(seed) + F.col("gap") - 1)).select("story_id", "gap", "generated", "error")
    out = gapped.join(made, ["story_id", "gap"], "left")
    good = F.col("generated").isNotNull() & F.col("error").isNull()
    return out.withColumn("status", F.when(good, "generated").otherwise("failed")).withColumn("error", F.when(~good, F.coalesce("error", F.lit("nothing was generated"))))


def written(ordered: DataFrame, gapped: DataFrame) -> DataFrame:
    """A story a row: sections in order, each an item (struct place, item_id, gap, reason), and the number of gaps."""
    parts = sections(ordered, gapped).groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("place", "item_id", "gap", "reason"))).alias("sections"))  # at most MOST a story
    return parts.withColumn("gaps", F.size(F.filter("sections", lambda s: s["gap"].isNotNull())))


def fallback_answers(evidence: DataFrame, most: int = 3) -> DataFrame:
    """From (question_id, item_id, relevant, facts): an answer of the usable facts with citations, or a refusal.

    Evidence of a question is its first ``most`` items by id.
    """
    by = Window.partitionBy("question_id").orderBy("item_id")
    evidence = evidence.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= most)
    usable = F.coalesce(F.col("relevant"), F.lit(False)) & (F.size("facts") > 0)
    line = F.concat(F.array_join("facts", "; "), F.lit("[img_"), F.col("item_id").cast("string"), F.lit("]"))
    lines = F.array_sort(F.collect_list(F.when(usable, F.struct(F.col("item_id").alias("i"), line.alias("l")))))  # at most ``most`` a question
    grouped = evidence.groupBy("question_id").agg(lines.alias("ls"))
    return grouped.select("question_id", F.when(F.size("ls") == 0, "insufficient evidence").otherwise(F.array_join(F.transform("ls", lambda x: x["l"]), " ")).alias("answer"), (F.size("ls") == 0).alias("refused"), F.array_join(F.transform("ls", lambda x: x["i"].cast("string")), ",").alias("citations"))


def bucket_of(scene: Column, summary: Column, attributes: Column) -> Column:
    return time_bucket(F.concat_ws(" ", scene, summary, attributes))
