"""Scene routing: category centroids from prompt vectors, and the nearest ones of each item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.vectors import dot, l2_normalize

#: Categories are a short list; more than this many are an error.
FEW_CATEGORIES = 10_000


def centroids(prompts: DataFrame) -> DataFrame:
    """From (category, ordinal, vector): category, ordinal, unit mean of the unit vectors."""
    parts = prompts.select("category", "ordinal", F.posexplode(l2_normalize(F.col("vector"))).alias("at", "x"))
    means = parts.groupBy("category", "at").agg(F.avg("x").alias("x"), F.min("ordinal").alias("ordinal"))
    lists = means.groupBy("category").agg(F.min("ordinal").alias("ordinal"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("v"))
    return lists.select("category", "ordinal", l2_normalize(F.col("v")).alias("centroid"))


def route(items: DataFrame, categories: DataFrame, top: int = 3, digits: int = 9) -> DataFrame:
    """From (item_id, vector): item_id, category, score, place; ties by the categories' ordinals.

    Categories are a list of at most FEW_CATEGORIES, which is checked; each item is scored in its own row.
    """
    few = categories.select("ordinal", "category", "centroid").limit(FEW_CATEGORIES + 1)
    if few.count() > FEW_CATEGORIES:
        raise ValueError(f"more than {FEW_CATEGORIES} categories")
    listed = few.agg(F.array_sort(F.collect_list(F.struct("ordinal", "category", "centroid"))).alias("_c"))
    held = items.select("item_id", l2_normalize(F.col("vector")).alias("v")).filter("v is not null").crossJoin(F.broadcast(listed))  # one row
    scored = held.select("item_id", F.transform("_c", lambda c: F.struct((-F.round(dot(F.col("v"), c["centroid"]), digits)).alias("down"), c["ordinal"].alias("ordinal"), c["category"].alias("category"))).alias("s"))
    best = scored.select("item_id", F.posexplode(F.slice(F.array_sort("s"), 1, top)).alias("at", "s"))
    return best.select("item_id", F.col("s.category").alias("category"), (-F.col("s.down")).alias("score"), (F.col("at") + 1).alias("place"))


def prompts_for(items: DataFrame, routed: DataFrame, prompts: dict[str, str], default: str = "") -> DataFrame:
    """``items`` with prompt: the default one, and the suffix of the item's first category."""
    first = routed.filter("place = 1").select("item_id", "category")
    suffix = F.create_map(*[F.lit(x) for kv in prompts.items() for x in kv])[F.col("category")] if prompts else F.lit(None).cast("string")
    return items.join(first, "item_id", "left").withColumn("prompt", F.concat_ws("\n", F.nullif(F.lit(default), F.lit("")), suffix))


def distribution(routed: DataFrame) -> DataFrame:
    return routed.filter("place = 1").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
