"""Manifests: first-wins duplicates, quality counts, reconciliation and resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators.skew import dealt_join
from heliograph.sources.tables import kept


def mark_duplicates(items: DataFrame, digest: str = "sha256", order: tuple[str, ...] = ("item_id",), id: str = "item_id") -> DataFrame:
    """``items`` with duplicate_of: the first item, by ``order``, with the same digest; null for that one and for null digests.

    The first item of each digest is found by an aggregation that merges on the map side, so a digest with very many
    items costs one row a task; only digests of several items are joined back, dealt over several tasks each.
    """
    place = F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.col(id).alias("first"))
    first = items.filter(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(place).alias("_f"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return dealt_join(items, first, [digest], id).withColumn("duplicate_of", F.when(F.col("_f.first") != F.col(id), F.col("_f.first"))).drop("_f")


def mark_across(items: DataFrame, split_rank: Column, digest: str = "sha256", id: str = "item_id", split: str = "split") -> DataFrame:
    """Duplicates inside a split first; then across splits, in the order of ``split_rank``, marks that exist being kept."""
    inner = items.groupBy(digest, split).agg(F.min(id).alias("_in"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    over = items.groupBy(digest).agg(F.min(F.struct(split_rank.alias("s"), F.col(id).alias("i"))).alias("_over"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    joined = dealt_join(dealt_join(items, inner, [digest, split], id), over, [digest], id)
    own = F.when(F.col("_in") != F.col(id), F.col("_in"))
    across = F.when(F.col("_over.i") != F.col(id), F.col("_over.i"))
    return joined.withColumn("duplicate_of", F.coalesce(own, across)).drop("_in", "_over")


def quality(manifest: DataFrame) -> DataFrame:
    """One row: items, valid and invalid ones, duplicates and bytes."""
    return manifest.agg(
        F.count(F.lit(1)).alias("items"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"),
        F.count("duplicate_of").alias("duplicates"), F.sum("size_bytes").alias("bytes"),
    )


def faults(manifest: DataFrame, id: str = "item_id") -> DataFrame:
    """item_id, fault (invalid or duplicate), detail: the error, or the item that it is a duplicate of."""
    error = F.col("error") if "error" in manifest.columns else F.lit(None).cast("string")
    invalid = manifest.filter(~F.col("valid")).select(F.col(id).alias("item_id"), F.lit("invalid").alias("fault"), error.alias("detail"))
    twice = manifest.filter(F.col("duplicate_of").isNotNull()).select(F.col(id).alias("item_id"), F.lit("duplicate").alias("fault"), F.col("duplicate_of").cast("string").alias("detail"))
    return invalid.unionByName(twice)


def usable(manifest: DataFrame, split: str | None = None, limit: int | None = None) -> DataFrame:
    """Valid items that are no duplicates, by id; ids must not repeat (see ``repeated_ids``)."""
    out = manifest.filter(F.col("valid") & F.col("duplicate_of").isNull())
    out = out.filter(F.col("split") == split) if split is not None else out
    out = out.orderBy("item_id")
    return out.limit(limit) if limit is not None else out


def repeated_ids(manifest: DataFrame, id: str = "item_id") -> DataFrame:
    return manifest.groupBy(id).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def reconcile(manifest: DataFrame, annotations: DataFrame, compare: tuple[str, ...], id: str = "item_id") -> DataFrame:
    """id, status: matched, missing (no annotation), extra (no item) or mismatched (a compared column differs)."""
    a, b = manifest.select(id, F.struct(*compare).alias("a")), annotations.select(id, F.struct(*compare).alias("b"))
    both = a.join(b, id, "full")
    return both.select(id, F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "mismatched").otherwise("matched").alias("status"))


def pending(manifest: DataFrame, done: DataFrame, id: str = "item_id") -> DataFrame:
    """Valid items that are not annotated yet."""
    return manifest.filter("valid").join(done.select(id), id, "left_anti")


def selected(manifest: DataFrame, wanted: DataFrame, id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(the wanted items, wanted ids that the manifest lacks)."""
    return manifest.join(wanted.select(id).distinct(), id, "left_semi"), wanted.select(id).distinct().join(manifest, id, "left_anti")


def chosen(candidates: DataFrame, asked: DataFrame, fewest: int, most: int, id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(candidates that are asked for, by place; (query_id, error) of queries with unknown ids or a number out of bounds).

    ``candidates`` has query_id, item_id and rank; ``asked`` has query_id, item_id and place, a repeated id's first place
    counting. A query that asks for nothing takes its first ``most`` candidates.
    """
    first = asked.groupBy("query_id", id).agg(F.min("place").alias("place"))
    met = first.join(candidates.select("query_id", id, F.lit(True).alias("_known")), ["query_id", id], "left")
    unknown = met.filter("_known is null").select("query_id", F.lit("not among the candidates").alias("error")).distinct()
    free = candidates.join(asked.select("query_id").distinct(), "query_id", "left_anti").filter(F.col("rank") <= most).select("query_id", id, F.col("rank").alias("place"))
    taken = met.filter("_known").select("query_id", id, "place").unionByName(free)
    wrong = taken.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(~F.col("n").between(fewest, most)).select("query_id", F.concat(F.lit(f"{fewest} to {most} items are asked for, not "), F.col("n").cast("string")).alias("error"))
    errors = unknown.unionByName(wrong.join(unknown, "query_id", "left_anti"))
    by = Window.partitionBy("query_id").orderBy("place")
    return taken.join(errors, "query_id", "left_anti").withColumn("place", F.row_number().over(by)), errors


def numeric_suffix(value: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(value, r"(\d+)$", 1), F.lit("")), F.lit("999999999999999999")).cast("long")


def in_id_order(items: DataFrame, id: str = "item_id") -> DataFrame:
    """By what stands before a number at the id's end, then by that number."""
    return items.orderBy(F.regexp_replace(id, r"\d+$", ""), numeric_suffix(F.col(id)).asc_nulls_last(), id)


def placed(ordered: DataFrame) -> DataFrame:
    """``ordered`` (the result of a sort) with ``place`` from 1 on: rows are numbered where they lie, after those of the tasks before.

    No task holds more than a sort gives it; what is shared is a number a task.
    """
    table = kept(ordered.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)  # the number of a row's task, by Spark's definition of these ids
    sizes = table.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task
    starts = sizes.select("_task", before.alias("_before"))
    return table.withColumn("_task", task).join(F.broadcast(starts), "_task").withColumn("place", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_task", "_before")


def imported(raw: DataFrame, manifest: DataFrame, id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(raw rows with their item, failures): raw ids meet items by their numbers; later rows of an item fail, as do unknown ones."""
    keyed = manifest.select(F.col(id), numeric_suffix(F.col(id)).alias("_n"))
    if not keyed.groupBy("_n").count().filter("count > 1 and _n is not null").isEmpty():
        raise ValueError("ambiguous numbers among the manifest's ids")
    met = raw.withColumn("_n", numeric_suffix(F.col("raw_id"))).join(keyed, "_n", "left")
    numbered = met.withColumn("_k", F.row_number().over(Window.partitionBy(id).orderBy("line")))
    good = numbered.filter(F.col(id).isNotNull() & (F.col("_k") == 1)).drop("_n", "_k")
    bad = numbered.filter(F.col(id).isNull() | (F.col("_k") > 1)).select("raw_id", "line", F.when(F.col(id).isNull(), "not in manifest").otherwise("repeated").alias("error"))
    return good, bad


def id_digest(ids: DataFrame, id: str = "item_id") -> DataFrame:
    """SHA-256 of the ids in order, joined by line feeds: of a list of ids, as an index manifest has it.

    The digest is of one text of all ids, so it is made in one task; an index's manifest is for collections whose ids fit there.
    """
    return ids.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(id).cast("string"))), "\n").cast("binary"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def index_errors(stored: dict, items: dict, branches: list[str]) -> list[str]:
    """What differs between a stored index manifest and the data at hand."""
    errors = [f"{k} differs" for k in ("schema_version", "count", "digest", "annotation_version", "split") if stored.get(k) != items.get(k)]
    lacking = sorted(set(branches) - set(stored.get("branches", {})))
    return errors + ([f"branches not built: {lacking}"] if lacking else [])
