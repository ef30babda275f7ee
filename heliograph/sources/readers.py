"""Sources: file trees, JSON lines, judgments and images' stand-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.operators.manifest import mark_duplicates, numeric_suffix
from heliograph.sources import images
from heliograph.sources.tables import kept

# Endings of image files.
ENDINGS = ("jpg", "jpeg", "png", "webp", "bmp")
#: Paths that may be broadcast.
FEW_PATHS = 100_000


def scan_directory(spark: SparkSession, path: str, root: str = "", limit: int | None = None, decode=None, measured: bool = False) -> DataFrame:
    """item_id, relative_path, sha256, size_bytes, valid, error, duplicate_of of the image files under ``path``; none is an error.

    The listing (without contents) is cut to ``limit`` first, so that only files which stay are read. ``decode`` is a
    Column function from content to an error text or null. ``measured`` adds width, height and mode, from the files' headers;
    what has no image's header isn't valid then.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join([*ENDINGS, *map(str.upper, ENDINGS)]) + "}").load(path)
    named = files.withColumn("relative_path", F.regexp_replace("path", "^.*?" + (root or path).rstrip("/") + "/", ""))
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    if files.select("path").isEmpty():
        raise ValueError(f"no images under {path}")
    if limit is not None:
        first = named.select("path", "relative_path").orderBy(F.lower("relative_path")).limit(limit).select("path")
        named = named.join(F.broadcast(first) if limit <= FEW_PATHS else first, "path", "left_semi")
    error = decode(F.col("content")) if decode else F.when(F.col("length") == 0, "empty file")
    named, more, error = _measured(named, error) if measured else (named, [], error)
    hashed = named.select("relative_path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), error.alias("error"), *more)
    items = hashed.withColumn("item_id", F.concat(F.lit("val-"), F.substring(F.sha2(F.col("relative_path").cast("binary"), 256), 1, 12))).withColumn("valid", F.col("error").isNull())
    return mark_duplicates(items.withColumn("_order", F.lower("relative_path")), order=("_order",)).drop("_order")


def _measured(files: DataFrame, error: Column) -> tuple[DataFrame, list[Column], Column]:
    found = files.withColumn("_facts", images.facts(F.col("content")))
    more = [F.col(f"_facts.{c}").alias(c) for c in ("width", "height", "mode")]
    return found, more, F.coalesce(error, F.col("_facts.error"))


def scan_split(spark: SparkSession, path: str, split: str, decode=None, measured: bool = False) -> DataFrame:
    """The same of a flat folder of .jpg files, ids from their names' numbers, in numeric order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path)
    stem = F.regexp_extract("path", r"([^/]+)\.jpg$", 1)
    error = decode(F.col("content")) if decode else F.lit(None).cast("string")
    files, more, error = _measured(files, error) if measured else (files, [], error)
    items = files.select(F.concat(F.lit(split.lower() + "-"), stem).alias("item_id"), F.lit(split).alias("split"), F.concat(F.lit(split + "/"), stem, F.lit(".jpg")).alias("relative_path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), error.alias("error"), numeric_suffix(stem).alias("_n"), *more)
    return mark_duplicates(items.withColumn("valid", F.col("error").isNull()), order=("_n",)).drop("_n")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a known schema; a line that doesn't fit ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, line, value) of lines that hold an object, and (file, line, error) of those that don't; blank lines drop.

    Files are read in splits: a line's number is its place in its split after the lines of the file's splits before.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("value"))
    rows = kept(read)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    starts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    lines = rows.withColumn("place", place).join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("place")).cast("int").alias("line"), "value").filter(F.trim("value") != "")
    whole = F.try_parse_json("value").isNotNull()
    is_object = F.trim("value").startswith("{")
    return lines.filter(whole & is_object), lines.filter(~(whole & is_object)).select("file", "line", F.when(~whole, "not JSON").otherwise("not an object").alias("error"))


def judgments_csv(spark: SparkSession, path: str) -> DataFrame:
    """query_id, item_id, relevance; of repeated pairs the last line counts."""
    rows = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    placed = rows.select("query_id", F.col("image_id").alias("item_id"), F.col("relevance").cast("int").alias("relevance"), F.monotonically_increasing_id().alias("_at"))
    return placed.groupBy("query_id", "item_id").agg(F.max_by("relevance", "_at").alias("relevance"))


def rotated(items: DataFrame, queries: DataFrame, total: int, k: int = 10) -> DataFrame:
    """A stand-in for search: k items from a place that the query's hash gives, with scores 1 / rank.

    ``items`` has position 0 to total - 1. The k places of a query are generated and joined, not all items.
    """
    start = F.conv(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 8), 16, 10).cast("long") % total
    wanted = queries.select("query_id", start.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(min(k, total) - 1))).alias("i"))
    return wanted.select("query_id", ((F.col("s") + F.col("i")) % total).alias("position"), (F.col("i") + 1).alias("rank"), (1.0 / (F.col("i") + 1)).alias("score")).join(items, "position").select("query_id", "item_id", "rank", "score")


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)
