"""Judgments, evaluation sets and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRADES = (1, 2)


def parse_judgments(text: DataFrame) -> DataFrame:
    """From (query_id, judgments: `id:grade` by line or semicolon): query_id, item_id, relevance, error.

    Grade 0 drops; an entry of another form, or a repeated id, is a row with ``error``.
    """
    parts = text.select("query_id", F.posexplode(F.split(F.replace(F.col("judgments"), F.lit("；"), F.lit(";")), r"[;\n]")).alias("at", "raw")).withColumn("raw", F.trim("raw")).filter("raw <> ''")
    form = r"^(\S+?)\s*[:：]\s*([012])$"
    out = parts.withColumn("item_id", F.nullif(F.regexp_extract("raw", form, 1), F.lit(""))).withColumn("relevance", F.nullif(F.regexp_extract("raw", form, 2), F.lit("")).cast("int"))
    again = (F.row_number().over(Window.partitionBy("query_id", "item_id").orderBy("at")) > 1) & F.col("item_id").isNotNull()
    out = out.withColumn("error", F.when(F.col("item_id").isNull(), "form").when(again, "repeated"))
    return out.filter(F.col("error").isNotNull() | (F.col("relevance") > 0)).select("query_id", "item_id", "relevance", "error")


def format_judgments(rows: DataFrame) -> DataFrame:
    """query_id, judgments: one `id:grade` a line, by id."""
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "relevance"))), lambda x: F.concat_ws(":", x["item_id"].cast("string"), x["relevance"].cast("string"))), "\n").alias("judgments"))


def last_wins(rows: DataFrame, order: str) -> DataFrame:
    """Judgments with one row a query and item: the last by ``order``."""
    return rows.groupBy("query_id", "item_id").agg(F.max_by("relevance", order).alias("relevance"))


def replace_query(rows: DataFrame, new: DataFrame) -> DataFrame:
    """``rows`` without those of the queries in ``new``, and the rows of ``new``."""
    return rows.join(new.select("query_id").distinct(), "query_id", "left_anti").unionByName(new.select(*rows.columns))


def reviewed(tasks: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks with their review's text, category, annotator and flag; errors). From reviews with judgments too."""
    judged = parse_judgments(reviews.select("query_id", "judgments"))
    best = judged.groupBy("query_id").agg(F.max("relevance").alias("best"), F.max("error").alias("bad"))
    checked = reviews.join(best, "query_id", "left")
    rule = F.when(F.trim("text") == "", "no text").when(F.trim("annotator") == "", "no annotator").when(F.col("bad").isNotNull(), F.concat(F.lit("judgments: "), F.col("bad"))).when(F.col("reviewed") & F.coalesce(F.col("best") < 2, F.lit(True)), "no grade 2")
    checked = checked.withColumn("error", rule)
    good = checked.filter("error is null").select("query_id", *[F.trim(c).alias(f"_{c}") for c in ("text", "category", "annotator")], F.col("reviewed").alias("_reviewed"))
    out = tasks.join(good, "query_id", "left")
    for c in ("text", "category", "annotator", "reviewed"):
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.drop("_text", "_category", "_annotator", "_reviewed"), checked.filter("error is not null").select("query_id", "error")


def set_errors(tasks: DataFrame, judged: DataFrame, items: DataFrame, expected: int | None = None) -> DataFrame:
    """query_id, error: everything that an evaluation set's rules find."""
    found = [
        tasks.groupBy("query_id").count().filter("count > 1").select("query_id", F.lit("repeated query").alias("error")),
        tasks.filter(F.coalesce(F.trim("text") == "", F.lit(True))).select("query_id", F.lit("no text").alias("error")),
        tasks.filter(~F.coalesce(F.col("reviewed"), F.lit(False))).select("query_id", F.lit("not reviewed").alias("error")),
        tasks.filter(F.coalesce(F.trim("annotator") == "", F.lit(True)) | F.col("annotator").contains("auto_seed")).select("query_id", F.lit("annotator").alias("error")),
        judged.groupBy("query_id", "item_id").count().filter("count > 1").select("query_id", F.lit("repeated judgment").alias("error")),
        judged.filter(~F.col("relevance").isin(*GRADES)).select("query_id", F.lit("grade").alias("error")),
        judged.join(tasks, "query_id", "left_anti").select("query_id", F.lit("unknown query").alias("error")),
        judged.join(items, "item_id", "left_anti").select("query_id", F.lit("unknown item").alias("error")),
        tasks.join(judged.filter("relevance = 2"), "query_id", "left_anti").select("query_id", F.lit("no grade 2").alias("error")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    if expected is not None:
        out = out.unionByName(tasks.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != expected).select(F.lit(None).cast(dict(tasks.dtypes)["query_id"]).alias("query_id"), F.lit("number of tasks").alias("error")))
    return out.distinct()


def set_facts(tasks: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: tasks, judgments, tasks by category (category=n, in order) and the annotators."""
    by = tasks.groupBy("category").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "n"))), lambda x: F.concat_ws("=", x["category"], x["n"].cast("string"))), ",").alias("categories"))  # a category a row
    facts = tasks.agg(F.count(F.lit(1)).alias("tasks"), F.array_join(F.array_sort(F.collect_set("annotator")), ",").alias("annotators"))
    return facts.crossJoin(F.broadcast(by)).crossJoin(F.broadcast(judged.agg(F.count(F.lit(1)).alias("judgments"))))  # one row each


def refuse(queries: DataFrame, judged: DataFrame, most: int = 10) -> None:
    """An evaluation's guard: raises if a query has no text, no category, isn't reviewed or is an automatic seed, repeats, or has no judgment."""
    text = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = queries.filter(text("text") | text("category") | ~F.coalesce("reviewed", F.lit(False)) | (F.col("category") == "auto_seed"))
    twice = queries.groupBy("query_id").count().filter("count > 1")
    bare = queries.join(judged, "query_id", "left_anti")
    if queries.isEmpty():
        raise ValueError("evaluation refused: no queries")
    for what, found in (("not reviewed, without text or category, or seeds", bad), ("repeated", twice), ("without judgments", bare)):
        ids = [r[0] for r in found.select("query_id").distinct().orderBy("query_id").limit(most).collect()]
        if ids:
            raise ValueError(f"evaluation refused: queries {what}: {ids}")


def seeded(items: DataFrame, n: int) -> DataFrame:
    """The first n items by id as queries q001, q002, ... with a grade-2 judgment of the item itself, marked auto_seed."""
    first = items.orderBy("item_id").limit(n)
    numbered = first.withColumn("_k", F.row_number().over(Window.orderBy("item_id")))  # n rows
    return numbered.select(F.concat(F.lit("q"), F.lpad(F.col("_k").cast("string"), 3, "0")).alias("query_id"), "item_id", F.lit(2).alias("relevance"), F.lit("auto_seed").alias("annotator"))


def sample(items: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n items by a seeded hash of their ids, then in order of id."""
    return items.orderBy(F.xxhash64(F.lit(seed), "item_id"), "item_id").limit(n).orderBy("item_id")


def blank_tasks(manifest: DataFrame, n: int, seed: int = 20260810) -> DataFrame:
    """Tasks for people, with nothing in them but the item to look at: query_id, item_id, relative_path and empty fields.

    Items are drawn, by a seed, from the manifest's usable ones; fewer than ``n`` are an error. No query or judgment is made.
    """
    if n <= 0:
        raise ValueError("the number of tasks must be positive")
    usable = manifest.filter(F.col("valid") & F.col("duplicate_of").isNull())
    drawn = sample(usable.select("item_id", *[c for c in ("relative_path",) if c in manifest.columns]), n, seed)
    if (have := drawn.count()) < n:
        raise ValueError(f"{n} tasks are asked for, of {have} usable items")
    numbered = drawn.withColumn("_k", F.row_number().over(Window.orderBy("item_id")))  # n rows
    blank = lambda name: F.lit("").alias(name)
    return numbered.select(F.concat(F.lit("q"), F.lpad(F.col("_k").cast("string"), 3, "0")).alias("query_id"), *drawn.columns, blank("text"), blank("category"), blank("annotator"), F.lit(False).alias("reviewed"), blank("note"))


#: Items of a ring that are sorted in a task.
RING_ROWS = 50_000


def ring(rows: DataFrame, by: tuple[str, ...], n: int, name: str) -> DataFrame:
    """``rows`` (item_id, _h) with the next item of its ring: items by hash, the last one's next being the first.

    A ring (of the rows with equal ``by``) is cut in buckets by hash, of about RING_ROWS rows; a bucket's last item goes on
    to the first of the next bucket that has any.
    """
    cut = rows.withColumn("_b", F.pmod("_h", F.lit(1 + n // RING_ROWS)))
    inside = Window.partitionBy(*by, "_b").orderBy("_h", "item_id")
    around = Window.partitionBy(*by).orderBy("_b")  # a row a bucket
    heads = cut.groupBy(*by, "_b").agg(F.min(F.struct("_h", "item_id")).alias("f")).withColumn("head", F.col("f.item_id"))
    heads = heads.select(*by, "_b", F.coalesce(F.lead("head").over(around), F.first("head").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_next"))
    last = cut.withColumn("_lead", F.lead("item_id").over(inside))
    keyed = last.join(heads.withColumnsRenamed({c: f"_k_{c}" for c in by}).withColumnRenamed("_b", "_k_b"), (F.col("_b") == F.col("_k_b")) & _same(by), "left")
    return keyed.withColumn(name, F.coalesce("_lead", "_next")).drop("_b", "_lead", "_next", "_k_b", *[f"_k_{c}" for c in by])


def _same(by: tuple[str, ...]):
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return out


def training_pairs(annotations: DataFrame, seed: int = 20260802, split: str | None = "split") -> DataFrame:
    """From (item_id, scene, queries, and a split if there is one): query, item_id, negative_item_id, negative_kind.

    An item's first query gets a negative of its own scene (the next one in a hashed ring of the scene's items), its other
    ones - and those of a scene's only item - one from the ring of all items. A ring's neighbour stands for a random pick:
    it needs no pairing of a scene's items with each other. Items of another split than Train are refused.
    """
    if split and split in annotations.columns:
        if not annotations.filter(F.col(split) != "Train").isEmpty():
            raise ValueError("training pairs are made of the Train split only")
        annotations = annotations.drop(split)
    n = annotations.count()
    if n < 2:
        raise ValueError("training pairs need two items")
    ringed = ring(ring(annotations.withColumn("_h", F.xxhash64(F.lit(seed), "item_id")), ("scene",), n, "hard"), (), n, "random")
    each = ringed.select("item_id", "hard", "random", F.posexplode("queries").alias("at", "query"))
    is_hard = (F.col("at") == 0) & (F.col("hard") != F.col("item_id"))
    return each.select("query", "item_id", F.when(is_hard, F.col("hard")).otherwise(F.col("random")).alias("negative_item_id"), F.when(is_hard, "hard").otherwise("random").alias("negative_kind"))


def training_triples(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """query, positive, negative and negative_kind: the texts of pairs, from (item_id, document)."""
    negatives = documents.select(F.col("item_id").alias("negative_item_id"), F.col("document").alias("negative"))
    return pairs.join(documents.select("item_id", F.col("document").alias("positive")), "item_id").join(negatives, "negative_item_id").select("query", "positive", "negative", "negative_kind", "item_id", "negative_item_id")


def train_split(pairs: DataFrame, share: float = 0.9) -> DataFrame:
    """``pairs`` with ``part``: train or dev, by a hash of the item."""
    return pairs.withColumn("part", F.when(F.pmod(F.xxhash64("item_id"), F.lit(1000)) < int(share * 1000), "train").otherwise("dev"))
