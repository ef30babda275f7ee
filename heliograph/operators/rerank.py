"""Reranking: a scorer's answers are columns; here they are combined, repaired and measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.payloads import extract_object
from heliograph.functions.text import none_of_strings


def pointwise(candidates: DataFrame, fused_weight: float = 0.35, scorer_weight: float = 0.65) -> DataFrame:
    """From (query_id, item_id, fused_score, response: 0 to 100, error): with rerank_score, combined, mismatch and new_rank.

    rerank_score is the response within 0 and 100, and 0 if it is NaN or the scorer failed, of which mismatch (a list, the
    candidates' own if they have one) then tells alone. The order is that of
    ``combined``, the weighted sum of the relative fused score and rerank_score / 100 - a failed item keeps its first part -
    and ties go by id. If the best fused score is 0, fused scores count as they are.
    """
    top = F.max("fused_score").over(Window.partitionBy("query_id"))
    relative = F.col("fused_score") / F.when(top == 0, 1.0).otherwise(top)
    ok = F.col("error").isNull() & F.col("response").isNotNull()
    score = F.when(ok, _within(F.col("response"))).otherwise(0.0)
    told = F.col("mismatch") if "mismatch" in candidates.columns else none_of_strings()
    out = candidates.withColumn("rerank_score", score).withColumn("combined", fused_weight * relative + scorer_weight * score / 100)
    out = out.withColumn("mismatch", F.when(~ok, F.array(F.concat(F.lit("rerank failed: "), F.coalesce("error", F.lit("no response"))))).otherwise(told))
    by = Window.partitionBy("query_id").orderBy(F.round("combined", 9).desc(), "item_id")
    return out.withColumn("new_rank", F.row_number().over(by))


def _within(score: Column) -> Column:
    """From 0 to 100; NaN, which is greater than any number to Spark, is 0."""
    return F.when(F.isnan(score), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def pointwise_answers(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """``candidates`` with response, error, evidence and mismatch, from (query_id, item_id, answer: prose with a JSON object, or null).

    An answer that names another item, or whose score is no number, fails; one without a score has 0. Evidence and mismatch
    (lists of texts) are the answer's; where it fails, the candidates' own stay, or are empty.
    """
    got = answers.select("query_id", "item_id", extract_object(F.col("answer")).alias("j"))
    met = candidates.join(got, ["query_id", "item_id"], "left")
    name, score = F.trim(F.coalesce(F.get_json_object("j", "$.image_id"), F.lit(""))), F.get_json_object("j", "$.score")
    number = F.when(score.isNull(), 0.0).otherwise(score.try_cast("double"))
    error = F.when(F.col("j").isNull(), "no JSON object").when((name != "") & (name != F.col("item_id").cast("string")), F.concat(F.lit("names "), name)).when(number.isNull(), "score is no number")
    out = met.withColumn("error", error).withColumn("response", F.when(error.isNull(), number))
    for name in ("evidence", "mismatch"):
        own = F.col(name) if name in candidates.columns else none_of_strings()
        out = out.withColumn(name, F.when(F.col("error").isNull(), texts(F.get_json_object("j", f"$.{name}"))).otherwise(own))
    return out.drop("j")


def texts(raw: Column) -> Column:
    """A field's JSON text as a list of texts that aren't blank: of an array its entries, of anything else itself."""
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    return F.filter(F.transform(F.coalesce(listed, F.when(raw.isNotNull(), F.array(raw)), none_of_strings()), lambda t: F.trim(t)), lambda t: t != "")


def listwise(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """From candidates (query_id, item_id, rank) and answers (query_id, answer: prose with a JSON ranking).

    Entries name an item by id or by its place in digits, with a score or without one (then 100 (n - place) / max(1, n - 1)).
    Repeated entries drop, missing items follow with 0; an unknown entry, a score that is no number, or no ranking leaves
    the query's order as it was, with ``error``. Returns query_id, item_id, new_rank, score, degraded, error.
    """
    sizes = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    got = answers.select("query_id", extract_object(F.col("answer")).alias("j"))
    entries = got.select("query_id", F.posexplode_outer(F.from_json(F.get_json_object("j", "$.ranking"), "array<string>")).alias("place", "e"))
    name = F.trim(F.coalesce(F.get_json_object("e", "$.image_id"), F.get_json_object("e", "$.item_id"), F.get_json_object("e", "$.index"), F.when(~F.col("e").startswith("{"), F.col("e"))))
    said = F.get_json_object("e", "$.score")
    entries = entries.select("query_id", (F.col("place") + 1).alias("place"), name.alias("name"), said.try_cast("double").alias("score"), (said.isNotNull() & said.try_cast("double").isNull()).alias("bad"))
    entries = entries.withColumn("at", F.when(F.col("name").rlike("^[0-9]{1,9}$"), F.col("name").cast("int")))
    by_id = candidates.select("query_id", F.col("item_id").alias("_id"), F.col("item_id").cast("string").alias("name"))
    by_place = candidates.select("query_id", F.col("item_id").alias("_at"), F.col("rank").cast("int").alias("at"))
    met = entries.join(by_id, ["query_id", "name"], "left").join(by_place, ["query_id", "at"], "left").withColumn("item_id", F.coalesce("_id", "_at"))
    bad = met.groupBy("query_id").agg(F.count_if(F.col("item_id").isNull() | F.coalesce("bad", F.lit(False))).alias("unknown"), F.count("name").alias("named"))
    first = met.filter("item_id is not null").groupBy("query_id", "item_id").agg(F.min(F.struct("place", "score")).alias("f"), F.count(F.lit(1)).alias("times"))
    all_ = candidates.join(sizes, "query_id").join(bad, "query_id", "left").join(first, ["query_id", "item_id"], "left")
    failed = F.coalesce(F.col("unknown") > 0, F.lit(True)) | F.coalesce(F.col("named") == 0, F.lit(True))
    told = F.when(F.col("f.score").isNotNull(), _within(F.col("f.score")))  # least() passes over nulls
    given = F.coalesce(told, 100.0 * (F.col("n") - F.col("f.place")) / F.greatest(F.lit(1), F.col("n") - 1))
    w = Window.partitionBy("query_id")
    out = all_.withColumn("error", F.when(failed, "no valid ranking")).withColumn("score", F.when(failed, 0.0).otherwise(F.coalesce(given, F.lit(0.0))))
    out = out.withColumn("degraded", ~failed & (F.max(F.coalesce("times", F.lit(0)) > 1).over(w) | F.max(F.col("f").isNull()).over(w)))
    order = w.orderBy(F.when(failed, F.lit(None)).otherwise(F.col("f.place")).asc_nulls_last(), "rank")
    return out.select("query_id", "item_id", F.row_number().over(order).alias("new_rank"), "score", "degraded", "error")


def latency_suite(runs: DataFrame) -> DataFrame:
    """From (run, query_id, category, top_k, latency_ms, success, and peak_bytes if it was measured): a row for each scope and group.

    Scopes: overall, cold (the first run of all), warm, top_k and category. Latencies are of successful runs only; they,
    and the peak, are null where there is none. One pass: a run is spread to its scopes, then grouped.
    """
    first = runs.agg(F.min("run").alias("first"))
    marked = runs.crossJoin(F.broadcast(first)).withColumn("phase", F.when(F.col("run") == F.col("first"), "cold").otherwise("warm"))  # one row
    scopes = F.array(*[F.struct(F.lit(s).alias("scope"), g.cast("string").alias("group")) for s, g in (("overall", F.lit("all")), ("phase", F.col("phase")), ("top_k", F.col("top_k")), ("category", F.col("category")))])
    good = F.when(F.col("success"), F.col("latency_ms"))
    if "peak_bytes" not in marked.columns:
        marked = marked.withColumn("peak_bytes", F.lit(None).cast("long"))
    spread = marked.select("latency_ms", "success", "peak_bytes", F.inline(scopes))
    return spread.groupBy("scope", "group").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("success")).alias("failures"), (F.count_if(~F.col("success")) / F.count(F.lit(1))).alias("failure_rate"),
        F.avg(good).alias("mean"), F.percentile(good, 0.5).alias("p50"), F.percentile(good, 0.95).alias("p95"), F.max("peak_bytes").alias("peak_bytes"),
    )


def speed_up(runs: DataFrame) -> DataFrame:
    """From (method, query_id, latency_ms, success): one row; pointwise over listwise time a query, null if that is 0."""
    per = runs.groupBy("query_id").agg(F.sum(F.when(F.col("method") == "pointwise", F.col("latency_ms"))).alias("p"), F.sum(F.when(F.col("method") == "listwise", F.col("latency_ms"))).alias("l"))
    return per.agg(F.avg("p").alias("pointwise_ms"), F.avg("l").alias("listwise_ms")).withColumn("speed_up", F.col("pointwise_ms") / F.nullif(F.col("listwise_ms"), F.lit(0.0)))


def benchmark(runs: DataFrame, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """From (repeat, latency_ms, success, degraded, peak_bytes and ``by``): runs, failures, degraded ones, latencies and peaks.

    repeat_total_ms is the list of each repeat's total, in order of repeats; rates are of all runs, the mean of those that have
    a latency. Latencies count to a millionth and are summed exactly, so that their order decides no digit.
    """
    repeats = runs.groupBy(*by, "repeat").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("f"), F.count_if("degraded").alias("d"), F.count("latency_ms").alias("m"), F.sum(F.col("latency_ms").cast("decimal(28,6)")).alias("t"), F.max("peak_bytes").alias("p"),
    )
    n, total = F.sum("n"), F.sum("t").cast("double")
    return repeats.groupBy(*by).agg(
        n.alias("runs"), F.sum("f").alias("failures"), (F.sum("f") / n).alias("failure_rate"), F.sum("d").alias("degraded"), (F.sum("d") / n).alias("degraded_rate"), (total / F.nullif(F.sum("m"), F.lit(0))).alias("mean_ms"), total.alias("total_ms"),
        F.transform(F.array_sort(F.collect_list(F.struct("repeat", "t"))), lambda x: x["t"].cast("double")).alias("repeat_total_ms"), F.max("p").alias("peak_bytes"),
    )


def image_size(width: Column, height: Column, most_pixels: int) -> Column:
    """struct(width, height) of an image under a cap of pixels, its shape kept; never under a pixel a side."""
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(most_pixels)) / (width * height)))
    side = lambda x: F.greatest(F.lit(1), F.floor(x * scale)).cast("long")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def sheet_size(n: Column, columns: int = 5, tile: int = 192) -> Column:
    """struct(rows, width, height) of a contact sheet of ``n`` tiles."""
    rows = F.ceil(n / columns).cast("long")
    return F.struct(rows.alias("rows"), F.lit(columns * tile).cast("long").alias("width"), (rows * tile).alias("height"))
