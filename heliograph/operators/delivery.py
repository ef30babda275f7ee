"""Delivery of candidate batches: made, written as JSON, and checked line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA_VERSION, TOP_K, BRANCHES = "m5-to-m6-v1.0", 20, ("image", "text", "bm25")
# The fields of a batch and of a candidate.
BATCH_FIELDS = ("schema_version", "query_id", "query", "category", "split", "fusion_method", "top_k", "annotation_version", "index_manifest_sha256", "config_sha256", "candidates")
CANDIDATE_FIELDS = ("rank", "image_id", "relative_path", "fused_score", "branch_scores", "branch_ranks", "matched_fields")
# The codes of what can be wrong.
CODES = ("E_JSON_PARSE", "E_REQUIRED_FIELD", "E_UNKNOWN_FIELD", "E_SCHEMA_VERSION", "E_TOP_K", "E_DUPLICATE_QUERY_ID", "E_MANIFEST_MISMATCH", "E_CANDIDATE_COUNT", "E_RANK_SEQUENCE", "E_DUPLICATE_IMAGE_ID", "E_NONFINITE_SCORE", "E_BRANCH_KEYS", "E_BRANCH_NAME", "E_PATH_FORMAT", "E_PATH_SPLIT", "E_IMAGE_MISSING", "E_IMAGE_DECODE")


def batches(fused: DataFrame, n: int = TOP_K) -> tuple[DataFrame, DataFrame]:
    """(rows of queries with n candidates at least, n each; queries with fewer). From query_id, item_id, fused_score, rank."""
    counted = fused.filter(F.col("rank") <= n).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    return counted.filter(F.col("_n") == n).drop("_n"), counted.filter(F.col("_n") < n).select("query_id").distinct()


def full_batches(fused: DataFrame, n: int = TOP_K) -> DataFrame:
    """``batches``, or an error if a query has fewer than n candidates."""
    full, short = batches(fused, n)
    lacking = [r[0] for r in short.orderBy("query_id").limit(10).collect()]
    if lacking:
        raise ValueError(f"fewer than {n} candidates for queries {lacking}")
    return full


def with_fallback(hybrid: DataFrame, soft: DataFrame, n: int = TOP_K) -> DataFrame:
    """Rows of the strict filter mode for queries where it leaves n of them, else those of the soft mode, with ``mode``."""
    w = Window.partitionBy("query_id")
    both = hybrid.withColumn("mode", F.lit("hybrid")).unionByName(soft.withColumn("mode", F.lit("soft")))
    strict = F.count_if((F.col("mode") == "hybrid") & (F.col("rank") <= n)).over(w)
    return both.withColumn("_n", strict).filter(F.col("mode") == F.when(F.col("_n") >= n, "hybrid").otherwise("soft")).drop("_n")


def lines(rows: DataFrame, header: dict[str, object]) -> DataFrame:
    """One JSON text a query, from candidate rows with query, category, relative_path, branch maps and matched_fields."""
    entry = F.struct("rank", F.col("item_id").cast("string").alias("image_id"), "relative_path", "fused_score", "branch_scores", "branch_ranks", "matched_fields")
    by_rank = lambda a, b: (a["rank"] - b["rank"]).cast("int")
    grouped = rows.groupBy("query_id", "query", "category").agg(F.array_sort(F.collect_list(entry), by_rank).alias("candidates"))  # TOP_K a query
    fixed = {"schema_version": SCHEMA_VERSION, "top_k": TOP_K} | header
    cols = [F.col(c) if c in grouped.columns else F.lit(fixed.get(c)).alias(c) for c in BATCH_FIELDS]
    return grouped.select(F.to_json(F.struct(*cols)).alias("value"))


def _number_array(map_json: Column) -> Column:
    return F.map_values(F.from_json(map_json, "map<string,string>"))


def _whole(v: Column) -> Column:
    return v.rlike("^-?[0-9]+$")


def _real(v: Column) -> Column:
    return v.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$")


def validate(text: DataFrame, manifest: DataFrame, expected: dict[str, str | None], roots: dict[str, str]) -> DataFrame:
    """From (line, value): line, candidate, code, message - a row for each thing that is wrong, once.

    ``manifest`` has image_id, relative_path, sha256; and, where the images were read, found_sha256 (null: no such file)
    and decode_error. ``expected`` has the digests and versions that a batch must name; ``roots`` the folder of a split.
    """
    rows = text.filter(F.trim("value") != "").select("line", "value", F.try_parse_json("value").alias("v"))
    j = lambda name: F.get_json_object("value", f"$.{name}")
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    is_object = F.trim("value").startswith("{")
    parsed = F.col("v").isNotNull()
    seen_before = F.row_number().over(Window.partitionBy(j("query_id")).orderBy("line")) > 1
    is_list = F.coalesce(j("candidates").startswith("["), F.lit(False))
    entries = F.from_json(j("candidates"), "array<string>")
    err = lambda ok, code, message: F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(None).cast("int").alias("candidate"), F.lit(code).alias("code"), F.lit(message).alias("message")))
    have = parsed & is_object
    top = [
        err(parsed, "E_JSON_PARSE", "not strict JSON"),
        F.when(parsed, err(is_object, "E_REQUIRED_FIELD", "not an object")),
        *[F.when(have, e) for e in (
            err(F.size(F.array_except(F.array(*map(F.lit, BATCH_FIELDS)), keys)) == 0, "E_REQUIRED_FIELD", "missing fields"),
            err(F.size(F.array_except(keys, F.array(*map(F.lit, BATCH_FIELDS)))) == 0, "E_UNKNOWN_FIELD", "unknown fields"),
            err(j("schema_version") == SCHEMA_VERSION, "E_SCHEMA_VERSION", "schema_version"),
            err(j("top_k") == str(TOP_K), "E_TOP_K", "top_k"),
            err(~F.col("_again") | j("query_id").isNull(), "E_DUPLICATE_QUERY_ID", "query_id came before"),
            *[err(j(k).eqNullSafe(F.lit(v)), "E_MANIFEST_MISMATCH", k) for k, v in expected.items()],
            err(is_list, "E_CANDIDATE_COUNT", "candidates are no array"),
            F.when(is_list, err(F.size(entries) == TOP_K, "E_CANDIDATE_COUNT", "number of candidates")),
        )],
    ]
    numbered = rows.withColumn("_again", seen_before)
    whole = numbered.select("line", F.inline(F.array_compact(F.array(*top))))

    each = rows.filter(parsed & is_object & is_list).select("line", j("split").alias("split"), F.posexplode(entries).alias("at", "value")).withColumn("candidate", F.col("at") + 1)
    each = each.withColumn("image_id", j("image_id")).withColumn("path", j("relative_path"))
    met = each.join(manifest.select(F.col("image_id"), F.col("relative_path").alias("m_path"), *[F.col(c) if c in manifest.columns else F.lit(None).cast("string").alias(c) for c in ("sha256", "found_sha256", "decode_error")]), "image_id", "left")
    met = met.withColumn("_again", F.row_number().over(Window.partitionBy("line", "image_id").orderBy("candidate")) > 1)
    cerr = lambda ok, code, message: F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.col("candidate").cast("int").alias("candidate"), F.lit(code).alias("code"), F.lit(message).alias("message")))
    ckeys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    s_keys, r_keys = (F.array_sort(F.coalesce(F.json_object_keys(j(c)), F.array().cast("array<string>"))) for c in ("branch_scores", "branch_ranks"))
    good_path = F.col("path").isNotNull() & (F.col("path") != "") & ~F.col("path").contains("\\") & ~F.col("path").startswith("/")
    root = F.lit(None).cast("string")
    for split, folder in roots.items():
        root = F.when(F.col("split") == split, F.lit(folder.rstrip("/") + "/")).otherwise(root)
    inside = F.coalesce(F.col("path").startswith(root) & ~F.col("path").rlike(r"(^|/)\.\.(/|$)"), F.lit(False))
    read = "found_sha256" in manifest.columns
    checks = [
        cerr(F.size(F.array_except(F.array(*map(F.lit, CANDIDATE_FIELDS)), ckeys)) == 0, "E_REQUIRED_FIELD", "missing candidate fields"),
        cerr(F.size(F.array_except(ckeys, F.array(*map(F.lit, CANDIDATE_FIELDS)))) == 0, "E_UNKNOWN_FIELD", "unknown candidate fields"),
        cerr(j("rank") == F.col("candidate").cast("string"), "E_RANK_SEQUENCE", "rank"),
        cerr(~F.col("_again") | F.col("image_id").isNull(), "E_DUPLICATE_IMAGE_ID", "image_id came before"),
        cerr(_real(j("fused_score")), "E_NONFINITE_SCORE", "fused_score"),
        cerr((F.size(s_keys) > 0) & (s_keys == r_keys), "E_BRANCH_KEYS", "branch keys"),
        cerr(F.size(F.array_except(F.array_union(s_keys, r_keys), F.array(*map(F.lit, BRANCHES)))) == 0, "E_BRANCH_NAME", "unknown branch"),
        cerr(F.forall(F.coalesce(_number_array(j("branch_scores")), F.array().cast("array<string>")), _real), "E_NONFINITE_SCORE", "branch score"),
        cerr(F.forall(F.coalesce(_number_array(j("branch_ranks")), F.array().cast("array<string>")), lambda v: _whole(v) & ~v.startswith("-") & (v != "0")), "E_BRANCH_KEYS", "branch ranks"),
        cerr(good_path, "E_PATH_FORMAT", "relative_path"),
        F.when(good_path, cerr(inside, "E_PATH_SPLIT", "outside its split")),
        F.when(good_path & inside, cerr(F.col("m_path") == F.col("path"), "E_MANIFEST_MISMATCH", "image_id or path")),
    ]
    if read:
        checks += [
            F.when(good_path & inside, cerr(F.col("found_sha256").isNotNull(), "E_IMAGE_MISSING", "no such file")),
            F.when(good_path & inside & F.col("found_sha256").isNotNull(), cerr(F.col("decode_error").isNull(), "E_IMAGE_DECODE", "can't be decoded")),
            F.when(good_path & inside & F.col("found_sha256").isNotNull() & F.col("decode_error").isNull(), cerr(F.col("found_sha256") == F.col("sha256"), "E_MANIFEST_MISMATCH", "sha256")),
        ]
    return whole.unionByName(met.select("line", F.inline(F.array_compact(F.array(*checks))))).distinct()
