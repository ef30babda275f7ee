"""Structured filters: what a parsed query asks of an annotation, decided with reasons in one pass over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.aliases import Catalog, met
from heliograph.functions.text import none_of_strings, normalize, unique_strings
from heliograph.operators.documents import FIELDS

MODES = ("soft", "hard", "hybrid")
SLOTS = ("objects", "actions", "scene", "time_of_day", "weather", "mood", "colors", "style")
#: Slots whose miss rejects in hybrid mode too.
STRICT = ("time_of_day", "weather")


def partial_of(check, slot: str, strict: bool):
    """A function of one argument: the number of arguments tells Spark what a lambda is given."""

    def run(t: Column) -> Column:
        return check(t, slot, strict)

    return run


def _hit(x: Column, slot: str, _: bool) -> Column:
    return F.struct(x["t"].alias("t"), met(x["a"], F.col(f"n.{slot}")).alias("hit"))


def _terms(name: str, columns: list[str]) -> Column:
    return unique_strings(F.col(name)) if name in columns else none_of_strings()


def decide(pairs: DataFrame, catalog: Catalog | None = None, mode: str = "hybrid") -> DataFrame:
    """``pairs`` (a query's slots beside an annotation's ``n``, ``f`` and object_counts) with allowed, matched_fields, evidence and mismatch.

    Excluded terms reject on a hit in their home field (in any field, if they have none there); required and OCR terms
    reject on a miss; so does a count that is unknown or doesn't hold. A positive slot's miss rejects only where the
    field has values, in hard mode or in a strict slot of hybrid mode. Slots that ``pairs`` lacks ask nothing.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    catalog = catalog or Catalog()
    have = pairs.columns
    checks: list[Column] = []
    kind = "struct<ok:boolean,fields:array<string>,evidence:string,mismatch:string>"

    def item(ok: Column, fields: Column, good: Column, bad: Column) -> Column:
        return F.struct(ok.alias("ok"), F.when(ok, fields).otherwise(none_of_strings()).alias("fields"), F.when(ok, good).alias("evidence"), F.when(~ok, bad).alias("mismatch"))

    def with_hits(terms: Column) -> Column:
        hits = lambda x: F.array_compact(F.array(*[F.when(met(x["a"], F.col(f"n.{c}")), F.lit(c)) for c in FIELDS]))
        return F.transform(catalog.expanded(terms), lambda x: F.struct(x["t"].alias("t"), x["home"].alias("home"), hits(x).alias("hits")))

    def at_home(x: Column) -> Column:
        anywhere = x["home"].isNull() | ~x["home"].isin(*FIELDS)
        return F.struct(x["t"].alias("t"), F.filter(x["hits"], lambda c: anywhere | (c == x["home"])).alias("hits"))

    if "excluded_terms" in have:
        checks.append(F.transform(F.transform(with_hits(_terms("excluded_terms", have)), at_home), lambda x: item(F.size(x["hits"]) == 0, none_of_strings(), F.lit(None).cast("string"), F.concat(F.lit("excluded:"), x["t"], F.lit("("), F.array_join(x["hits"], ","), F.lit(")")))))
    if "required_terms" in have:
        checks.append(F.transform(with_hits(_terms("required_terms", have)), lambda x: item(F.size(x["hits"]) > 0, x["hits"], F.concat(F.lit("required:"), x["t"]), F.concat(F.lit("missing:"), x["t"]))))
    if "ocr_terms" in have:
        read = F.transform(catalog.expanded(_terms("ocr_terms", have)), lambda x: F.struct(x["t"].alias("t"), met(x["a"], F.col("n.ocr_text")).alias("ok")))
        checks.append(F.transform(read, lambda x: item(x["ok"], F.array(F.lit("ocr_text")), F.concat(F.lit("ocr:"), x["t"]), F.concat(F.lit("no ocr:"), x["t"]))))
    if {"count_target", "count_value"} <= set(have):
        asked = F.col("count_target").isNotNull() & F.col("count_value").isNotNull()
        actual = F.get(F.filter(F.coalesce("object_counts", F.array().cast("array<struct<name:string,count:int>>")), lambda x: catalog.matches(F.col("count_target"), F.array(normalize(x["name"])))), F.lit(0))["count"]
        op = F.coalesce("count_operator", F.lit("eq")) if "count_operator" in have else F.lit("eq")
        holds = F.coalesce(F.when(op == "gte", actual >= F.col("count_value")).when(op == "lte", actual <= F.col("count_value")).otherwise(actual == F.col("count_value")), F.lit(False))
        told = F.concat(F.col("count_target"), F.lit("="), F.coalesce(actual.cast("string"), F.lit("unknown")), F.lit("("), op, F.col("count_value").cast("string"), F.lit(")"))
        checks.append(F.when(asked, F.array(item(holds, F.array(F.lit("object_counts")), F.concat(F.lit("count:"), told), F.concat(F.lit("wrong count:"), told)))).otherwise(F.array().cast(f"array<{kind}>")))
    for slot in SLOTS:
        if slot not in have:
            continue
        strict = mode == "hard" or (mode == "hybrid" and slot in STRICT)
        not_excluded = F.filter(F.coalesce(F.col(slot), none_of_strings()), lambda t: ~F.array_contains(F.col("excluded_terms") if "excluded_terms" in have else none_of_strings(), t))

        def checked(x: Column, slot: str, strict: bool) -> Column:
            t, hit = x["t"], x["hit"]
            rejects = (F.size(f"f.{slot}") > 0) & F.lit(strict)
            return F.struct((hit | ~rejects).alias("ok"), F.when(hit, F.array(F.lit(slot))).otherwise(none_of_strings()).alias("fields"), F.when(hit, F.concat(F.lit(f"{slot}:"), t)).alias("evidence"), F.when(~hit & rejects, F.concat(F.lit(f"no {slot}:"), t)).alias("mismatch"))

        found = F.transform(catalog.expanded(not_excluded), partial_of(_hit, slot, strict))
        checks.append(F.transform(found, partial_of(checked, slot, strict)))
    every = F.concat(*checks) if checks else F.array().cast(f"array<{kind}>")
    out = pairs.withColumn("_checks", every)
    return out.select(
        *have,
        F.forall("_checks", lambda c: c["ok"]).alias("allowed"),
        F.array_distinct(F.flatten(F.transform("_checks", lambda c: c["fields"]))).alias("matched_fields"),
        F.array_distinct(F.array_compact(F.transform("_checks", lambda c: c["evidence"]))).alias("evidence"),
        F.array_distinct(F.array_compact(F.transform("_checks", lambda c: c["mismatch"]))).alias("mismatch"),
    )
