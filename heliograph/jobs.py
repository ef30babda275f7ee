"""Jobs for spark-submit: `python -m heliograph.jobs <job> ...`. Tables are Parquet folders, reports are folders of files."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators import delivery, judging, parsing
from heliograph.plans import directory, evaluation, indexing
from heliograph.plans.search import Searcher
from heliograph.sources import readers, sinks, tables


def _searcher(spark: SparkSession, a: argparse.Namespace) -> Searcher:
    """A searcher over a folder of indexes; encoded queries are tables (query_id, vector)."""
    encode = {}
    for name in ("image", "text"):
        if table := getattr(a, f"{name}_queries", None):
            vectors = spark.read.parquet(table)
            encode[name] = lambda q, vectors=vectors: vectors.join(q.select("query_id"), "query_id", "left_semi")
    weights = {k: float(v) for k, v in (w.split("=", 1) for w in a.weight)}
    return Searcher(spark.read.parquet(a.annotations), indexing.load(spark, a.indexes, encode), mode=a.mode, method=a.method, weights=weights, keep=tables.kept)


def _queries(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """(query_id, text, ...) of a table, or of one query given as text; parsed by the rules."""
    if a.query:
        given = spark.createDataFrame([("q1", a.query)], "query_id string, text string")
    else:
        given = spark.read.parquet(a.queries)
    parsed = parsing.parse(given)
    return parsed.join(given, "query_id")


def scan(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.write_manifest(readers.scan_directory(spark, a.input, limit=a.limit, measured=a.measured), a.out)


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    read = lambda p: spark.read.parquet(p) if p else None
    told = indexing.build(spark.read.parquet(a.annotations), a.indexes, read(a.image_vectors), read(a.text_vectors), a.split, a.version, a.allow_missing_branches)
    print(json.dumps(told))


def parse(spark: SparkSession, a: argparse.Namespace) -> None:
    """Queries as the rules read them."""
    sinks.write_atomic(_queries(spark, a), a.out, "json")


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    found = _searcher(spark, a).search(_queries(spark, a), a.candidates, a.results)
    sinks.write_atomic(found, a.out)


def smoke(spark: SparkSession, a: argparse.Namespace) -> None:
    """Fails if a query finds nothing, or a branch that is asked for has no part in it."""
    s = _searcher(spark, a)
    found = s.search(_queries(spark, a), a.candidates, a.results)
    lacking = sorted(set(a.branch) - set(s.active()))
    if lacking or found.isEmpty():
        raise SystemExit(f"branches that are not active: {lacking}" if lacking else "no results")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    queries, judged = _queries(spark, a), readers.judgments_csv(spark, a.judgments).withColumnRenamed("relevance", "grade")
    found = tables.kept(_searcher(spark, a).search(queries, a.candidates, a.results))
    sinks.write_evaluation(*map(tables.kept, evaluation.evaluate(found, queries, judged)), a.out)


def ablate(spark: SparkSession, a: argparse.Namespace) -> None:
    queries, judged = _queries(spark, a), readers.judgments_csv(spark, a.judgments).withColumnRenamed("relevance", "grade")
    judging.refuse(queries, judged)
    s = _searcher(spark, a)
    sinks.write_ablation(tables.kept(evaluation.ablation(s, queries, judged, s.weights, a.candidates, a.results)), a.out)


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    s = _searcher(spark, a)
    sinks.write_evaluation(*map(tables.kept, evaluation.compared_fusion(s, _queries(spark, a), s.weights, a.candidates, a.results)), a.out)


def deliver(spark: SparkSession, a: argparse.Namespace) -> None:
    """Batches of 20 candidates a query, from the strict filter mode or, where it leaves fewer, the soft one.

    Batches name the index and the configuration that they come from by SHA-256; an index of another version is an error.
    """
    stored = indexing.stored_manifest(spark, a.indexes)
    if stored["annotation_version"] != a.version or stored["count"] < delivery.TOP_K:
        raise SystemExit(f"the index is of version {stored['annotation_version']!r}, of {stored['count']} items")
    s, queries = _searcher(spark, a), _queries(spark, a)
    full = delivery.full_batches(s.with_fallback(queries, max(a.candidates, delivery.TOP_K), delivery.TOP_K))
    config = json.dumps({"mode": a.mode, "method": a.method, "weights": s.weights, "candidates": a.candidates, "indexes": a.indexes, "split": a.split}, sort_keys=True)
    told = {"split": a.split, "fusion_method": a.method, "annotation_version": a.version, "index_manifest_sha256": indexing.manifest_digest(spark, a.indexes), "config_sha256": sinks.config_digest(config)}
    category = F.coalesce("category", F.lit("")) if "category" in queries.columns else F.lit("")  # a query given as text has none
    named = full.join(queries.select("query_id", F.col("raw_text").alias("query"), category.alias("category")), "query_id")
    print(sinks.write_delivery(delivery.lines(named, told), config, a.out))


def pairs(spark: SparkSession, a: argparse.Namespace) -> None:
    """Training triples of annotations with search_queries and document."""
    annotations = spark.read.parquet(a.annotations)
    made = judging.training_pairs(annotations.select("item_id", "scene", F.col("search_queries").alias("queries"), *[c for c in ("split",) if c in annotations.columns]))
    sinks.write_atomic(judging.train_split(judging.training_triples(made, annotations.select("item_id", "document"))), a.out)


def sample(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tasks for people: a seeded sample of items, refused if there are tasks already, unless forced."""
    _, fs, jvm = sinks._fs(spark, a.out)
    if fs.exists(jvm.org.apache.hadoop.fs.Path(a.out)) and not a.force:
        raise SystemExit(f"{a.out} exists; --force replaces it")
    sinks.write_atomic(judging.seeded(judging.sample(spark.read.parquet(a.annotations).select("item_id"), a.n), a.n), a.out)


def tasks(spark: SparkSession, a: argparse.Namespace) -> None:
    """Blank tasks for people, drawn from a manifest, with an empty table of judgments; work that is there is refused, unless forced."""
    _, fs, jvm = sinks._fs(spark, a.out)
    if fs.exists(jvm.org.apache.hadoop.fs.Path(a.out)) and not a.force:
        raise SystemExit(f"{a.out} exists; --force replaces it")
    made = judging.blank_tasks(spark.read.json(a.manifest), a.n, a.seed)
    sinks.write_atomic(made, f"{a.out}/queries", "json")
    sinks.write_atomic(spark.createDataFrame([], "query_id string, image_id string, relevance int, annotator string, note string"), f"{a.out}/relevance", "csv", header="true")


def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Facts of an evaluation set that people made; one with faults is refused, the first ones told."""
    queries = spark.read.schema("query_id string, text string, category string, annotator string, reviewed boolean").json(f"{a.tasks}/queries")
    judged = spark.read.schema("query_id string, item_id string, relevance int, annotator string, note string").csv(f"{a.tasks}/relevance", header=True, enforceSchema=True)
    items = spark.read.json(a.manifest).filter("valid").select("item_id")
    errors = tables.kept(judging.set_errors(queries, judged, items, a.n))
    first = [f"{r['query_id']}: {r['error']}" for r in errors.orderBy("query_id", "error").limit(10).collect()]
    if first:
        raise SystemExit(f"{errors.count()} faults: {'; '.join(first)}")
    print(json.dumps(judging.set_facts(queries, judged).first().asDict()))


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """From a folder of images to indexes, in stages that --resume takes up again.

    --generator names a function of the caller's, module:function, that annotates; vectors are tables (item_id, vector).
    """
    from importlib import import_module

    annotate = None
    if a.generator:
        module, _, name = a.generator.partition(":")
        annotate = getattr(import_module(module), name)
    given = {name: (lambda items, t=t: spark.read.parquet(t).join(items.select("item_id"), "item_id", "left_semi")) for name, t in (("image", a.image_vectors), ("text", a.text_vectors)) if t}
    done = directory.run(spark, a.input, a.out, a.resume, mode=a.mode, limit=a.limit, measured=a.measured, prompt=a.prompt, version=a.version, annotate=annotate, **given)
    print(json.dumps(done.done))


JOBS = {f.__name__: f for f in (scan, index, parse, search, smoke, evaluate, ablate, compare, deliver, pairs, sample, tasks, validate, run)}


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="heliograph.jobs", description=__doc__)
    jobs = p.add_subparsers(dest="job", required=True)
    for name, f in JOBS.items():
        j = jobs.add_parser(name, help=f.__doc__)
        if name in ("scan", "run"):
            j.add_argument("--input", required=True)
            j.add_argument("--limit", type=int)
            j.add_argument("--measured", action="store_true", help="read widths, heights and modes; files without an image's header are invalid")
        elif name in ("tasks", "validate"):
            j.add_argument("--manifest", required=True)
        elif name != "parse":
            j.add_argument("--annotations", required=True)
        if name == "validate":
            j.add_argument("--tasks", required=True)
        if name == "run":
            j.add_argument("--mode", default="full", choices=directory.MODES)
            j.add_argument("--resume", action="store_true")
            j.add_argument("--generator")
            j.add_argument("--prompt", default="")
        if name not in ("index", "smoke", "validate"):
            j.add_argument("--out", required=True)
        if name in ("index", "deliver"):
            j.add_argument("--split", default="")
        if name in ("index", "deliver", "run"):
            j.add_argument("--version", default="")
        if name in ("index", "run"):
            j.add_argument("--image-vectors")
            j.add_argument("--text-vectors")
        if name == "index":
            j.add_argument("--allow-missing-branches", action="store_true")
        if name in ("index", "search", "smoke", "evaluate", "ablate", "compare", "deliver"):
            j.add_argument("--indexes", required=True)
        if name in ("parse", "search", "smoke", "evaluate", "ablate", "compare", "deliver"):
            asked = j.add_mutually_exclusive_group(required=True)
            asked.add_argument("--queries")
            asked.add_argument("--query")
        if name in ("search", "smoke", "evaluate", "ablate", "compare", "deliver"):
            j.add_argument("--image-queries")
            j.add_argument("--text-queries")
            j.add_argument("--mode", default="hybrid", choices=("soft", "hard", "hybrid"))
            j.add_argument("--method", default="rrf", choices=("rrf", "weighted"))
            j.add_argument("--weight", action="append", default=[], metavar="BRANCH=NUMBER")
            j.add_argument("--candidates", type=int, default=50)
            j.add_argument("--results", type=int, default=30)
        if name == "smoke":
            j.add_argument("--branch", action="append", default=[])
        if name in ("evaluate", "ablate"):
            j.add_argument("--judgments", required=True)
        if name in ("sample", "tasks", "validate"):
            j.add_argument("--n", type=int, default=50 if name == "sample" else 100)
        if name in ("sample", "tasks"):
            j.add_argument("--force", action="store_true")
        if name == "tasks":
            j.add_argument("--seed", type=int, default=20260810)
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = arguments(argv)
    JOBS[a.job](spark or SparkSession.builder.appName(f"heliograph {a.job}").getOrCreate(), a)


if __name__ == "__main__":
    main()
