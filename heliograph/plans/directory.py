"""From a folder of images to indexes in one staged run: manifest, annotation, documents, indexes.

Images are annotated by a generator of the caller's, and encoded by the caller's encoders (functions from the usable items to
(item_id, vector)). In mode ``image-only`` nothing is annotated: items have placeholders, and only vectors are indexed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators import adapters, documents, manifest
from heliograph.plans import generation, indexing
from heliograph.plans.stages import Run, Stage
from heliograph.sources import readers

MODES = ("full", "image-only")


def snapshot_faults(items: DataFrame, annotations: DataFrame, version: str, most: int = 10) -> list[str]:
    """What keeps annotations from being those of the manifest's valid items, by this version of the prompt; examples of each."""
    if twice := [r["item_id"] for r in manifest.repeated_ids(annotations).orderBy("item_id").limit(most).collect()]:
        return [f"repeated ids {twice}"]
    wanted = items.filter("valid").select("item_id", "sha256", F.lit(version).alias("prompt_version"))
    status = manifest.reconcile(wanted, annotations, ("sha256", "prompt_version")).filter("status <> 'matched'")
    out = []
    for kind in ("missing", "extra", "mismatched"):
        if ids := [r["item_id"] for r in status.filter(F.col("status") == kind).orderBy("item_id").limit(most).collect()]:
            out.append(f"{kind} {ids}")
    return out


def planned(spark: SparkSession, input_dir: str, mode: str = "full", limit: int | None = None, prompt: str = "", version: str = "1", annotate: generation.Generator | None = None, image: Callable[[DataFrame], DataFrame] | None = None, text: Callable[[DataFrame], DataFrame] | None = None, retries: int = 2, measured: bool = False) -> list[Stage]:
    """The stages of a run."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "full" and annotate is None:
        raise ValueError("a full run needs a generator that annotates")

    def scanned(_, __) -> DataFrame:
        return readers.scan_directory(spark, input_dir, limit=limit, measured=measured)

    def usable(items: DataFrame, _) -> list[str]:
        return ["all images are invalid"] if items.filter("valid").isEmpty() else []

    def annotated(tables, _) -> DataFrame:
        items = tables["manifest"]
        good, bad = generation.annotated(items, prompt, annotate, version, retries)
        met = good.join(items.select("item_id", "sha256", "relative_path"), "item_id").withColumn("error", F.lit(None).cast("string"))
        return met.unionByName(bad, allowMissingColumns=True)

    def valid(tables, _) -> DataFrame:
        return tables["annotation"].filter("error is null").select("item_id", "sha256", "prompt_version")

    def described(tables, _) -> DataFrame:
        if mode == "image-only":
            return documents.placeholders(tables["manifest"].filter("valid"))
        return adapters.adapt(tables["annotation"].select("item_id", F.col("answer").alias("payload")))[0]

    def indexed(tables, at: str) -> DataFrame:
        items = manifest.usable(tables["manifest"])
        made = indexing.build(tables["documents"], at, image(items) if image else None, text(items) if text else None, version=version, allow_missing=True)
        rows = [(k, v, None) for k, v in made["branches"].items()] + [(k, None, v) for k, v in made["failed"].items()]
        return spark.createDataFrame([(k, n, e, at) for k, n, e in rows], "branch string, items long, error string, folder string")

    stages = [Stage("manifest", scanned, params={"limit": limit, "measured": measured}, check=usable, source=True)]
    if mode == "full":
        stages.append(Stage("annotation", annotated, ("manifest",), {"prompt": prompt, "retries": retries}, version))
        stages.append(Stage("validation", valid, ("manifest", "annotation"), version=version, check=lambda made, t: snapshot_faults(t["manifest"], made, version)))
    stages.append(Stage("documents", described, ("manifest", "annotation", "validation") if mode == "full" else ("manifest",), {"mode": mode}))
    return [*stages, Stage("indexes", indexed, ("manifest", "documents"), {"version": version})]


def run(spark: SparkSession, input_dir: str, folder: str, resume: bool = False, changed: str = "refuse", **plan) -> Run:
    """The run in ``folder``, done: its tables by stage, and in ``state`` what was done. ``plan`` as for ``planned``."""
    identity = {"input_dir": input_dir, "mode": plan.get("mode", "full"), "limit": plan.get("limit")}
    stages = planned(spark, input_dir, **plan)
    taken = Run(spark, folder, identity, resume, changed)
    taken.done = taken.run(stages)
    return taken
