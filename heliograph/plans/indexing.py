"""Indexes of a collection: built from annotations and vectors into one folder, with a manifest that loading checks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.vectors import truncated
from heliograph.operators import dense, documents, lexical, manifest

SCHEMA_VERSION = 1


def build(annotations: DataFrame, path: str, image: DataFrame | None = None, text: DataFrame | None = None, split: str = "", version: str = "", allow_missing: bool = False) -> dict:
    """Indexes under ``path``, and what the manifest says.

    bm25 is made of the annotations' sparse documents; image and text are vectors (item_id, vector) of encoders. A branch
    that can't be built is an error, or with ``allow_missing`` left out and noted; no branch at all is an error.
    """
    spark = annotations.sparkSession
    if not manifest.repeated_ids(annotations).isEmpty():
        raise ValueError("annotations with repeated ids")
    built, failed = {}, {}

    def bm25() -> int:
        sparse = documents.fields(annotations).select("item_id", documents.sparse_document().alias("text"))
        return lexical.build(sparse, f"{path}/bm25").n

    def vectors(name: str, given: DataFrame | None) -> Callable[[], int]:
        def make() -> int:
            if given is None:
                raise ValueError("no vectors")
            dense.save(given.join(annotations.select("item_id"), "item_id", "left_semi"), f"{path}/{name}", kind=name)
            return dense.load(spark, f"{path}/{name}").count()

        return make

    for name, make in (("image", vectors("image", image)), ("text", vectors("text", text)), ("bm25", bm25)):
        try:
            built[name] = make()
        except Exception as e:
            if not allow_missing:
                raise
            failed[name] = f"{type(e).__name__}: {e}"
    if not built:
        raise RuntimeError(f"no branch could be built: {failed}")
    ids = manifest.id_digest(annotations).first()
    told = {"schema_version": SCHEMA_VERSION, "split": split, "annotation_version": version, "count": ids["n"], "digest": ids["digest"], "branches": built, "failed": failed}
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return told


def stored_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def manifest_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of the manifest as it is stored: what deliveries name their index by."""
    return hashlib.sha256(spark.read.text(f"{path}/manifest").first()["value"].encode()).hexdigest()


def errors(spark: SparkSession, path: str, annotations: DataFrame, branches: list[str], split: str = "", version: str = "") -> list[str]:
    """What differs between a folder's manifest and the annotations at hand."""
    ids = manifest.id_digest(annotations).first()
    now = {"schema_version": SCHEMA_VERSION, "split": split, "annotation_version": version, "count": ids["n"], "digest": ids["digest"]}
    return manifest.index_errors(stored_manifest(spark, path), now, branches)


def load(spark: SparkSession, path: str, encode: dict[str, Callable[[DataFrame], DataFrame]], branches: list[str] | None = None, width: int | None = None) -> dict[str, Callable[[DataFrame, int], DataFrame]]:
    """Branches for a Searcher. ``encode`` has, for image and text, a function from (query_id, text) to (query_id, vector).

    Branches that the folder lacks are an error if they are asked for by name; ``width`` cuts all vectors to their first
    components.
    """
    have = stored_manifest(spark, path)["branches"]
    wanted = [b for b in have if b == "bm25" or b in encode] if branches is None else branches
    lacking = [b for b in wanted if b not in have or (b != "bm25" and b not in encode)]
    if lacking:
        raise ValueError(f"branches not built, or without an encoder: {lacking}")
    cut = (lambda df: df) if width is None else (lambda df: df.withColumn("vector", truncated(F.col("vector"), width)))

    def search_by(name: str):
        if name == "bm25":
            index = lexical.Index.load(spark, f"{path}/bm25")
            return lambda q, k: lexical.search(index, q.select("query_id", "text"), k)
        items = dense.load(spark, f"{path}/{name}")
        items = items if width is None else dense.prepared(cut(items))
        return lambda q, k: dense.search(items, cut(encode[name](q.select("query_id", "text"))), k)

    return {name: search_by(name) for name in wanted}
