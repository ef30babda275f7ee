"""Sinks: written to a new folder first, and put in place whole."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.text import latex
from heliograph.operators import manifest


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm


def write_atomic(df: DataFrame, path: str, format: str = "parquet", **options) -> None:
    """Readers of ``path`` see the old files or the new ones: the new folder takes the old one's place by a rename."""
    spark, fresh = df.sparkSession, f"{path}.new-{uuid.uuid4().hex}"
    df.write.format(format).options(**options).save(fresh)
    target, fs, jvm = _fs(spark, path)
    old = jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), target):
        fs.rename(old, target)
        raise OSError(f"can't put {path} in place")
    fs.delete(old, True)


def write_with_failures(df: DataFrame, path: str) -> None:
    """Rows without ``error`` as JSON lines in ``path``, the others in ``path``.failures; both are appended to."""
    df.filter("error is null").drop("error").write.mode("append").json(path)
    df.filter("error is not null").write.mode("append").json(f"{path}.failures")


def write_lines(df: DataFrame, path: str) -> None:
    """A column ``value`` of texts, one a line."""
    df.select("value").write.mode("overwrite").text(path)


def _csv(df: DataFrame, path: str) -> None:
    """CSV with a header, in one file, with the mark by which spreadsheets know UTF-8; for reports of a few rows."""
    names = df.columns
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    quoted = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
    head = "\ufeff" + ",".join(names)
    rows = df.select(F.concat_ws(",", *quoted).alias("value"), F.lit(1).alias("k"))
    first = df.sparkSession.createDataFrame([(head, 0)], "value string, k int")
    first.unionByName(rows).coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def _one(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_manifest(items: DataFrame, path: str) -> None:
    """The manifest's rows as JSON lines, its quality as one JSON row, and what it lists: invalid items and duplicates."""
    write_atomic(items, f"{path}/items", "json")
    manifest.quality(items).coalesce(1).write.mode("overwrite").json(f"{path}/quality")
    manifest.faults(items).write.mode("overwrite").json(f"{path}/faults")


def write_import(good: DataFrame, failures: DataFrame, items: DataFrame, path: str) -> None:
    """Imported annotations, failures, and ids of items that none was imported for; with one row of their numbers."""
    good.write.mode("overwrite").json(f"{path}/annotations")
    failures.write.mode("overwrite").json(f"{path}/failures")
    missing = items.select("item_id").join(good.select("item_id"), "item_id", "left_anti")
    missing.write.mode("overwrite").json(f"{path}/missing")
    counts = [df.select(F.lit(n).alias("what")).groupBy("what").count() for n, df in (("imported", good), ("failures", failures), ("missing", missing))]
    counts[0].unionByName(counts[1]).unionByName(counts[2]).coalesce(1).write.mode("overwrite").json(f"{path}/report")


def write_evaluation(details: DataFrame, summary: DataFrame, path: str) -> None:
    """details and summary as CSV and JSON, the summary as LaTeX too, failures as JSON lines."""
    for name, df in (("details", details), ("summary", summary)):
        _csv(df, f"{path}/{name}_csv")
        df.write.mode("overwrite").json(f"{path}/{name}_json")
    _one(details.sparkSession, latex_table(summary), f"{path}/summary_tex")
    if "success" in details.columns:
        details.filter(~F.col("success")).write.mode("overwrite").json(f"{path}/failures_json")


def write_ablation(rows: DataFrame, path: str) -> None:
    """A row a variant, as JSON, CSV and LaTeX; none is an error."""
    if rows.isEmpty():
        raise ValueError("no ablation results to write")
    rows.write.mode("overwrite").json(f"{path}/json")
    _csv(rows, f"{path}/csv")
    _one(rows.sparkSession, latex_table(rows), f"{path}/tex")


def write_benchmark(runs: DataFrame, summary: DataFrame, path: str) -> None:
    """Runs as JSON lines, and their summary beside them."""
    runs.write.mode("overwrite").json(path)
    summary.coalesce(1).write.mode("overwrite").json(f"{path}.summary")


def config_digest(config: str) -> str:
    return hashlib.sha256(config.encode()).hexdigest()


def write_delivery(lines: DataFrame, config: str, path: str) -> str:
    """Batches a line each, and the configuration they were made with; returns its SHA-256, which batches name."""
    write_lines(lines, f"{path}/batches")
    _one(lines.sparkSession, config, f"{path}/config")
    return config_digest(config)


def latex_table(summary: DataFrame, most: int = 200) -> str:
    """A summary as a LaTeX table; a summary is a few rows."""
    rows = summary.limit(most).collect()
    if not rows:
        raise ValueError("nothing to report")
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else latex("" if v is None else str(v))
    body = [" & ".join(map(show, r)) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(summary.columns) + "}", " & ".join(map(latex, summary.columns)) + r" \\ \hline", *body, r"\end{tabular}"])
