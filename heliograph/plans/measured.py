"""Measured suites of rerankers: candidates found once, runs in one order, and calls timed where they are made.

A run is one query's first ``top_k`` candidates, reranked once by one method: pointwise, a call a candidate, or listwise, one
call in all. Runs are numbered through - by number of candidates, query, method and repeat - and dealt in stretches of numbers
over ``workers`` tasks, each of which makes an unmeasured call first and its runs in order after. A run that fails is a row
like any other; after ``most_failures`` of them in a row a task makes no more calls, and its other runs fail as aborted.
"""

from __future__ import annotations

import resource
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.operators import manifest
from heliograph.sources.tables import kept

METHODS = ("pointwise", "listwise")
RECORDS = "run long, worker int, method string, query_id {0}, category string, top_k int, repeat int, prompts array<string>, latency_ms double, success boolean, degraded boolean, error string, answers array<string>, peak_bytes long"


def collected(candidates: DataFrame, queries: DataFrame, top_ks: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(query_id, category, top_k, item_ids; query_id, category, top_k, stage, error of queries with too few candidates).

    ``candidates`` (query_id, item_id, rank) were searched once, at the largest ``top_k``; smaller ones are slices of them.
    """
    if not top_ks or min(top_ks) < 1:
        raise ValueError("top_k must be positive")
    most = max(top_ks)
    lists = candidates.filter(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("l"))  # at most ``most`` a query
    each = queries.select("query_id", "category").join(lists, "query_id", "left").withColumn("top_k", F.explode(F.array(*map(F.lit, sorted(set(top_ks))))))
    have = F.coalesce(F.size("l"), F.lit(0))
    good = each.filter(have >= F.col("top_k")).select("query_id", "category", "top_k", F.transform(F.slice("l", 1, F.col("top_k")), lambda x: x["item_id"]).alias("item_ids"))
    told = F.when(F.col("l").isNull(), F.lit("no candidates")).otherwise(F.concat(have.cast("string"), F.lit(" candidates")))
    bad = each.filter((have < F.col("top_k")) | F.col("l").isNull()).select("query_id", "category", "top_k", F.when(F.col("l").isNull(), "retrieval").otherwise("candidate_count").alias("stage"), told.alias("error"))
    return good, bad


def measured(
    sets: DataFrame, call: Callable[[str], str], pointwise: Callable[[Column], Column] | None, listwise: Callable[[Column], Column] | None, repeats: int = 1, workers: int = 1, most_failures: int = 3,
    warm: str | None = "warm up", usable: Callable[[str, list[str]], tuple[bool, bool]] | None = None, clock=time.perf_counter,
) -> DataFrame:
    """A row a run, from ``collected`` sets with whatever columns prompts need.

    ``pointwise`` makes a prompt of an item id (beside the set's columns), ``listwise`` one of the list of them; a method
    without one isn't run. ``call`` takes a prompt and returns the answer, or raises. ``usable`` takes a method and a run's
    answers, and tells whether they can be used and whether they had to be repaired.
    """
    if repeats < 1 or workers < 1:
        raise ValueError("repeats and workers must be positive")
    kind = dict(sets.dtypes)["query_id"]
    made = []
    if pointwise:
        made.append(F.struct(F.lit("pointwise").alias("method"), F.transform("item_ids", pointwise).alias("prompts")))
    if listwise:
        made.append(F.struct(F.lit("listwise").alias("method"), F.array(listwise(F.col("item_ids"))).alias("prompts")))
    runs = sets.select("query_id", "category", "top_k", F.explode(F.array(*made)).alias("m")).select("query_id", "category", "top_k", "m.*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    # sorted by sampling into few parts, numbered where they lie
    ordered = runs.orderBy("top_k", "query_id", F.array_position(F.array(*map(F.lit, METHODS)), F.col("method")), "repeat")
    numbered = kept(manifest.placed(ordered).select(F.col("place").cast("long").alias("run"), "method", "query_id", "category", F.col("top_k").cast("int").alias("top_k"), F.col("repeat").cast("int").alias("repeat"), "prompts"))
    each = -(-max(1, numbered.count()) // workers)
    dealt = numbered.withColumn("worker", F.floor((F.col("run") - 1) / each).cast("int")).repartitionById(workers, F.col("worker")).sortWithinPartitions("run")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cold, failures = True, 0
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for method, prompts in zip(b.column("method").to_pylist(), b.column("prompts").to_pylist()):
                if cold and warm is not None:
                    call(warm)  # not measured; if it fails, so does the job
                cold = False
                error, answers, began = None, [], clock()
                if failures >= most_failures:
                    error = "aborted"
                else:
                    try:
                        for p in prompts:
                            answers.append(call(p))
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                took = (clock() - began) * 1000
                ok, repaired = (False, False) if error else usable(method, answers) if usable else (True, False)
                error = error or (None if ok else "unusable answers")
                failures = 0 if ok else failures + (error != "aborted")
                peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
                for column, value in zip(rows, (None if error == "aborted" else took, ok, repaired, error, answers, peak)):
                    column.append(value)
            new = [pa.array(v, t) for v, t in zip(rows, (pa.float64(), pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.int64()))]
            named = {n: b.column(n) for n in b.schema.names}
            out = [named[c] for c in ("run", "worker", "method", "query_id", "category", "top_k", "repeat", "prompts")] + new
            yield pa.RecordBatch.from_arrays(out, names=["run", "worker", "method", "query_id", "category", "top_k", "repeat", "prompts", "latency_ms", "success", "degraded", "error", "answers", "peak_bytes"])

    return kept(dealt.mapInArrow(work, RECORDS.format(kind)))  # calls are made once
