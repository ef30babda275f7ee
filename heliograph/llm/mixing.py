"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's words are one stream: its documents by bucket, id and size. The stream is cut into blocks of equal size.
A source's target is drawn in whole passes over its blocks and a last, partial one, each in an order of its own (a
keyed permutation), so that it is met to the word and no document is taken more than ceil(target / size) times.
The drawn blocks of all sources are shared out among output shards by a tree: a node's quotas are split between its
halves by a multivariate hypergeometric draw, so each shard gets disjoint stretches of every source's order, and each
source's quotas add up exactly. Within a shard, blocks are ordered by a hash (the local shuffle).

Sizes of sources and shards are a table of (sources x shards) numbers on the driver; sources are a list of at most
MAX_SOURCES names, which is checked. Documents are never gathered: offsets come from sums by source, group of buckets, and bucket.

Rows: a null text has no words; a null source is a source of its own, the last; rows that repeat are separate
documents; sources without words have a target of 0; an empty table gives an empty result; further columns are left out
unless they are to be carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.llm.common import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
#: Sources are named in a mixing recipe; more than this many is an error, not a cut.
MAX_SOURCES = 100_000
#: Words a block at least; it grows so that there are at most MOST_BLOCKS in all.
BLOCK, MOST_BLOCKS = 256, 200_000_000
#: Rows of a source aimed at in a bucket, and buckets in a group.
BUCKET_ROWS, GROUP = 250, 1024


def targets(sizes: list[int], weights: list[float], share: float = 1.5, limit: float = 2.0) -> list[float]:
    """share * sum(sizes), by weight, none above limit times its size; the excess is shared anew by weight."""
    budget = min(share, limit) * sum(sizes)
    order = sorted(range(len(sizes)), key=lambda k: (limit * sizes[k] / weights[k], k))
    left, weight, level = budget, sum(weights), 0.0
    out = [limit * s for s in sizes]
    for n, k in enumerate(order):
        level = left / weight
        if limit * sizes[k] > weights[k] * level:
            for j in order[n:]:
                out[j] = weights[j] * level
            break
        left -= limit * sizes[k]
        weight -= weights[k]
    return out


def _seeded(seed: int, *key: int) -> np.random.Generator:
    return np.random.default_rng([seed, *key])


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) quotas: every column adds up to the source's quota, every row to its shard's capacity."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    work = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while work:
        lo, hi, q = work.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid, total = (lo + hi) // 2, int(q.sum())
        take = total * (mid - lo) // (hi - lo)
        rng = _seeded(seed, lo, hi)
        left = rng.multivariate_hypergeometric(q, take, method="marginals") if total else np.zeros_like(q)
        work += [(lo, mid, left), (mid, hi, q - left)]
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n): a Feistel network over the next power of 4, walked until it is below n."""
    half = max(1, math.ceil(math.log2(max(2, n)) / 2))
    mask = np.uint64((1 << half) - 1)
    x, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            f = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 4 + r) * 0xD1B54A32D192ED03 % (1 << 64))
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


def plan(sizes: list[int], target: list[float], block: int, shards: int, seed: int) -> dict:
    """For each source: whole passes, blocks of the last pass and words of its partial block; and the shards' cuts."""
    passes, full, part, slots = [], [], [], []
    for k, (s, t) in enumerate(zip(sizes, target)):
        t = min(math.floor(t + 0.5), 2**62)
        if not s or not t:
            passes.append(0), full.append(0), part.append(0), slots.append(0)
            continue
        n = -(-s // block)
        tail = s - (n - 1) * block
        e, rest = divmod(t, s)
        at = int(permuted(np.array([n - 1]), n, seed + 31 * k + e)[0])  # the short block's place in the last pass
        b, words = divmod(rest, block)
        if at < b or (at == b and words > tail):  # the short block comes before the end
            b, words = divmod(rest + block - tail, block)
            b, words = (b, words) if b > at else (at, rest - at * block)
        passes.append(e), full.append(b), part.append(words), slots.append(e * n + b + (words > 0))
    cuts = np.cumsum(splitting_tree(np.array(slots, dtype=np.int64), shards, seed), axis=0)
    return {"passes": passes, "full": full, "part": part, "cuts": cuts, "slots": slots}


def source_sizes(sized: DataFrame) -> list[tuple[str | None, int, int]]:
    """(source, words, documents), by code point, null last."""
    by = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    found = [tuple(r) for r in by.limit(MAX_SOURCES + 1).collect()]
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return sorted(found, key=lambda r: (r[0] is None, r[0] or ""))


def _starts(bucketed: DataFrame) -> DataFrame:
    """``bucketed`` (source_no, bucket, id, size) with ``at``: the words before a row in its source's stream.

    Offsets add up in three levels: rows of a bucket, buckets of a group, groups of a source. So no task sorts more than
    a bucket's rows, GROUP buckets, or a source's groups.
    """
    run = lambda *by: Window.partitionBy(*by)
    before = lambda w, *by: w.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = bucketed.groupBy("source_no", "bucket").agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("bucket") / GROUP))
    groups = sums.groupBy("source_no", "group").agg(F.sum("words").alias("words"))
    groups = groups.select("source_no", "group", F.coalesce(F.sum("words").over(before(run("source_no"), "group")), F.lit(0)).alias("group_start"))
    inner = F.coalesce(F.sum("words").over(before(run("source_no", "group"), "bucket")), F.lit(0))
    sums = sums.select("source_no", "group", "bucket", inner.alias("inner")).join(groups, ["source_no", "group"]).select("source_no", "bucket", (F.col("group_start") + F.col("inner")).alias("bucket_start"))
    local = F.coalesce(F.sum("size").over(before(run("source_no", "bucket"), "id", "size")), F.lit(0))
    return bucketed.withColumn("local", local).join(sums, ["source_no", "bucket"]).withColumn("at", F.col("bucket_start") + F.col("local")).drop("bucket", "local", "bucket_start")


PIECES = "array<struct<shard:int,place:long,pass:int,start:long,words:long>>"


def _draw(recipe: dict, sizes: list[int], block: int, seed: int):
    """Arrow UDF: (source_no, at, size) -> the pieces of a document that the shards' quotas take.

    A slot is a place in a source's order of one pass after another; the tree's cuts say which shard's quota holds it,
    and a slot beyond all quotas isn't taken.
    """

    @F.arrow_udf(PIECES)
    def pieces(no_: pa.Array, at_: pa.Array, size_: pa.Array) -> pa.Array:
        no, at, size = (x.to_numpy(zero_copy_only=False) for x in (no_, at_, size_))
        found = []
        for k in np.unique(no):
            rows = np.flatnonzero((no == k) & (size > 0))
            cuts = recipe["cuts"][:, k]
            if not len(rows) or not cuts[-1]:
                continue
            n = -(-sizes[k] // block)
            first, last = at[rows] // block, (at[rows] + size[rows] - 1) // block
            count = last - first + 1
            doc = np.repeat(rows, count)
            b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            lo, hi = np.maximum(b * block, at[doc]), np.minimum((b + 1) * block, at[doc] + size[doc])
            for e in range(recipe["passes"][k] + 1):
                place = permuted(b, n, seed + 31 * int(k) + e)
                slot = e * n + place
                end = np.where(slot < cuts[-1], hi, lo)
                if e == recipe["passes"][k]:  # the last slot may be taken in part
                    end = np.where(place == recipe["full"][k], np.minimum(end, b * block + recipe["part"][k]), end)
                use = np.flatnonzero(end > lo)
                shard = np.searchsorted(cuts, slot[use], side="right")
                salt = slot[use].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(int(k) * 0xBF58476D1CE4E5B9 % (1 << 64))
                spot = ((salt ^ (salt >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(1)).astype(np.int64)
                found.append((doc[use], shard.astype(np.int32), spot, np.full(len(use), e, np.int32), lo[use] - at[doc[use]], end[use] - lo[use]))
        doc, shard, spot, e, start, words = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 6
        order = np.lexsort([start, e, doc])
        offsets = np.searchsorted(doc[order], np.arange(len(no) + 1)).astype(np.int32)
        parts = [pa.array(shard[order], pa.int32()), pa.array(spot[order], pa.int64()), pa.array(e[order], pa.int32()), pa.array(start[order], pa.int64()), pa.array(words[order], pa.int64())]
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, names=["shard", "place", "pass", "start", "words"]))

    return pieces


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, id: str = "doc_id", text: str = "text", source: str = "source", shards: int = 64, seed: int = 7, carry: list[str] | None = None) -> DataFrame:
    """id, source, size, source_size, target, taken, pieces (and the columns ``carry``), a row a document.

    pieces: array of (shard, place, pass, start, words): the stretches of the document that the mix takes, and where they
    go; taken is the sum of their words. ``weights`` repeat over the sources. Columns to carry whose names the result
    has itself are left out.
    """
    spark = docs.sparkSession
    carry = [c for c in carry or [] if c not in (id, source, "size", "source_size", "target", "taken", "pieces")]
    kept = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *[F.col(c).alias(f"c_{n}") for n, c in enumerate(carry)])
    sized = materialize(kept)  # words are counted once
    order = source_sizes(sized)
    total = sum(r[1] for r in order)
    block = max(BLOCK, -(-2 * total // MOST_BLOCKS))
    sizes = [r[1] for r in order]
    goal = targets(sizes, [float(weights[k % len(weights)]) for k in range(len(order))], share) if total else [0.0] * len(order)
    recipe = plan(sizes, goal, block, shards, seed)
    buckets = 1 << max(0, math.ceil(math.log2(max(1, max((r[2] for r in order), default=0) / BUCKET_ROWS))))
    names = spark.createDataFrame([(r[0], k, float(g), s) for k, (r, g, s) in enumerate(zip(order, goal, sizes))], "source string, source_no int, target double, source_size long")
    bucketed = sized.join(F.broadcast(names), sized["source"].eqNullSafe(names["source"])).drop(names["source"])  # MAX_SOURCES rows
    placed = _starts(bucketed.withColumn("bucket", F.pmod(F.xxhash64("id", "size"), F.lit(buckets))))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    out = placed.withColumn("pieces", _draw(recipe, sizes, block, seed)("source_no", "at", "size")).withColumn("taken", taken)
    return out.select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", "taken", "pieces", *[F.col(f"c_{n}").alias(c) for n, c in enumerate(carry)])


def shard_rows(docs: DataFrame, mixed: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix's own rows: shard, place, id and text of each stretch, ordered within a shard by place.

    Ids must be unique here: a stretch is cut from its document's text.
    """
    parts = mixed.select(F.col(id), F.explode("pieces").alias("p")).join(docs.select(F.col(id), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)).alias("_words")), id)
    cut = parts.select(F.col("p.shard").alias("shard"), F.col("p.place").alias("place"), F.col(id), F.array_join(F.slice("_words", (F.col("p.start") + 1).cast("int"), F.col("p.words").cast("int")), " ").alias("text"))
    return cut.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "pieces")
