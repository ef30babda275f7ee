"""Near-duplicate embeddings by a robust-pruned flat graph on overlapping cluster shards.

Equal vectors of a label are one node. Labels with more than SPLIT nodes are cut in shards around centers, each node
belonging to its OVERLAP nearest ones; shards that are still too large are cut again, by centers of their own, as often as
it takes. Centers of a shard are fitted on at most about SAMPLE of its nodes, where they lie; nodes meet them in batches.

In each shard a graph is built by inserting nodes in batches: a greedy search from the medoid in the graph so far gives a
node's candidates, of which it keeps those that none nearer to it hides (by ALPHA); these get an edge back, and lists that
grow too long are pruned in the same way. FAR random edges a node lead out of groups of near copies. So no shard's pairs are
all compared to build it. Lists that a node has in several shards are united. A greedy search from the node itself and the
medoid, whose beam then grows over all that lies in range, finds the neighbours of each of the shard's nodes. A pair is
counted in the first shard that both share. Nothing but counts and a spanning forest leaves a shard, so groups of near
copies aren't expanded into pairs. Links are verified in double precision.

Shards that come out larger than MOST, as centers can't part a dense group, are dealt in cells of bounded size that cover
all their pairs. The recall is audited: random nodes - AUDIT, or more until ENOUGH links are seen, MOST_AUDIT in the end - and
LINKED ones that have links are held against brute force over all nodes, each kind by itself. While the worse of both is
below ``target``, shards are compared by exact blocks, then nodes are put in twice as many shards, and in the end all nodes of
a label are compared, whose cost grows as its square. ``audited`` tells the recall beside each row.

Rows: vectors that are null, empty or zero or have a null or non-finite component, and null labels, link with nothing;
vectors of different lengths never link; a null id is no node (its links are null, and it is kept); rows that repeat an
id and a vector are one vector; of vectors that share their smallest id, one is compared; an empty table gives an empty result; further columns, of any names, are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import hot_keys, materialize, salted_join, table
from heliograph.llm.components import connected_components

#: Nodes of a shard aimed at, most that aren't cut, shards of a node, and most that are searched in one piece.
SHARD, SPLIT, OVERLAP, MOST = 1_500, 2_500, 3, 6_000
#: Nodes of a shard that its centers are fitted on, centers of a shard at most, nodes that meet them at a time, most cuts.
SAMPLE, FAN, BATCH, CUTS = 2_000, 64, 1_000, 8
#: Nodes audited: random ones at first, ones with links; links to be seen among the random ones, and most of these.
AUDIT, LINKED, ENOUGH, MOST_AUDIT = 500, 200, 200, 8_000
#: Edges of a node, and random ones besides; candidates of a node, and what hides a farther one.
DEGREE, FAR, BUILD, ALPHA = 16, 4, 32, 1.2
#: Nodes in a search's beam, those expanded at a time, queries at a time, and how far beyond the range nodes are expanded.
BEAM, AT_ONCE, QUERIES, SLACK = 16, 4, 256, 0.08


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _matrix(packed, kind: str) -> np.ndarray:
    """Unit rows in double precision, of vectors of one length."""
    return _unit(np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(float))


def greedy(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(similarity to each node, -3 where it wasn't seen; nodes expanded; the ``width`` best nodes, -1 where there are fewer).

    ``edges`` (n, most) has -1 where there is no edge; ``starts`` (queries, some) are the nodes to start from.
    """
    n, rows, at_once = len(x), np.arange(len(queries))[:, None], min(AT_ONCE, width)
    sims, done = np.full((len(queries), n), -3.0, np.float32), np.zeros((len(queries), n), bool)
    best, value = np.full((len(queries), width), -1), np.full((len(queries), width), -3.0, np.float32)

    def see(nodes: np.ndarray) -> None:
        nonlocal best, value
        nodes = np.sort(nodes, axis=1)
        fresh = nodes >= 0
        fresh[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
        fresh &= sims[rows, np.maximum(nodes, 0)] == -3
        r, c = np.nonzero(fresh)
        got = np.full(nodes.shape, -3.0, np.float32)
        got[r, c] = np.einsum("rd,rd->r", x[queries[r]], x[nodes[r, c]])
        sims[r, nodes[r, c]] = got[r, c]
        every, values = np.concatenate([best, nodes], axis=1), np.concatenate([value, got], axis=1)
        top = np.argpartition(-values, width - 1, axis=1)[:, :width]
        best, value = np.take_along_axis(every, top, 1), np.take_along_axis(values, top, 1)

    see(starts)
    while True:
        left = np.where(done[rows, np.maximum(best, 0)], -3.0, value)
        pick = np.argpartition(-left, at_once - 1, axis=1)[:, :at_once]
        use = np.take_along_axis(left, pick, 1) > -3
        if not use.any():
            return sims, done, np.where(value > -3, best, -1)
        nodes = np.where(use, np.take_along_axis(best, pick, 1), -1)
        r, c = np.nonzero(use)
        done[r, nodes[r, c]] = True
        near = edges[np.maximum(nodes, 0)]
        near[~use] = -1
        see(near.reshape(len(queries), -1))


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """(nodes, DEGREE) of each node's candidates (-1: none), nearest first, none of which a kept one hides by ALPHA."""
    valid = (cand >= 0) & (cand != nodes[:, None])
    sims = np.where(valid, np.einsum("rd,rcd->rc", x[nodes], x[np.maximum(cand, 0)]), -3.0)
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    alive, out, kept = sims > -3, np.full((len(nodes), DEGREE), -1), np.zeros(len(nodes), int)
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    away = np.sqrt(np.maximum(0, 2 - 2 * sims))
    for k in range(cand.shape[1]):
        rows = np.flatnonzero(alive[:, k] & (kept < DEGREE))
        if not len(rows):
            continue
        out[rows, kept[rows]] = cand[rows, k]
        kept[rows] += 1
        if k + 1 < cand.shape[1]:
            between = np.einsum("rd,rcd->rc", x[cand[rows, k]], x[np.maximum(cand[rows, k + 1 :], 0)])
            alive[rows, k + 1 :] &= ALPHA * np.sqrt(np.maximum(0, 2 - 2 * between)) > away[rows, k + 1 :]
    return out


def build(x: np.ndarray) -> np.ndarray:
    """(n, DEGREE + FAR) edges of a shard's graph."""
    n = len(x)
    rng = np.random.default_rng(n)
    edges = np.concatenate([np.full((n, DEGREE), -1), rng.integers(0, n, (n, FAR))], axis=1)
    medoid = int((x @ _unit(x.mean(axis=0, keepdims=True))[0]).argmax())
    order, at = rng.permutation(n), 0
    while at < n:
        part = order[at : at + min(QUERIES, max(16, at))]
        at += len(part)
        *_, best = greedy(x, edges, part, np.full((len(part), 1), medoid), min(BUILD, n))
        # nodes of one batch don't meet in the graph: some of them are candidates of each other
        best = np.concatenate([best, rng.choice(part, (len(part), 4))], axis=1)
        edges[part, :DEGREE] = robust_prune(x, part, best)
        r, c = np.nonzero(edges[part, :DEGREE] >= 0)
        to, back = edges[part[r], c], part[r]
        order_ = np.argsort(to, kind="stable")
        to, back = to[order_], back[order_]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        lists = np.full((len(nodes), DEGREE + int(count.max(initial=0))), -1)
        lists[:, :DEGREE] = edges[nodes, :DEGREE]
        own = np.repeat(np.arange(len(nodes)), count)
        lists[own, DEGREE + np.arange(len(to)) - first[own]] = back
        for lo in range(0, len(nodes), QUERIES):
            edges[nodes[lo : lo + QUERIES], :DEGREE] = robust_prune(x, nodes[lo : lo + QUERIES], lists[lo : lo + QUERIES])
    return edges


def range_search(x: np.ndarray, edges: np.ndarray, least: float) -> list[np.ndarray]:
    """For each node: the nodes found with a similarity of at least ``least``, itself too.

    After the greedy search, all seen nodes within SLACK of the range are expanded until there are no more.
    """
    n, out = len(x), []
    medoid = int((x @ _unit(x.mean(axis=0, keepdims=True))[0]).argmax())
    for lo in range(0, n, QUERIES):
        q = np.arange(lo, min(n, lo + QUERIES))
        sims, done, _ = greedy(x, edges, q, np.stack([q, np.full(len(q), medoid)], 1), min(BEAM, n))
        while True:
            r, node = np.nonzero((sims >= least - SLACK) & ~done)
            if not len(r):
                break
            done[r, node] = True
            near = edges[node]
            rr, nn = np.repeat(r, near.shape[1]), near.ravel()
            key = np.unique((rr * n + nn)[nn >= 0])
            rr, nn = key // n, key % n
            new = sims[rr, nn] == -3
            rr, nn = rr[new], nn[new]
            for s in range(0, len(rr), 65_536):
                a, b = rr[s : s + 65_536], nn[s : s + 65_536]
                sims[a, b] = np.einsum("rd,rd->r", x[q[a]], x[b])
        out += [np.flatnonzero(row >= least - 1e-4) for row in sims]
    return out


def exact_search(x: np.ndarray, least: float) -> list[np.ndarray]:
    """The same by comparing all nodes."""
    out: list[np.ndarray] = []
    for lo in range(0, len(x), 512):
        out += [np.flatnonzero(s >= least - 1e-4) for s in x[lo : lo + 512] @ x.T]
    return out


def centers_of(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A few rounds of k-means on unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(8):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c)
    return c


def _fit(kind: str, belongs: int):
    """applyInPandas over a shard's sample: (shard, no, c), its centers."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(min(FAN, max(2, -(-int(pdf["n"].iloc[0]) * belongs // SHARD))))
        c = centers_of(_matrix(pdf.sort_values("node")["b"].tolist(), kind), k)
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "no": range(len(c)), "c": [r.tobytes() for r in c]})

    return fit


def _assign(kind: str, belongs: int):
    """Cogrouped applyInPandas over a batch of nodes and their shard's centers: a row for each center that a node belongs to."""

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("no")
        if not len(left) or not len(right):
            return left.assign(no=0, before=left["n"])[["node", "copies", "b", "shard", "no", "before"]]
        x, c = _matrix(left["b"].tolist(), kind), np.frombuffer(b"".join(right["c"]), float).reshape(len(right), -1)
        m = min(belongs, len(c))
        top = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :m]
        out = left.loc[left.index.repeat(m)].reset_index(drop=True)
        return out.assign(no=right["no"].to_numpy()[top.ravel()], before=out["n"])[["node", "copies", "b", "shard", "no", "before"]]

    return assign


def _cut(nodes: DataFrame, kind: str, overlap: int) -> DataFrame:
    """(node, copies, b, shard): a row for each shard that a node belongs to."""
    dealt = nodes.select("node", "copies", "b", F.xxhash64("label", F.octet_length("b")).alias("shard"), F.lit(None).cast("long").alias("before"))
    done = None
    for cut in range(CUTS):
        sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"))
        # a shard that keeps most of what it was cut from is a group that centers don't part
        sizes = materialize(sizes.filter((F.col("n") > SPLIT) & (F.col("before").isNull() | (F.col("n") <= 0.7 * F.col("before")))).select("shard", "n"))
        if sizes.isEmpty():
            break
        joined = materialize(salted_join(dealt.drop("before"), sizes, "shard", hot_keys(sizes, "shard", "n"), "left", spread="node"))
        rest, large = joined.filter("n is null").drop("n"), joined.filter("n is not null")
        done = rest if done is None else done.unionByName(rest)
        belongs = overlap if cut == 0 else 2

        drawn = F.pmod(F.xxhash64("node", F.lit(cut)), F.lit(1 << 30)) < F.least(F.lit(1.0), SAMPLE / F.col("n")) * (1 << 30)
        centers = materialize(large.filter(drawn).select("shard", "n", "node", "b").groupBy("shard").applyInPandas(_fit(kind, belongs), "shard long, no int, c binary"))
        batches = F.ceil(F.col("n") / BATCH).cast("long")
        met = centers.join(sizes.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), batches - 1)).alias("batch")), "shard")
        batched = large.withColumn("batch", F.pmod(F.xxhash64("node", F.lit("batch")), batches))

        parted = batched.groupBy("shard", "batch").cogroup(met.groupBy("shard", "batch")).applyInPandas(_assign(kind, belongs), "node long, copies long, b binary, shard long, no int, before long")
        dealt = materialize(parted.withColumn("shard", F.xxhash64("shard", "no")).drop("no"))
    dealt = dealt.drop("before")
    return dealt if done is None else done.unionByName(dealt)


FOUND = "node long, n long, parent long"


def _search(nodes: DataFrame, kind: str, least: float, overlap: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """(counts by node and shard, spanning links); ``whole``: without graphs, by all pairs of a shard; ``overlap`` 0: labels are shards."""
    if overlap:
        dealt = materialize(_cut(nodes, kind, overlap))
    else:
        dealt = nodes.select("node", "copies", "b", F.xxhash64("label", F.octet_length("b")).alias("shard"))
    lists = dealt.groupBy("node").agg(F.array_sort(F.collect_set("shard")).alias("shards"))  # a few a node
    sizes = materialize(dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("m")))
    # shards over MOST are dealt in cells of two sides, each pair of sides once
    sized = salted_join(dealt, sizes, "shard", hot_keys(sizes, "shard", "m"), spread="node").join(lists, "node")
    sized = sized.withColumn("sides", F.when(F.col("m") <= MOST, F.lit(1)).otherwise(F.ceil(F.col("m") / (MOST // 2)).cast("int")))
    sized = sized.withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int"))
    sized = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    celled = materialize(sized.select("node", "copies", "b", "shards", "shard", "side", F.least("side", "other").alias("c1"), F.greatest("side", "other").alias("c2")))
    by = ["shard", "c1", "c2"]

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["node"].to_numpy()
        edges = build(_matrix(pdf["b"].tolist(), kind).astype(np.float32))
        return pd.DataFrame({"node": ids, "nbrs": [np.unique(ids[e[e >= 0]]) for e in edges]})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        ids, copies, side = (pdf[c].to_numpy() for c in ("node", "copies", "side"))
        if len(ids) < 2:
            return pd.DataFrame({"node": ids[:0], "n": copies[:0], "parent": ids[:0]})
        exact = _matrix(pdf["b"].tolist(), kind)
        x = exact.astype(np.float32)
        if whole:
            found = exact_search(x, least)
        else:
            flat = [np.asarray(n, dtype=np.int64) for n in pdf["nbrs"]]
            a, b = np.repeat(np.arange(len(ids)), [len(n) for n in flat]), np.concatenate(flat)
            at = np.minimum(np.searchsorted(ids, b), len(ids) - 1)
            here = (ids[at] == b) & (at != a)
            a, at = a[here], at[here]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            edges = np.full((len(ids), int(place.max(initial=0)) + 1), -1)
            edges[a, place] = at
            found = range_search(x, edges, least)
        # both ends know a pair that either found
        q = np.repeat(np.arange(len(ids)), [len(f) for f in found])
        t = np.concatenate(found)
        lo, hi = np.minimum(q, t), np.maximum(q, t)
        key = np.unique((lo * len(ids) + hi)[lo != hi])
        lo, hi = key // len(ids), key % len(ids)
        ok = np.ones(len(lo), bool)
        for s in range(0, len(lo), 65_536):
            ok[s : s + 65_536] = (exact[lo[s : s + 65_536]] * exact[hi[s : s + 65_536]]).sum(axis=1) >= least
        if int(pdf["c1"].iloc[0]) != int(pdf["c2"].iloc[0]):
            ok &= side[lo] != side[hi]
        lo, hi = lo[ok], hi[ok]
        # counted in the first shard that both share
        shard = int(pdf["shard"].iloc[0])
        lists = [np.asarray(s, np.int64) for s in pdf["shards"]]
        width = max(len(s) for s in lists)
        table_, there = np.zeros((len(ids), width), np.int64), np.zeros((len(ids), width), bool)
        for k, s in enumerate(lists):
            table_[k, : len(s)], there[k, : len(s)] = s, True
        first = np.ones(len(lo), bool)
        for k in range(width):
            s = table_[lo, k]
            first &= ~(((table_[hi] == s[:, None]) & there[hi]).any(axis=1) & there[lo, k] & (s < shard))
        n = np.bincount(lo[first], copies[hi[first]], len(ids)) + np.bincount(hi[first], copies[lo[first]], len(ids))
        parent = np.arange(len(ids))
        while len(lo):  # smallest node reached, in this shard
            new = parent.copy()
            np.minimum.at(new, hi, parent[lo])
            np.minimum.at(new, lo, parent[hi])
            new = new[new]
            if (new == parent).all():
                break
            parent = new
        use = np.flatnonzero((n > 0) | (parent != np.arange(len(ids))))
        return pd.DataFrame({"node": ids[use], "n": n[use].astype(np.int64), "parent": ids[parent[use]]})

    searched = celled
    if not whole:
        graphs = celled.select("node", "b", *by).groupBy(*by).applyInPandas(graph, "node long, nbrs array<long>")
        # lists that a node has in its shards and cells, of DEGREE + FAR entries each
        searched = celled.join(graphs.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs")), "node")
    found = materialize(searched.groupBy(*by).applyInPandas(search, FOUND))
    return found, found.filter("node <> parent").select(F.col("node").alias("a"), F.col("parent").alias("b"))


def _audit(nodes: DataFrame, counted: DataFrame, kind: str, least: float) -> tuple[float | None, int]:
    """(recall, random nodes audited): links found over links there are, of nodes that are compared with all nodes.

    Random nodes and nodes with links are judged apart, and the worse share counts: groups that were lost as a whole show
    among the random ones only. Of these, more are drawn until ENOUGH links are seen; None if there are none among MOST_AUDIT.
    """
    linked = nodes.join(counted.filter("n > 0").orderBy(F.xxhash64("node", F.lit("linked"))).limit(LINKED).select("node"), "node").select("node", "label", "b")
    share, links = _share(nodes, linked, counted, kind, least)
    every, n = nodes.count(), AUDIT
    while True:
        drawn = nodes.orderBy(F.xxhash64("node", F.lit("audit"))).limit(n).select("node", "label", "b")
        random, seen = _share(nodes, drawn, counted, kind, least)
        if seen >= ENOUGH or n >= min(every, MOST_AUDIT):
            return min((x for x in (share, random) if x is not None), default=None), min(n, every)
        n = min(4 * n, MOST_AUDIT)


def _share(nodes: DataFrame, drawn: DataFrame, counted: DataFrame, kind: str, least: float) -> tuple[float | None, int]:
    """(links found over links there are, links there are) of the nodes ``drawn``, of which there are MOST_AUDIT at most."""
    audit = drawn.toPandas()
    shared = nodes.sparkSession.sparkContext.broadcast({k: (g["node"].to_numpy(), _matrix(g["b"].tolist(), kind)) for k, g in audit.groupby(["label", audit["b"].map(len)])})

    def compare(batches):
        for pdf in batches:
            out = [pd.DataFrame({"node": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})]
            for k, part in pdf.groupby(["label", pdf["b"].map(len)]):
                if k in shared.value:
                    ids, x = shared.value[k]
                    y, names, copies, n = _matrix(part["b"].tolist(), kind), part["node"].to_numpy(), part["copies"].to_numpy(), np.zeros(len(ids), np.int64)
                    for lo in range(0, len(y), QUERIES):
                        hit = (x @ y[lo : lo + QUERIES].T >= least) & (ids[:, None] != names[None, lo : lo + QUERIES])
                        n += hit @ copies[lo : lo + QUERIES]
                    out.append(pd.DataFrame({"node": ids, "n": n}))
            yield pd.concat(out)

    true = nodes.select("node", "label", "b", "copies").mapInPandas(compare, "node long, n long").groupBy("node").agg(F.sum("n").alias("true_n"))
    got = true.join(counted, "node", "left").agg(F.sum("true_n"), F.sum(F.least("true_n", F.coalesce("n", F.lit(0))))).first()
    return (float(got[1] / got[0]) if got[0] else None), int(got[0] or 0)


def packed(kind: str):
    """Arrow UDF: a vector's components as bytes; null if it links with nothing. Zeros lose their sign."""

    @F.arrow_udf("binary")
    def pack(column: pa.Array) -> pa.Array:
        out = [None] * len(column)
        if len(column) == column.null_count:
            return pa.array(out, pa.binary())
        values, offsets = column.values, column.offsets.to_numpy()
        flat = np.where(pc.is_null(values).to_numpy(zero_copy_only=False), np.nan, pc.fill_null(values, 0).to_numpy(zero_copy_only=False)).astype(kind) + np.dtype(kind).type(0)
        valid = pc.is_valid(column).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(valid):
            v = flat[offsets[k] : offsets[k + 1]]
            if len(v) and np.isfinite(v).all() and v.any():
                out[k] = v.tobytes()
        return pa.array(out, pa.binary())

    return pack


def linked(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, target: float = 0.98) -> tuple[DataFrame, float | None]:
    """(id, n_links, component_id, kept - a row for each row of ``vectors``; the audited recall, None if the audit saw no link)."""
    kind = "<f4" if dict(vectors.dtypes)[vector] == "array<float>" else "<f8"
    source = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), (F.col(vector) if kind == "<f4" else F.col(vector).cast("array<double>")).alias("v"))
    sound = source.withColumn("b", F.when(F.col("id").isNotNull() & F.col("label").isNotNull(), packed(kind)("v"))).drop("v")
    keyed = materialize(sound.withColumn("key", F.sha2(F.concat(F.col("label").cast("binary"), F.lit(bytearray(1)), "b"), 256)))
    real = keyed.filter("key is not null")
    nodes = real.select("key", "label", "b", "id").distinct().groupBy("key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("b").alias("b"))
    # rows that share an id but not a vector: the first vector, by its key, stands for the id
    nodes = materialize(nodes.groupBy("node").agg(F.min(F.struct("key", "copies", "label", "b")).alias("r")).select("node", "r.*"))
    overlap, whole = OVERLAP, False
    while True:
        found, links = _search(nodes, kind, least, overlap, whole)
        counted = materialize(found.groupBy("node").agg(F.sum("n").alias("n")))
        recall, _ = _audit(nodes, counted, kind, least)
        if recall is None or recall >= target or not overlap:
            break
        if not whole:
            whole = True
        else:
            overlap = 2 * overlap if 2 * overlap <= FAN // 4 else 0
    comps = connected_components(links)
    by_node = nodes.select("key", "node", "copies").join(counted, "node", "left").join(comps.select(F.col("id").alias("node"), "component_id"), "node", "left")
    by_node = by_node.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("component_id"))
    hot = hot_keys(real.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "key", "c")
    out = salted_join(keyed.select("id", "key"), by_node, "key", hot, "left", spread="id")
    known = F.col("id").isNotNull()
    out = out.select(F.col("id").alias(id), F.when(known, F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(known, F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True))), recall


def audited(vectors: DataFrame, **options) -> DataFrame:
    """The rows of ``linked``, with ``recall``: what the audit measured for the whole table; null if it saw no link."""
    rows, recall = linked(vectors, **options)
    return rows.withColumn("recall", F.lit(recall).cast("double"))


def near_duplicates(vectors: DataFrame, **options) -> DataFrame:
    """The rows of ``linked``."""
    return linked(vectors, **options)[0]


def op8(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_sql() -> str:
    return """
    WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    u AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
    r AS (SELECT vec_id, vec_id AS c FROM e UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
    SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, m.vec_id = m.c AS kept
    FROM (SELECT vec_id, min(c) AS c FROM r GROUP BY 1) m LEFT JOIN n ON n.a = m.vec_id"""
