"""Near duplicates by b-bit MinHash.

Texts with equal shingle sets form a class first, so exact copies cost one row each. Of each class one document's
minima are kept: 7-row bands (for a similarity of 0.85) give candidate buckets, and the packed low bits of all minima
give a collision-corrected estimate by bit counts. Small buckets are one cell, which hands on only a spanning forest of its
plausible pairs; these are confirmed on the full sets. In larger buckets each member is held against PIVOTS of them first
and handed on with the most similar one; members that this doesn't bring into the bucket's main component are left over,
and are dealt with the others in cells of bounded size, which cover all pairs that have a left-over member. Where links
fail, the components that they would have joined are dealt in cells in the same way, with the full sets, and each cell
hands on a forest of the links that it confirms between them. So a group of near copies costs a few rows a member, and no
link between different texts is lost but by the bands (one in a million at the threshold) or the estimate's margin of 3.5
standard deviations. What remains as the product of sizes is a bucket whose members are alike to the bands, but are not
near copies.

Rows: a null or wordless text has an empty set and links with nothing; with fewer words than a shingle has, the whole
sequence is one; a null id links with nothing and is kept (its component is null); rows that share an id and a text are one
document, rows that share an id only are each linked by their own text and have that id in common; an empty table gives an empty result. Only the id and text
columns are read; ``keep_one`` keeps all columns, of any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.llm.common import checkpointed, hot_keys, partitions_for, salted_join, table
from heliograph.llm.components import connected_components
from heliograph.llm.wordops import mix, shingles, texts_of, trimmed, words

#: Minima a document, and low bits kept of each.
MINIMA, BITS = 256, 2
_PER_WORD = 64 // BITS
#: Most documents of a bucket in a side of a cell, and members of a larger bucket that all others are held against.
SIDE, PIVOTS = 128, 4
#: Most in a side where rows carry full sets.
FULL_SIDE = 128
#: Pairs that meet their sets in a task, at least.
PAIRS_A_TASK = 250
#: A cell's number is that of its lower side times this, plus its higher side.
_CELL = 1_000_000_000
#: Ids that may be broadcast: 8 bytes each.
FEW_IDS = 500_000
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)


def rows_a_band(threshold: float, miss: float = 1e-5) -> int:
    """The longest band whose bands together miss a pair at the threshold at most so often."""
    fit = [r for r in range(2, 16) if (1 - threshold**r) ** (MINIMA // r) <= miss]
    return max(fit, default=2)


def minima(s: np.ndarray) -> np.ndarray:
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    h = (s >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(h), 2048):
        x = _MUL[:, None] * h[None, k : k + 2048]
        x += _ADD[:, None]
        np.minimum(low, x.min(axis=1), out=low)
    return low


def pack(low: np.ndarray) -> np.ndarray:
    """(documents, MINIMA) minima -> (documents, MINIMA / 32) words of low bits."""
    bits = ((low * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint64)
    bits = bits.reshape(len(low), -1, _PER_WORD) << (np.arange(_PER_WORD, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(bits, axis=2)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures, corrected for chance collisions of the bits kept."""
    x = a ^ b
    for k in range(1, BITS):
        x |= (a ^ b) >> np.uint64(k)
    ones = sum(1 << (k * BITS) for k in range(_PER_WORD))
    differ = np.bitwise_count(x & np.uint64(ones)).sum(axis=-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return ((1 - differ / MINIMA) - chance) / (1 - chance)


def margin(threshold: float, deviations: float = 3.5) -> float:
    chance = 1 / (1 << BITS)
    p = threshold + (1 - threshold) * chance
    return deviations * math.sqrt(p * (1 - p) / MINIMA) / (1 - chance)


def _sketch(n: int, rows: int):
    """mapInArrow: id, text -> id, n_shingles, set_key, signature, bands."""
    bands = MINIMA // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes, keys, lows = [], [], []
                for data in texts_of(batch.column(1)):
                    s = shingles(words(data), n)
                    sizes.append(len(s))
                    keys.append(s.sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(mix(s + np.uint64(len(s)))).tobytes() if len(s) else None)
                    lows.append(minima(s) if len(s) else np.zeros(MINIMA, np.uint32))
                low = np.stack(lows) if lows else np.zeros((0, MINIMA), np.uint32)
                packed = pack(low)
                h = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(low), bands)).copy()
                for r in range(rows):
                    h = mix(h) + low[:, r : rows * bands : rows].astype(np.uint64)
                h = mix(h).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, h.size + 1, bands, dtype=np.int32), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array([p.tobytes() for p in packed], pa.binary()), lists],
                    names=["id", "n_shingles", "set_key", "sig", "bands"],
                )

    return run


def _by_cell(of_cell, columns: tuple[str, ...]):
    """mapInArrow over rows sorted by key and cell: ``of_cell(table, two_sides)`` -> pairs (a, b) of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, found, held = None, [], 0

        def flush():
            nonlocal found, held
            a, b = (np.concatenate(x) for x in zip(*found))
            found, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        def walk(t: pa.Table, last: bool):
            nonlocal rest, held
            key, cell = (t.column(c).to_numpy() for c in ("key", "cell"))
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1, [len(key)]])
            rest = None if last else t.slice(cuts[-2])
            cuts = cuts if last else cuts[:-1]
            plain = {c: t.column(c).to_numpy() for c in columns}
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(t.num_rows, -1)
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e - s > 1:
                    sets = t.column("set").slice(s, e - s) if "set" in t.column_names else None
                    got = of_cell({c: v[s:e] for c, v in plain.items()} | {"sig": sig[s:e], "set": sets}, cell[s] // _CELL != cell[s] % _CELL)
                    if got is not None and len(got[0]):
                        found.append(got)
                        held += len(got[0])
                        if held > 20_000:
                            yield flush()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None and rest.num_rows else t
            if t.num_rows:
                yield from walk(t, False)
        if rest is not None and rest.num_rows:
            yield from walk(rest, True)
        if held:
            yield flush()

    return run


def _forest(low_est: float):
    """Of each cell: a maximal spanning forest of its pairs with an estimate of at least ``low_est``.

    Prim's walk from the smallest id; rows of the matrix are made as they are needed. In a cell of two sides, pairs of
    both sides only.
    """

    def of_cell(t: dict, two: bool):
        ids, sig, side = t["id"], t["sig"], t["side"]
        n = len(ids)
        if n == 2:
            ok = ids[0] != ids[1] and (not two or side[0] != side[1]) and estimate(sig[0], sig[1]) >= low_est
            return (ids[:1], ids[1:]) if ok else None
        order = np.argsort(ids, kind="stable")
        ids, sig, side = ids[order], sig[order], side[order]
        best, parent, done = np.full(n, -1.0), np.zeros(n, np.int64), np.zeros(n, bool)
        out, at = [], 0
        for _ in range(n):
            done[at] = True
            est = estimate(sig[at][None, :], sig)
            if two:
                est = np.where(side == side[at], -1.0, est)
            better = ~done & (est > best)
            best[better], parent[better] = est[better], at
            left = np.where(done, -2.0, best)
            nxt = int(left.argmax())
            if left[nxt] <= -2.0:
                break
            if best[nxt] >= low_est:
                out.append((parent[nxt], nxt))
            at = nxt
        if not out:
            return None
        i, j = np.array(out).T
        return ids[i], ids[j]

    return of_cell


def _crossing(low_est: float, percent: int):
    """Of each cell: confirmed links between its components, enough to join those that any plausible pair joins."""

    def of_cell(t: dict, two: bool):
        ids, sig, side, comp = t["id"], t["sig"], t["side"], t["comp"].copy()
        _, comp, sizes = np.unique(comp, return_inverse=True, return_counts=True)
        if len(sizes) < 2:
            return None
        flat = [np.frombuffer(v.as_buffer(), np.uint64) for v in t["set"]]
        long = np.array([len(x) for x in flat])
        out = []
        # nodes of small components first: what they join needs no further test
        for u in np.argsort(sizes[comp], kind="stable"):
            cand = (comp != comp[u]) & (100 * np.minimum(long, long[u]) >= percent * np.maximum(long, long[u]))
            if two:
                cand &= side != side[u]
            cand = np.flatnonzero(cand)
            if not len(cand):
                continue
            est = estimate(sig[u][None, :], sig[cand])
            cand = cand[est >= low_est]
            if not len(cand):
                continue
            values = np.concatenate([flat[k] for k in cand])
            at = np.searchsorted(flat[u], values)
            at[at == len(flat[u])] = 0
            both = np.add.reduceat((flat[u][at] == values).astype(np.int64), np.concatenate([[0], np.cumsum(long[cand])[:-1]]))
            for k in cand[100 * both >= percent * (long[u] + long[cand] - both)]:
                if comp[k] != comp[u]:
                    out.append((u, k))
                    comp[comp == comp[k]] = comp[u]
        if not out:
            return None
        i, j = np.array(out).T
        return ids[i], ids[j]

    return of_cell


def _full_sets(n: int):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(words(d), n).tobytes() for d in texts_of(batch.column(1))], pa.binary())], names=["id", "set"])

    return run


def _confirm(percent: int):
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    ok.append(False)
                    continue
                both = np.concatenate([s, t])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inter >= percent * (len(s) + len(t) - inter))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return run


def _plausible(low_est: float):
    """mapInArrow over (key, id, sig, pivot, pivot_sig): the pairs whose estimate is at least ``low_est``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("sig", "pivot_sig"))
            est = estimate(one, two)
            keep = pa.array(est >= low_est)
            yield pa.RecordBatch.from_arrays([b.column("key").filter(keep), b.column("id").filter(keep), b.column("pivot").filter(keep), pa.array(est).filter(keep)], names=["key", "id", "pivot", "est"])

    return run


def _cells(members: DataFrame, most: int) -> DataFrame:
    """Cells of at most about ``most`` rows a side over rows (key, id, main, ...) that cover all pairs but those of two main ones.

    Left-over rows are dealt to sides 0, 1, ..., main ones to sides after them; cell i, j has the rows of both sides, and
    there is one for each i that is left over.
    """
    sizes = checkpointed(members.groupBy("key").agg(F.count_if(~F.col("main")).alias("left"), F.count_if("main").alias("mains")))
    sizes = sizes.filter("left > 0").select("key", F.ceil(F.col("left") / most).cast("int").alias("ls"), F.ceil(F.col("mains") / most).cast("int").alias("ms"), (F.col("left") + F.col("mains")).alias("n"))
    sided = salted_join(members, sizes.select("key", "ls", "ms"), "key", hot_keys(sizes, "key", "n"), spread="id")
    sided = sided.withColumn("side", F.when(F.col("main"), F.col("ls") + F.pmod(F.xxhash64("id"), F.col("ms")).cast("int")).otherwise(F.pmod(F.xxhash64("id"), F.col("ls")).cast("int")))
    others = F.sequence(F.lit(0), F.when(F.col("main"), F.col("ls")).otherwise(F.col("ls") + F.col("ms")) - 1)
    return sided.withColumn("other", F.explode(others)).withColumn("cell", F.least("side", "other").cast("long") * _CELL + F.greatest("side", "other"))


def _dealt(cells: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows by cell; Spark puts small cells together in a task, unless their rows are wide and ``tasks`` is given."""
    by = cells.repartition("key", "cell") if tasks is None else cells.repartition(tasks, "key", "cell")
    return by.sortWithinPartitions("key", "cell")


class _Links:
    """Confirmed links, and those that failed, of pairs that are handed in bit by bit."""

    def __init__(self, source: DataFrame, n: int, percent: int):
        self.source, self.n, self.percent = source, n, percent
        self.tested = None

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, set) of distinct ``ids``; of rows that share an id, those with the same text are one."""
        ids = checkpointed(ids)
        texts = self.source.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "id", "left_semi")
        return checkpointed(texts.mapInArrow(trimmed(_full_sets(self.n)), "id long, set binary").distinct())

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """All links confirmed so far, after the test of ``pairs`` (a, b)."""
        pairs = checkpointed(pairs)
        ids = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")))
        sets, hot = self.sets(ids.select("id")), hot_keys(ids, "id", "n")

        def with_set(of: DataFrame, end: str, other: str) -> DataFrame:
            return salted_join(of, sets.select(F.col("id").alias(end), F.col("set").alias(f"s{end}")), end, hot, spread=other)

        # dealt anew: rows with two sets each must not come in few partitions, as the pairs' small table does
        dealt = pairs.repartition(min(partitions_for(pairs.sparkSession), 1 + pairs.count() // PAIRS_A_TASK))
        tested = with_set(with_set(dealt, "a", "b"), "b", "a").mapInArrow(trimmed(_confirm(self.percent)), "a long, b long, ok boolean")
        tested = checkpointed(tested.groupBy("a", "b").agg(F.max("ok").alias("ok")))
        self.tested = tested if self.tested is None else self.tested.unionByName(tested)
        return self.linked()

    def linked(self) -> DataFrame:
        return self.tested.filter("ok").select("a", "b")

    def failed(self) -> DataFrame:
        return self.tested.filter("not ok").select("a", "b")


def _large_buckets(banded: DataFrame, sizes: DataFrame, sigs: DataFrame, low_est: float) -> tuple[DataFrame, DataFrame]:
    """(key, id, sig of the members of buckets larger than SIDE, the pair of each member with its most similar pivot)."""
    large = sizes.filter(F.col("n") > SIDE)
    members = checkpointed(salted_join(banded, large.select("key"), "key", hot_keys(large, "key", "n"), spread="id").join(sigs, "id"))
    # Spark keeps PIVOTS rows a key and task before the shuffle
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("id"), "id"))).filter(F.col("r") <= PIVOTS)
    pivots = checkpointed(first.groupBy("key").agg(F.collect_list(F.struct(F.col("id").alias("pivot"), F.col("sig").alias("pivot_sig"))).alias("pivots")))
    held = salted_join(members, pivots, "key", hot_keys(large, "key", "n"), spread="id").select("key", "id", "sig", F.inline("pivots")).filter("id <> pivot")
    near = held.mapInArrow(trimmed(_plausible(low_est)), "key long, id long, pivot long, est double")
    best = near.groupBy("key", "id").agg(F.max(F.struct("est", (-F.col("pivot")).alias("p"))).alias("b")).select("id", (-F.col("b.p")).alias("pivot"))
    return members, best.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _with_main(members: DataFrame, comps: DataFrame) -> DataFrame:
    """``members`` (key, id, ...) with ``comp`` (their component so far) and ``main`` (it is the largest of its key)."""
    placed = checkpointed(members.join(comps, "id", "left").withColumn("comp", F.coalesce("component_id", "id")).drop("component_id"))
    counts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = checkpointed(counts.groupBy("key").agg(F.max(F.struct("n", (-F.col("comp")).alias("c"))).alias("m"), F.sum("n").alias("n")).select("key", (-F.col("m.c")).alias("largest"), "n"))
    out = salted_join(placed, largest.select("key", "largest"), "key", hot_keys(largest, "key", "n"), spread="id")
    return out.withColumn("main", F.col("comp") == F.col("largest")).drop("largest")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words_a_shingle: int = 3, percent: int = 85) -> DataFrame:
    """doc_id-named id, n_shingles, component_id, kept - a row for each row of ``docs``."""
    threshold = percent / 100
    rows = rows_a_band(threshold)
    low_est = threshold - margin(threshold)
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sketched = checkpointed(source.mapInArrow(trimmed(_sketch(words_a_shingle, rows)), "id long, n_shingles long, set_key binary, sig binary, bands array<long>"))

    # classes of equal sets
    real = sketched.filter("id is not null and set_key is not null")
    classes = checkpointed(real.groupBy("set_key").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("n")))
    reps = real.select("id", "set_key", "sig", "bands").join(classes.select("set_key", F.col("cls").alias("id")), ["set_key", "id"], "left_semi").dropDuplicates(["set_key"])
    reps = checkpointed(reps.select("id", "sig", "bands"))
    sigs = reps.select("id", "sig")

    # buckets of bands with two classes or more: small ones in a cell each
    banded = reps.select("id", F.explode("bands").alias("key"))
    sizes = checkpointed(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    large = not sizes.filter(F.col("n") > SIDE).isEmpty()
    small = banded.join(sizes.filter(F.col("n") <= SIDE).select("key"), "key").join(sigs, "id")
    celled = small.select("key", F.lit(0).cast("long").alias("cell"), F.lit(0).alias("side"), "id", "sig")
    pairs = _dealt(celled).mapInArrow(trimmed(_by_cell(_forest(low_est), ("side", "id"))), "a long, b long").distinct()
    links = _Links(source, words_a_shingle, percent)
    if large:
        members, best = _large_buckets(banded, sizes, sigs, low_est)
        pairs = pairs.unionByName(best).distinct()
    comps = connected_components(links.confirm(pairs))
    if large:
        cells = _cells(_with_main(members, comps), SIDE)
        more = _dealt(cells.select("key", "cell", "side", "id", "sig")).mapInArrow(trimmed(_by_cell(_forest(low_est), ("side", "id"))), "a long, b long").distinct()
        more = checkpointed(more.join(links.tested.select("a", "b"), ["a", "b"], "left_anti"))
        if not more.isEmpty():
            comps = connected_components(links.confirm(more))

    # components that a failed link would have joined: other pairs of theirs may do so
    failed = links.failed()
    for end in ("a", "b"):
        failed = failed.join(comps.select(F.col("id").alias(end), F.col("component_id").alias(f"c{end}")), end, "left")
    failed = checkpointed(failed.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b").distinct())
    if not failed.isEmpty():
        around = connected_components(failed).select(F.col("id").alias("comp"), F.col("component_id").alias("key"))
        around = checkpointed(around.unionByName(around.select(F.col("key").alias("comp"), "key")).distinct())
        ids = links.tested.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        members = checkpointed(ids.join(comps, "id", "left").select("id", F.coalesce("component_id", "id").alias("comp")))
        hot = hot_keys(members.groupBy("comp").agg(F.count(F.lit(1)).alias("n")), "comp", "n")
        near = checkpointed(salted_join(members, around, "comp", hot, spread="id").select("key", "id"))
        cells = _cells(_with_main(near, comps), FULL_SIDE).select("key", "cell", "side", "id", "comp")
        cells = cells.join(sigs, "id").join(links.sets(near.select("id").distinct()), "id")
        more = checkpointed(_dealt(cells, partitions_for(docs.sparkSession)).mapInArrow(trimmed(_by_cell(_crossing(low_est, percent), ("side", "id", "comp"))), "a long, b long"))
        if not more.isEmpty():
            comps = connected_components(comps.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(more))
    # a class has its smallest id's component
    by_class = classes.select("set_key", "cls").join(comps.select(F.col("id").alias("cls"), "component_id"), "cls", "left").select("set_key", F.coalesce("component_id", "cls").alias("component_id"))
    out = salted_join(sketched.select("id", "n_shingles", "set_key"), by_class, "set_key", hot_keys(classes, "set_key", "n"), "left", spread="id")
    out = out.select(F.col("id").alias(id), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, linked: DataFrame, id: str = "doc_id") -> DataFrame:
    """``docs`` without those that ``linked`` (of near_duplicates) doesn't keep, and with one row of each id."""
    linked = checkpointed(linked.select(id, "kept"))
    gone = linked.filter("not kept").select(id).distinct()
    few = gone.count() <= FEW_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, id, "left_anti")
    repeated = linked.filter("kept").groupBy(id).agg(F.count(F.lit(1)).alias("n")).filter(f"n > 1 and {id} is not null")
    if repeated.isEmpty():
        return kept
    return kept.filter(F.col(id).isNull()).unionByName(kept.filter(F.col(id).isNotNull()).dropDuplicates([id]))


def op4(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_sql() -> str:
    """DuckDB: words, shingles, pairs by a join on shingles, components by recursion."""
    return r"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) END AS s FROM d),
    n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
    e AS (SELECT doc_id, unnest(s) AS x FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT both_ways.b, r.c FROM r JOIN both_ways ON both_ways.a = r.doc_id)
    SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)"""
