"""Benchmark decontamination by a CGK embedding with bit-sampling LSH, and exact edit verification.

Words (runs of letters and digits, A-Z lower-cased) are the symbols. The CGK walk maps a sequence to one of steps: at
each step it writes the symbol it stands on, and moves on by a random bit that depends on step and symbol; sequences of
small edit distance then agree at many steps, their Hamming distance. Items are put in classes of like length; a walk is
STEPS times as long as the class's shortest item: moving on in every other step, it passes over all of an item with steps to spare, and what is
beyond that is padding, which no sample may hold. Windows of a document are as long as that item, and walk the same way. Several walks, and of each several tables that sample a few
of its steps, are laid on; their number is raised until simulated edits at the threshold, at random places and in one piece
at either end, are each found as often as ``target`` asks. A document and an item of which a window shares a sample are
verified by the exact edit distance of the item to the best substring of the document, so that distances are the least there
are; only stretches with as many of the item's runs as edits must leave whole are looked at for that. Classes that MOST_WALKS walks don't find often enough
have no tables: there, all places with as many runs of an item as edits must leave whole are verified.

A window is walked only if as many short runs of words as edits within the threshold must leave whole lie where such a window
would have them, within what these edits can move them by: elsewhere nothing could be verified. Windows may start
before a document, in the padding that parts documents, for items that have lost their first words.
Benchmarks are read in blocks of bounded size, each of them against all documents in a pass of its own.

A document and an item match if the item is within (1 - similarity) * its length of word edits of a substring of the
document. Rows: null and wordless texts match nothing, nor do null and wordless items, nor items without an id; items of
fewer than SHORT words match as they stand; repeated rows match each for itself; texts may be of any length; empty tables
give an empty result; further columns of any name are kept by ``clean`` and left out by ``contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from heliograph.llm.common import table
from heliograph.llm.wordops import ALNUM, mix, texts_of, trim, words

#: Words of items that are held at a time: an index takes some 100 bytes a word.
BLOCK_WORDS = 1_000_000
#: Steps of a walk for each word, steps sampled a table, tables a walk, walks at most, and the ratio of lengths in a class.
STEPS, SAMPLED, TABLES, MOST_WALKS, RATIO = 3, 2, 4, 64, 1.25
#: Starts about a place that the simulation tries: fewer than a search does.
TRIED = 5
SHORT = 5
#: Windows walked at a time, and words of documents held at a time.
WINDOWS, HELD = 10_000, 150_000


def edit_distance_in(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(distance, end) of ``item`` to the substring of ``text`` that is nearest to it."""
    n = len(text)
    at = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for k, symbol in enumerate(item, 1):
        new = np.empty(n + 1, np.int64)
        new[0] = k
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != symbol))
        row = np.minimum.accumulate(new - at) + at
    end = int(row.argmin())
    return int(row[end]), end


def allowed(n: int, similarity: float) -> int:
    """Most edits of an item of ``n`` words."""
    return int((1 - similarity) * n + 1e-9) if n >= SHORT else 0


def walk(symbols: np.ndarray, starts: np.ndarray, size: int, seed: int) -> np.ndarray:
    """(steps, starts) symbols of the CGK walks over ``size`` symbols from each of ``starts``, then over padding (0)."""
    steps = STEPS * size
    out, bit = np.empty((steps, len(starts)), np.uint64), np.empty(len(starts), np.uint64)
    at, stop = starts.copy(), starts + size
    for j, s in enumerate(out):
        np.take(symbols, at, out=s, mode="clip")
        if j >= size:  # no walk is at its end before
            s[at >= stop] = 0
        np.bitwise_xor(s, np.uint64((seed * 1_000_003 + j * 7_919 + 12_345) * 0x9E3779B97F4A7C15 % (1 << 64)), out=bit)
        bit *= np.uint64(0xD1B54A32D192ED03)
        bit >>= np.uint64(63)
        at += bit.view(np.int64)
        if j >= size:
            np.minimum(at, stop, out=at)
    return out


@dataclass
class Class:
    """Items of like length. walks: (seed, tables), a table: (steps, sorted keys, items in their order); none if they miss the target."""

    low: int
    high: int
    walks: list = field(default_factory=list)
    recall: float = 0.0  # simulated, of the kind of edits found least


@dataclass
class Index:
    similarity: float
    ids: list
    items: list[np.ndarray]
    runs: dict  # length of a run -> (sorted hashes, item, offset)
    classes: list[Class]

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each item, its most edits, and the fewest of its runs that these leave whole."""
        n = np.array([len(i) for i in self.items])
        k = np.array([allowed(x, self.similarity) for x in n])
        run = np.array([whole_run(x, self.similarity) if x else 1 for x in n])
        return n, k, np.maximum(1, n - run + 1 - k * run)

    def recall_of(self, item: int) -> float:
        """What was simulated for an item's class; 1 where all places are verified."""
        c = self.classes[int(np.searchsorted([c.low for c in self.classes], len(self.items[item]), side="right")) - 1]
        return c.recall if c.walks else 1.0


def _key(outputs: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the sampled symbols, whether none of them is padding)."""
    h, whole = np.zeros(outputs.shape[1], np.uint64), np.ones(outputs.shape[1], bool)
    for s in steps:
        h = mix(h) + outputs[s]
        whole &= outputs[s] != 0
    return mix(h), whole


def _edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = item.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(out)))
        if kind == 0:
            out[at] = int(rng.integers(1 << 62))
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, int(rng.integers(1 << 62)))
    return np.array(out, np.uint64)


def _probes(item: np.ndarray, edits: int, rng: np.random.Generator) -> Iterator[tuple[str, np.ndarray, int]]:
    """(kind, edited item, words that were cut off its start): edits all over, cut-off ends, and ends that are replaced."""
    yield "edits", _edited(item, edits, rng), 0
    if edits:
        other = rng.integers(1 << 62, size=edits).astype(np.uint64)
        yield "start cut", item[edits:], edits
        yield "end cut", item[:-edits], 0
        yield "start replaced", np.concatenate([other, item[edits:]]), 0
        yield "end replaced", np.concatenate([item[:-edits], other]), 0


def whole_run(n: int, similarity: float) -> int:
    """Words, 3 at most, of a run that an item of ``n`` words keeps whole whatever edits within the threshold there are."""
    k = allowed(n, similarity)
    return max(1, min(3, n, (n - k) // (k + 1)))


def runs_of(w: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(0, len(w) - n + 1), np.uint64)
    for k in range(n):
        h = mix(h) + w[k : len(w) - n + 1 + k]
    return mix(h)


def _stream(parts: list[np.ndarray], pad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts end to end with padding about them, and where each starts."""
    starts = np.cumsum([len(pad)] + [len(p) + len(pad) for p in parts])[:-1]
    return np.concatenate([pad, *(x for p in parts for x in (p, pad))]), starts


def build(ids: list, items: list[np.ndarray], similarity: float = 0.8, target: float = 0.98, seed: int = 3) -> Index:
    classes: list[Class] = []
    lengths = sorted({len(i) for i in items if len(i)})
    while lengths:
        low = lengths[0]
        high = max(n for n in lengths if n <= max(low, low * RATIO))
        classes.append(Class(low, high))
        lengths = [n for n in lengths if n > high]
    for c in classes:
        members = [k for k, i in enumerate(items) if c.low <= len(i) <= c.high]
        rng = np.random.default_rng(seed + c.low)
        pad = np.zeros(c.high + allowed(c.high, similarity) + TRIED, np.uint64)
        # members may be few: each is edited again, in other ways
        drawn = [members[k % len(members)] for k in range(60)]
        probes = [(items[k], *p) for k in drawn for p in _probes(items[k], allowed(len(items[k]), similarity), rng)]
        kinds = np.unique([kind for _, kind, *_ in probes], return_inverse=True)[1]
        whole, at = _stream([p[0] for p in probes], pad)
        edited, place = _stream([p[2] for p in probes], pad)
        # a window starts where the item would, or near that
        starts = ((place - np.array([p[3] for p in probes]))[:, None] + np.arange(TRIED)[None, :] - TRIED // 2).ravel()
        stream, begin = _stream([items[k] for k in members], pad)
        found = np.zeros(len(probes), bool)
        while c.recall < target and len(c.walks) < MOST_WALKS:
            no = len(c.walks) + 1000 * seed
            a, b, mine = walk(whole, at, c.low, no), walk(edited, starts, c.low, no), walk(stream, begin, c.low, no)
            tables = []
            for _ in range(TABLES):
                steps = np.sort(rng.choice(STEPS * c.low, min(SAMPLED, c.low), replace=False))
                (x, ok), (y, fine), (keys, use) = (_key(w, steps) for w in (a, b, mine))
                hit = (y.reshape(len(probes), TRIED) == x[:, None]) & fine.reshape(len(probes), TRIED) & ok[:, None]
                found |= hit.any(axis=1)
                use = np.flatnonzero(use)
                order = use[np.argsort(keys[use], kind="stable")]
                tables.append((steps, keys[order], np.array(members)[order]))
            c.walks.append((no, tables))
            c.recall = float((np.bincount(kinds, found) / np.bincount(kinds)).min())  # of the kind found least
        if c.recall < target:
            c.walks = []
    runs = {}
    for n in (1, 2, 3):
        parts = [(runs_of(i, n), np.full(len(i) - n + 1, k), np.arange(len(i) - n + 1)) for k, i in enumerate(items) if len(i) and whole_run(len(i), similarity) == n]
        if parts:
            h, item, offset = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            runs[n] = h[order], item[order], offset[order]
    return Index(similarity, ids, items, runs, classes)


def _enough(index: Index, spot: np.ndarray, owner: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows from which on the item's runs put enough windows close together, the last row of each), of rows by item, document and spot."""
    _, k, runs = index.bounds
    # the run that is ``least`` - 1 places on is of the same document and item, and no farther than edits can part them
    last = np.arange(len(spot)) + runs[owner] - 1
    at = np.minimum(last, len(spot) - 1)
    rows = np.flatnonzero((last < len(spot)) & (owner[at] == owner) & (doc[at] == doc) & (spot[at] - spot <= 2 * k[owner]))
    return rows, at[rows]


def _crowded(index: Index, spot: np.ndarray, owner: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows are part of a stretch of ``_places``: no others can be of a match."""
    order = np.lexsort([spot, doc, owner])
    first, last = _enough(index, spot[order], owner[order], doc[order])
    depth = np.bincount(first, minlength=len(spot) + 1) - np.bincount(last + 1, minlength=len(spot) + 1)
    out = np.zeros(len(spot), bool)
    out[order] = np.cumsum(depth)[:-1] > 0
    return out


def _places(index: Index, spot: np.ndarray, owner: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first and last start) of all stretches where the item's runs put enough windows close together.

    An edit breaks at most n of an item's runs of n words, and all edits together move none by more than their number.
    """
    if not len(spot):
        return
    order = np.lexsort([spot, doc, owner])
    spot, owner, doc = spot[order], owner[order], doc[order]
    n, k, _ = index.bounds
    rows, _ = _enough(index, spot, owner, doc)
    if not len(rows):
        return
    # overlapping stretches are verified at once
    a, b, reach = rows[:-1], rows[1:], n[owner[rows[:-1]]]
    cuts = np.flatnonzero((owner[a] != owner[b]) | (doc[a] != doc[b]) | (spot[b] - spot[a] > reach)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
        first, end = rows[lo], rows[hi - 1]
        edits = int(k[owner[first]])
        yield int(doc[first]), int(owner[first]), int(spot[first]) - edits, int(spot[end]) + edits


def matches(index: Index, docs: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(document, item, distance, start of the match) for each item found in each of ``docs``, lists of words.

    Documents are laid end to end, padded apart, so that all steps run over many of them at once.
    """
    if not index.runs or not any(len(d) for d in docs):
        return []
    gap = np.zeros(max(c.high + allowed(c.high, index.similarity) for c in index.classes) + 2, np.uint64)
    stream = np.concatenate([gap, *(x for d in docs for x in (d, gap))])
    sizes = np.array([len(d) for d in docs])
    begin = len(gap) + np.concatenate([[0], np.cumsum(sizes + len(gap))[:-1]])
    # places of windows, by item: where a run puts its start, and as far around as edits can
    lengths = index.bounds[0]
    spots, owners, places = [], [], []
    for n, (hashes, item, offset) in index.runs.items():
        h = runs_of(stream, n)
        left = np.searchsorted(hashes, h)
        left[left == len(hashes)] = 0
        at = np.flatnonzero(hashes[left] == h)
        left, right = left[at], np.searchsorted(hashes, h[at], side="right")
        count = right - left
        which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)
        spots.append(np.repeat(at, count) - offset[which])
        owners.append(item[which])
        places.append(np.repeat(at, count))
    spot, owner, place = np.concatenate(spots), np.concatenate(owners), np.concatenate(places)
    if not len(spot):
        return []
    of = np.searchsorted(begin, place, side="right") - 1
    near = _crowded(index, spot, owner, of)
    spot, owner, of = spot[near], owner[near], of[near]
    if not len(spot):
        return []
    out: list[tuple[int, int, int, int]] = []
    known: set[tuple[int, int]] = set()
    pair = of * len(lengths) + owner
    by_pair = np.argsort(pair, kind="stable")
    pair = pair[by_pair]

    def verify(doc: int, item: int) -> None:
        """Match the item with all of the document's places for it: the least distance, and of those the first."""
        if (doc, item) in known:
            return
        known.add((doc, item))
        target = index.items[item]
        edits = allowed(len(target), index.similarity)
        here = by_pair[slice(*np.searchsorted(pair, [doc * len(lengths) + item, doc * len(lengths) + item + 1]))]
        best: tuple[int, int] | None = None
        for _, _, first, last in _places(index, spot[here], owner[here], of[here]):
            origin = max(begin[doc], first - edits)
            near = stream[origin : min(begin[doc] + sizes[doc], last + len(target) + edits)]
            if sum(map(set(near.tolist()).__contains__, target.tolist())) < len(target) - edits:
                continue
            distance, end = edit_distance_in(target, near)
            if distance <= edits and (best is None or distance < best[0]):
                _, back = edit_distance_in(target[::-1], near[:end][::-1])
                best = distance, int(origin + end - back - begin[doc])
        if best:
            out.append((doc, item, *best))

    exact = np.isin(np.searchsorted([c.low for c in index.classes], lengths, side="right") - 1, [j for j, c in enumerate(index.classes) if not c.walks])
    mine = exact[owner]
    for doc, item, *_ in _places(index, spot[mine], owner[mine], of[mine]):
        verify(doc, item)
    pairs = np.unique(np.stack([spot[~mine], owner[~mine]], 1), axis=0)
    walked_from, walked_for = pairs[:, 0], lengths[pairs[:, 1]]
    for c in index.classes:
        mine = (walked_for >= c.low) & (walked_for <= c.high)
        if not mine.any():
            continue
        k = allowed(c.high, index.similarity)
        starts = np.unique((walked_from[mine][:, None] + np.arange(-k, k + 1)[None, :]).ravel())
        # an item may have lost so many words before the document's first one
        inside = np.searchsorted(begin - k, starts, side="right") - 1
        starts = starts[(inside >= 0) & (starts < begin[inside] + sizes[inside])]
        for lo in range(0, len(starts), WINDOWS):
            part = starts[lo : lo + WINDOWS]
            hits = []
            for no, tables in c.walks:
                walked = walk(stream, part, c.low, no)
                for steps, keys, items in tables:
                    if not len(keys):
                        continue
                    key, whole = _key(walked, steps)
                    left = np.searchsorted(keys, key)
                    left[left == len(keys)] = 0
                    at = np.flatnonzero((keys[left] == key) & whole)
                    if len(at):
                        count = np.searchsorted(keys, key[at], side="right") - left[at]
                        which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left[at], count)
                        hits.append(np.unique(np.stack([np.repeat(part[at], count), items[which]], 1), axis=0))
            if not hits:
                continue
            for start, item in np.unique(np.concatenate(hits), axis=0).tolist():
                verify(int(np.searchsorted(begin - k, start, side="right") - 1), item)
    return sorted(out)


def _blocks(benchmark: DataFrame, item: str, text: str, similarity: float) -> Iterator[Index]:
    """Indexes over blocks of about BLOCK_WORDS words of items, one at a time."""
    named = benchmark.select(F.col(item).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    # a word and what parts it take two bytes at least
    blocks = max(1, -(-(named.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (2 * BLOCK_WORDS)))
    for k in range(blocks):
        rows = named.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()
        rows = sorted(rows, key=lambda r: (r["id"], r["text"]))
        items = [(r["id"], words(np.frombuffer(r["text"].encode(), np.uint8), ALNUM)) for r in rows]
        items = [(i, w) for i, w in items if len(w)]
        yield build([i for i, _ in items], [w for _, w in items], similarity)


def _all(index: Index, column: pa.Array, most: int = HELD) -> list[tuple[int, int, int, int]]:
    """matches() over a column of texts, about ``most`` words at a time."""
    out, held, first, size = [], [], 0, 0
    for r, data in enumerate(texts_of(column)):
        held.append(words(data, ALNUM))
        size += len(held[-1])
        if size >= most:
            out += [(first + d, *m) for d, *m in matches(index, held)]
            held, first, size = [], r + 1, 0
    return out + [(first + d, *m) for d, *m in matches(index, held)]


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", similarity: float = 0.8) -> DataFrame:
    """id, item, distance, similarity, word_start, recall: a row for each document and item that match.

    recall: the share of simulated edits at the threshold that the item's index found.
    """
    spark, out = docs.sparkSession, None
    types = dict(docs.dtypes)[id], dict(benchmark.dtypes)[item]
    kind = to_arrow_type(benchmark.schema[item].dataType)
    schema = f"`{id}` {types[0]}, `{item}` {types[1]}, distance int, similarity double, word_start long, recall double"
    for index in _blocks(benchmark, item, "text", similarity):
        shared = spark.sparkContext.broadcast(index)  # items of at most about BLOCK_WORDS words

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                rows = _all(index, b.column(1))
                sims = [1 - d / len(index.items[i]) for _, i, d, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([r for r, *_ in rows], pa.int64())), pa.array([index.ids[i] for _, i, _, _ in rows], kind), pa.array([d for _, _, d, _ in rows], pa.int32()), pa.array(sims, pa.float64()), pa.array([s for *_, s in rows], pa.int64()), pa.array([index.recall_of(i) for _, i, _, _ in rows], pa.float64())],
                    names=[id, item, "distance", "similarity", "word_start", "recall"],
                )

        one = docs.select(id, text).mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", similarity: float = 0.8) -> DataFrame:
    """``docs`` without the documents that match an item; no join is needed for that."""
    for index in _blocks(benchmark, item, "text", similarity):
        docs = docs.filter(~_dirty(docs.sparkSession.sparkContext.broadcast(index))(F.col(text)))
    return docs


def _dirty(shared):
    @F.arrow_udf("boolean")
    def dirty(column: pa.Array) -> pa.Array:
        hit = {r for r, *_ in _all(shared.value, column)}
        trim()
        return pa.array([r in hit for r in range(len(column))], pa.bool_())

    return dirty


def op7(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
