"""Phrase collocations: which runs of words occur together more often than their parts suggest.

Counts come from depth-limited tries. Each task counts its texts in tries of SHARD words: level k holds a node (parent, word,
count) for each distinct run of k words under a language, in the byte order of words, so that a level's order is the trie's
preorder. A trie is serialised sorted, one piece for each prefix range of paths; the pieces of a range, which are sorted
runs, are merged (equal paths' counts are added) by the range's own task, which hands on only paths that are frequent
enough. A path's left parts are its ancestors: they come down the trie, level by level, from the parent. Its right parts come
over the suffix link, which leads to the path without its first word, a level up. Any part of a frequent path is frequent, so
both are always found. All words are compared as they are, nothing is hashed, and counts are exact.

Ranges are cut at paths drawn from a bounded sample of texts (SAMPLE); that only decides where work goes. A range may
begin anywhere inside a hot word's or hot pair's subtree, so that no subtree has to lie in one task.

Rows: a null text is empty, a null language ``und``; empty texts and pieces count nothing; words and texts may be of any
length; repeated rows count again; ties in score go to the larger count, then to the phrase in byte order; further columns,
of any names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.llm.common import materialize, partitions_for, table
from heliograph.llm.wordops import texts_of, trim, trimmed

#: Bytes of text that one trie counts (a longer text is counted whole), texts sampled to cut ranges, places of each.
SHARD, SAMPLE, PLACES = 10 << 20, 2_000, 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = np.zeros(256, dtype=bool)
_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _PIECE.copy()
_GAP[[0x20, 0x09]] = True


def _words(texts: list[np.ndarray]) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """Words of the texts, lower-cased; each one's piece (numbered through) and text."""
    end = np.array([10], np.uint8)
    data = np.concatenate([x for t in texts for x in (t, end)])
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[~gap]])])
    piece = np.cumsum(_PIECE[data], dtype=np.int32)[starts]
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    return words, piece, text


def _ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in byte order, and each word's place among them."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


class Trie:
    """Counts of runs of words: ``levels[k]`` has (parent, word, count) of the nodes at depth k, sorted; depth 0 are languages."""

    def __init__(self, texts: list[np.ndarray], langs: list[bytes], depth: int):
        self.langs = sorted(set(langs))
        words, piece, text = _words(texts)
        self.words, x = _ranked(words)
        at = {lang: i for i, lang in enumerate(self.langs)}
        node = np.array([at[lang] for lang in langs], np.int64)[text]
        none = np.zeros(len(self.langs), np.int64)
        self.levels = [(none, np.arange(len(self.langs)), np.bincount(node, minlength=len(self.langs)).astype(np.int64))]
        vocabulary, n = max(1, len(self.words)), len(x)
        for k in range(1, depth + 1):
            here = np.flatnonzero(piece[: n - k + 1] == piece[k - 1 :]) if k <= n else np.zeros(0, np.int64)
            found, which, count = np.unique(node[here] * vocabulary + x[here + k - 1], return_inverse=True, return_counts=True)
            self.levels.append((found // vocabulary, found % vocabulary, count))
            node = np.full(n, -1, np.int64)
            node[here] = which

    def _place(self, word: bytes) -> tuple[int, bool]:
        low, high = 0, len(self.words)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.words[mid].as_py() < word else (low, mid)
        return low, low < len(self.words) and self.words[low].as_py() == word

    def cut(self, path: tuple[bytes, ...]) -> list[int]:
        """How many nodes of each level come before ``path`` in preorder."""
        out, parent, inside = [], 0, True
        for k, (parents, words, _) in enumerate(self.levels):
            low = int(np.searchsorted(parents, parent, "left"))
            if not inside or k >= len(path):
                inside, parent = False, low
            else:
                high = int(np.searchsorted(parents, parent, "right"))
                if k == 0:
                    place = bisect_left(self.langs, path[0])
                    known = place < len(self.langs) and self.langs[place] == path[0]
                else:
                    place, known = self._place(path[k])
                parent = low + int(np.searchsorted(words[low:high], place))
                inside = known and parent < high and int(words[parent]) == place
            out.append(parent + (inside and k < len(path) - 1))
        return out

    def pieces(self, cuts: list[tuple[bytes, ...]]) -> Iterator[tuple[int, bytes]]:
        """(range, serialised part of the trie), for each prefix range that has nodes."""
        paths = []
        for k, (parents, words, _) in enumerate(self.levels):
            paths.append([words] if k == 0 else [*(p[parents] for p in paths[k - 1]), words])
        bounds = [[0] * len(self.levels), *(self.cut(c) for c in cuts), [len(x[0]) for x in self.levels]]
        for r, (low, high) in enumerate(zip(bounds, bounds[1:])):
            if low != high:
                yield r, self._packed(paths, low, high)

    def _packed(self, paths, low, high) -> bytes:
        parts = [[p[a:b] for p in path] for path, a, b in zip(paths, low, high)]
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *(p for path in parts for p in path[1:])]))
        columns = [self.langs, self.words.take(pa.array(used))]
        for path, (_, _, count), a, b in zip(parts, self.levels, low, high):
            columns += [path[0].astype(np.int32), *(np.searchsorted(used, p).astype(np.int32) for p in path[1:]), count[a:b].astype(np.int64)]
        schema = _schema(len(parts) - 1)
        rows = [pa.ListArray.from_arrays([0, len(c)], pa.array(c, t.type.value_type)) for c, t in zip(columns, schema)]
        data = pa.record_batch(rows, schema=schema).serialize().to_pybytes()
        return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _schema(depth: int) -> pa.Schema:
    """langs and words; then a path's columns and the count, for each level."""
    fields = [("langs", pa.binary()), ("words", pa.binary())]
    for k in range(depth + 1):
        fields += [(f"n{k}_{j}", pa.int32()) for j in range(k + 1)] + [(f"count{k}", pa.int64())]
    return pa.schema([(name, pa.list_(kind)) for name, kind in fields])


def _tries(docs: DataFrame, cuts: list, depth: int) -> DataFrame:
    """range, payload: the parts of the tries of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, langs, size = [], [], 0

        def flush():
            ranges, payloads = [], []
            for r, payload in Trie(held, langs, depth).pieces(cuts):
                ranges.append(r)
                payloads.append(payload)
                if sum(map(len, payloads[-64:])) > 4 << 20 or len(payloads) >= 64:
                    yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(payloads, pa.binary())], names=["range", "payload"])
                    ranges, payloads = [], []
            if ranges:
                yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(payloads, pa.binary())], names=["range", "payload"])

        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                if t is not None and len(t):
                    held.append(t.copy())  # a view would hold its batch
                    langs.append(lang.encode())
                    size += len(t)
                    if size >= SHARD:
                        yield from flush()
                        held, langs, size = [], [], 0
                        trim()
        if held:
            yield from flush()

    return docs.mapInArrow(trimmed(run), "range int, payload binary")


def _merged(payloads: list[bytes], depth: int, least: int) -> Iterator[tuple[int, pa.Array, list[pa.Array], np.ndarray]]:
    """(level, languages, words of each place, counts) of the paths of a range that are frequent enough."""
    schema = _schema(depth)
    runs = [pa.ipc.read_record_batch(pa.py_buffer(pa.decompress(p[8:], decompressed_size=int.from_bytes(p[:8], "little"), codec="zstd", asbytes=True)), schema) for p in payloads]
    column = {f: [r.column(f)[0].values for r in runs] for f in schema.names}
    langs, lang_at = _ranked(pa.concat_arrays(column["langs"]))
    words, word_at = _ranked(pa.concat_arrays(column["words"]))
    base = {f: np.cumsum([0, *map(len, column[f])]) for f in ("langs", "words")}
    for k in range(depth + 1):
        count = np.concatenate([c.to_numpy() for c in column[f"count{k}"]])
        if not len(count):
            continue
        path = [np.concatenate([lang_at[c.to_numpy() + base["langs"][i]] for i, c in enumerate(column[f"n{k}_0"])])]
        path += [np.concatenate([word_at[c.to_numpy() + base["words"][i]] for i, c in enumerate(column[f"n{k}_{j}"])]) for j in range(1, k + 1)]
        code = path[0]
        for p in path[1:]:
            if int(code.max()) >= (1 << 62) // len(words):
                code = np.unique(code, return_inverse=True)[1]
            code = code * len(words) + p
        order = np.argsort(code, kind="stable")  # merges the runs
        code = code[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        total = np.add.reduceat(count[order], first)
        kept = np.flatnonzero(total >= (least if k else 0))
        one = order[first[kept]]
        yield k, langs.take(pa.array(path[0][one])), [words.take(pa.array(p[one])) for p in path[1:]], total[kept]


def frequent_paths(docs: DataFrame, least: int, depth: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, depth, path (words), a: all runs of up to ``depth`` words with ``a >= least``; at depth 0 each language's words in all."""
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    ranges = 2 * partitions_for(docs.sparkSession)
    tries = _tries(docs, _cuts(docs, ranges, depth), depth)

    def merge(group: pa.Table) -> pa.Table:
        outs = []
        for k, langs, words, counts in _merged(group.column("payload").to_pylist(), depth, least):
            flat = pa.concat_arrays(words) if words else pa.array([], pa.binary())
            n = len(counts)
            turn = np.arange(n * k).reshape(k, n).T.ravel() if k else np.zeros(0, int)
            path = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), flat.take(pa.array(turn)).cast(pa.string()))
            outs.append(pa.table([langs.cast(pa.string()), pa.array(np.full(n, k), pa.int32()), path, pa.array(counts, pa.int64())], names=["lang", "depth", "path", "a"]))
        trim()
        return pa.concat_tables(outs)

    return tries.groupBy("range").applyInArrow(merge, "lang string, depth int, path array<string>, a long")


def _cuts(docs: DataFrame, ranges: int, depth: int) -> list[tuple[bytes, ...]]:
    """At most ``ranges - 1`` paths that cut a bounded sample of paths in even parts."""
    n = docs.count()
    drawn = docs.filter(F.col("text").isNotNull()) if n <= SAMPLE else docs.filter(F.col("text").isNotNull()).sample(fraction=SAMPLE / n, seed=0)

    def run(batches):
        for b in batches:
            paths = []
            for lang, t in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                if t is None or not len(t):
                    continue
                words, piece, _ = _words([t])
                places = range(0, len(words), max(16, -(-len(words) // PLACES)))
                paths += [[lang, *(words[i + j].as_py().decode() for j in range(min(depth, len(words) - i)) if piece[i + j] == piece[i])] for i in places]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.list_(pa.string()))], names=["path"])

    # at most about SAMPLE * PLACES paths; of overlong words the beginning is enough to cut at
    short = F.transform("path", lambda w: F.substring(w, 1, 64))
    found = sorted(tuple(x.encode() for x in r[0]) for r in drawn.mapInArrow(run, "path array<string>").select(short).toLocalIterator())
    return sorted({found[len(found) * r // ranges] for r in range(1, ranges)}) if found else []


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, covered_percent: int = 50, top: int | None = 2_000, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of 2 to ``most_words`` words, by score (all if ``top`` is None).

    A phrase's score is that of its weakest cut, in millionths; phrases that occur mostly inside a longer candidate are left out.
    """
    found = materialize(frequent_paths(docs, least, most_words, lang, text))
    level = {k: found.filter(F.col("depth") == k).select("lang", "path", "a") for k in range(most_words + 1)}
    none = F.array().cast("array<bigint>")
    above, candidates = level[1].select("*", none.alias("lefts"), none.alias("rights")), []
    for k in range(2, most_words + 1):
        parent = above.select("lang", F.col("path").alias("head"), F.concat("lefts", F.array("a")).alias("lefts"))
        suffix = above.select("lang", F.col("path").alias("tail"), F.concat(F.array("a"), "rights").alias("rights"))
        here = level[k].withColumn("head", F.slice("path", 1, k - 1)).withColumn("tail", F.slice("path", 2, k - 1))
        here = here.join(parent.hint("merge"), ["lang", "head"]).join(suffix.hint("merge"), ["lang", "tail"]).select("lang", "path", "a", "lefts", "rights")
        above = materialize(here) if k < most_words else here
        candidates.append(above)
    every = candidates[0]
    for c in candidates[1:]:
        every = every.unionByName(c)
    every = materialize(every)

    wide = "decimal(15, 0)"
    exact = f"cast(1000000 as decimal(7, 0)) * cast(a as {wide}) * cast(a as {wide}) div (cast(lefts[i] as {wide}) * cast(rights[i] as {wide}))"
    weakest = F.expr(f"array_min(transform(sequence(0, size(lefts) - 1), i -> struct({exact} as score, i as k, lefts[i] as l, rights[i] as r)))")
    scored = every.withColumn("cut", weakest)
    if most_words > 2:
        within = every.filter(F.size("path") > 2).select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, size(path) - 1), n -> transform(sequence(1, size(path) - n + 1), i -> slice(path, i, n))))")).alias("path"))
        longest = within.groupBy("lang", "path").agg(F.max("a").alias("longer"))
        scored = scored.join(longest.hint("merge"), ["lang", "path"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered_percent))
    scored = scored.select("lang", F.array_join("path", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", rank.cast("long"))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.join(level[0].select("lang", F.col("a").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_sql() -> str:
    upper, lower = (("".join(chr(a + i) for i in range(26))) for a in (65, 97))
    return f"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
      FROM documents),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
    grams AS (
      SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
      FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
    n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    cand AS (SELECT lang, k AS m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
    cuts AS (SELECT lang, m, phrase, a, c, array_to_string(list_slice(w, 1, c), ' ') AS lp, array_to_string(list_slice(w, c + 1, m), ' ') AS rp
             FROM cand, (SELECT unnest([1, 2]) AS c) WHERE c < m),
    parts AS (
      SELECT u.lang, u.m, u.phrase, u.a, u.c, x.f AS l, y.f AS r,
             CAST(1000000::HUGEINT * u.a * u.a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = u.lp JOIN f y ON y.lang = u.lang AND y.phrase = u.rp),
    best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
    inner2 AS (
      SELECT lang, p AS phrase, max(a) AS longer FROM (
        SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS p FROM cand WHERE m = 3) GROUP BY lang, p),
    kept AS (
      SELECT b.* FROM best b LEFT JOIN inner2 i ON i.lang = b.lang AND i.phrase = b.phrase AND b.m = 2
      WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
    SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept k JOIN n ON n.lang = k.lang QUALIFY rank <= 2000"""
