"""Language-model scores by deleted interpolation.

A token's probability is a mixture of maximum-likelihood estimates from runs of one to ``order`` tokens and the uniform
1 / (V + 1). The mixture weights depend on how often the token's context was seen (in powers of two), and are learned by
expectation-maximisation on held-out counts: of the texts learned from, a share is set apart, and the estimates at its tokens
are made from counts from which its own are deleted. Texts are scored with the counts of all texts learned from.

How it runs: texts are tokenised once, into shards of about SHARD bytes, kept as tables of token numbers. Each shard asks for
the counts of its distinct runs, which are 64-bit hashes sorted and packed by range of hashes; a range's task adds up what all
shards counted there and answers each of them, in its order. Answers meet their shard again, where they are read off token by
token. So counts of the whole corpus are never in one place, a common run is one entry a shard, and ranges are even whatever
the texts are. The share set apart lies in shards of its own, whose events (context, estimates) are a table for the
expectation steps; a step is one aggregation over it, and its result a row a context bucket.

Rows: a null text is empty, and has one token, the end; texts and words may be of any length; repeated rows count and are
scored again; a null id isn't learned from, and counts as held out; without texts to learn from all counts are 0; further
columns, of any names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from heliograph.llm.common import materialize, partitions_for, table
from heliograph.llm.wordops import hash_bytes, mix, texts_of, trim, trimmed

#: Bytes of text a shard; one in so many texts learned from is set apart; expectation steps at most, and the gain in bits a token that ends them.
SHARD, APART, STEPS, GAIN = 8 << 20, 10, 30, 1e-5
#: Context buckets: unseen, then one a power of two.
BUCKETS = 65
_END, _BEGIN, _TURN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0xD6E8FEB86659FD93)


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays by byte planes, compressed: high bytes of small numbers cost nothing."""
    raw = pickle.dumps([(x.dtype.str, x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes() if x.dtype.kind in "iu" else x) for x in map(np.ascontiguousarray, arrays)], protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel() if isinstance(x, bytes) else x for kind, x in pickle.loads(raw)]


def _shard(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text; each token's number; the hashes that numbers stand for, the most common first."""
    space = np.array([0x20], np.uint8)
    found, starts, _ = hash_bytes(np.concatenate([x for t in texts for x in (t, space)]))
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    sizes = np.bincount(text, minlength=len(texts)) + 1
    tokens = np.full(len(found) + len(texts), _END, np.uint64)
    tokens[np.arange(len(found)) + text] = found
    known, number, count = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return sizes, rank[number], known[order]


def _shards(docs: DataFrame) -> DataFrame:
    """shard, apart, texts (learned from), payload: sizes, learned, tokens, hashes and ids of some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def cut(apart: bool) -> pa.RecordBatch:
            rows, held[apart], size[apart] = held[apart], [], 0
            sizes, tokens, hashes = _shard([t for *_, t in rows])
            learned = np.array([x for _, x, _ in rows], np.uint8)
            payload = pickle.dumps([i for i, _, _ in rows], protocol=5)
            payload = _pack([sizes.astype(np.int64), learned, tokens, hashes, np.frombuffer(payload, np.uint8)])
            names = ["shard", "apart", "texts", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([apart]), pa.array([int(learned.sum())], pa.int64()), pa.array([payload], pa.binary())], names=names)

        empty = np.zeros(0, np.uint8)
        for b in batches:
            for i, learn, apart, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts_of(b.column(3))):
                held[apart].append((i, learn, empty if t is None else t.copy()))  # a view would hold its batch
                size[apart] += 1 + (0 if t is None else len(t))
                if size[apart] >= SHARD:
                    yield cut(apart)
                    trim()
        for apart in held:
            if held[apart]:
                yield cut(apart)

    return docs.mapInArrow(trimmed(run), "shard string, apart boolean, texts long, payload binary")


class _Runs:
    """The runs of tokens of a shard: ``known[k]`` are the distinct hashes of runs of k + 1, ``which[k]`` each token's place there."""

    def __init__(self, payload: bytes, order: int):
        self.sizes, self.learned, tokens, hashes, ids = _unpack(payload)
        self.ids = pickle.loads(ids.tobytes())
        self.first = np.zeros(len(tokens), bool)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first[self.starts] = True
        one = hashes[tokens]
        run, self.known, self.which = one, [], []
        for k in range(order):
            if k:
                before = np.concatenate([[_BEGIN], run[:-1]])
                before[self.first] = _BEGIN
                run = mix(before * _TURN + one)
            known, which = np.unique(run, return_inverse=True)
            self.known.append(known)
            self.which.append(which)

    def estimates(self, counts: list[np.ndarray], total: int, texts: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Each token's own count; the estimates from runs of 1, 2, ...; the count of the longest context."""
        seen = [c[w] for c, w in zip(counts, self.which)]
        context = np.full(len(self.first), total, np.int64)
        out = []
        for k, c in enumerate(seen):
            if k:
                context = np.concatenate([[0], seen[k - 1][:-1]])
                context[self.first] = texts
            out.append(np.divide(c, context, out=np.zeros(len(c)), where=context > 0))
        return seen[0], out, context


def _range_of(ranges: int) -> np.ndarray:
    """The first hash of each range but the first."""
    return np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)


def _questions(shards: DataFrame, order: int, ranges: int) -> DataFrame:
    """range, shard, apart, payload: distinct runs of a shard in that range of hashes, with its own counts from texts learned from."""
    bounds = _range_of(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, apart, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x = _Runs(payload.as_py(), order)
                weight = np.repeat(x.learned, x.sizes)
                counts = [np.bincount(w, weights=weight, minlength=len(k)).astype(np.uint32) for k, w in zip(x.known, x.which)]
                cuts = [np.concatenate([[0], np.searchsorted(k, bounds), [len(k)]]) for k in x.known]
                del x.which
                rows = []
                for r in range(ranges):
                    parts = []
                    for k, c, at in zip(x.known, counts, cuts):
                        here = k[at[r] : at[r + 1]]
                        parts += [np.diff(here, prepend=np.uint64(0)), c[at[r] : at[r + 1]]]
                    if any(map(len, parts)):
                        rows.append((r, shard, apart, _pack(parts)))
                for n in range(0, len(rows), 32):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[n : n + 32]), (pa.int32(), pa.string(), pa.bool_(), pa.binary()))], names=["range", "shard", "apart", "payload"])
                trim()

    return shards.select("shard", "apart", "payload").mapInArrow(trimmed(run), "range int, shard string, apart boolean, payload binary")


def _answers(questions: DataFrame, order: int) -> DataFrame:
    """shard, range, payload: the counts asked for (and those of texts set apart); without shard, a range's totals."""

    def answer(group: pa.Table) -> pa.Table:
        r, shards, apart = group.column("range")[0].as_py(), group.column("shard").to_pylist(), np.array(group.column("apart").to_pylist(), bool)
        asked = [_unpack(p.as_py()) for p in group.column("payload")]
        out: list[list[np.ndarray]] = [[] for _ in shards]
        total = types = aside = 0
        for k in range(order):
            runs = [np.cumsum(a[2 * k], dtype=np.uint64) for a in asked]
            at = np.cumsum([0, *map(len, runs)])
            known, which = np.unique(np.concatenate(runs), return_inverse=True)
            counts = np.concatenate([a[2 * k + 1] for a in asked])
            every = np.bincount(which, weights=counts, minlength=len(known)).astype(np.int64)
            own = np.bincount(which, weights=counts * np.repeat(apart, np.diff(at)), minlength=len(known)).astype(np.int64)
            if k == 0:
                total, types, aside = int(every.sum()), int((every > 0).sum()), int(own.sum())
            for i in range(len(shards)):
                here = which[at[i] : at[i + 1]]
                out[i] += [_small(every[here])] + ([_small(own[here])] if apart[i] else [])
        trim()
        n = len(shards)
        return pa.table(
            [pa.array([*shards, None], pa.string()), pa.array([r] * (n + 1), pa.int32()), pa.array([*map(_pack, out), None], pa.binary())] + [pa.array([None] * n + [x], pa.int64()) for x in (total, types, aside)],
            names=["shard", "range", "payload", "total", "types", "aside"],
        )

    return questions.groupBy("range").applyInArrow(answer, "shard string, range int, payload binary, total long, types long, aside long")


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _met(shards: DataFrame, answers: DataFrame, apart: bool | None, run, schema: str) -> DataFrame:
    """``run`` over each shard (or those of one kind) and its answers."""
    own = shards if apart is None else shards.filter(F.col("apart") == apart)
    answers = answers.filter("shard is not null")
    if apart is not None:
        answers = answers.join(own.select("shard").hint("merge"), "shard")
    both = own.select("shard", F.lit(-1).alias("range"), "payload", "apart").unionByName(answers.select("shard", "range", "payload"), allowMissingColumns=True)
    return both.groupBy("shard").applyInArrow(run, schema)


def _read(group: pa.Table, order: int) -> tuple[_Runs, list[np.ndarray], list[np.ndarray]]:
    """A shard's runs, their counts, and for shards set apart those of texts set apart."""
    ranges = np.array(group.column("range").to_pylist())
    at = np.argsort(ranges)
    payload, x = group.column("payload"), _Runs(group.column("payload")[int(at[0])].as_py(), order)
    apart = group.column("apart")[int(at[0])].as_py()
    found = [_unpack(payload[int(i)].as_py()) for i in at[1:]]
    step = 2 if apart else 1
    every, own = ([np.concatenate([f[step * k + j] for f in found]).astype(np.int64) for k in range(order)] if j < step else [] for j in (0, 1))
    if any(len(c) != len(k) for c, k in zip(every, x.known)):
        raise RuntimeError("a shard's answers are incomplete")
    return x, every, own


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.frexp(context.astype(np.float64))[1].astype(np.int32)  # 0 for 0, else 1 + the power of two


def _events(shards, answers, order: int, total: int, aside: int, texts: int, texts_apart: int) -> DataFrame:
    """bucket, p1, ..., n: what the tokens set apart met, by counts without them."""

    def run(group: pa.Table) -> pa.Table:
        x, every, own = _read(group, order)
        _, p, context = x.estimates([a - b for a, b in zip(every, own)], total - aside, texts - texts_apart)
        rows, n = np.unique(np.column_stack([_bucket(context), *p]), axis=0, return_counts=True)
        trim()
        return pa.table([pa.array(rows[:, 0].astype(np.int32)), *(pa.array(rows[:, k + 1]) for k in range(order)), pa.array(n.astype(np.int64))], names=["bucket", *(f"p{k + 1}" for k in range(order)), "n"])

    return _met(shards, answers, True, run, f"bucket int, {', '.join(f'p{k + 1} double' for k in range(order))}, n long")


def learn_weights(events: DataFrame, order: int, uniform: float, steps: int = STEPS, gain: float = GAIN) -> np.ndarray:
    """A row a context bucket: the weights of the uniform distribution and of the estimates from runs of 1, 2, ... tokens."""
    weights = np.full((BUCKETS, order + 1), 1 / (order + 1))
    p = [F.lit(uniform), *(F.col(f"p{k + 1}") for k in range(order))]
    before = None
    for _ in range(steps):
        parts = [F.get(F.lit([float(w) for w in weights[:, j]]), F.col("bucket")) * p[j] for j in range(order + 1)]
        both = events.select("bucket", "n", *(x.alias(f"x{j}") for j, x in enumerate(parts))).withColumn("all", sum((F.col(f"x{j}") for j in range(1, order + 1)), F.col("x0")))
        found = both.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.log2("all") * F.col("n")).alias("bits"), *(F.sum(F.col("n") * F.col(f"x{j}") / F.col("all")).alias(f"g{j}") for j in range(order + 1)))
        found = sorted(found.collect())  # a row a bucket
        if not found:
            break
        for b, n, _, *g in found:
            weights[b] = (np.array(g) + 1) / (n + order + 1)
        seen = [b for b, *_ in found]
        for b in set(range(BUCKETS)) - set(seen):  # contexts more or less common than any set apart
            weights[b] = weights[min(seen, key=lambda s: abs(s - b))]
        bits = sum(x[2] for x in found) / sum(x[1] for x in found)
        if before is not None and bits - before < gain:
            break
        before = bits
    return weights


def scores(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of each text; rows for which ``learn`` is true are learned from.

    ``base_score`` is that of single tokens' counts with one added, ``score`` the model's; both are sums of decimal logarithms.
    """
    kind, arrow = dict(docs.dtypes)[id], to_arrow_type(docs.schema[id].dataType)
    learn = F.coalesce(learn, F.lit(False))
    rows = docs.select(F.col(id).alias("id"), learn.alias("learn"), (learn & (F.pmod(F.xxhash64(F.col(id)), F.lit(APART)) == 0)).alias("apart"), F.col(text).cast("string").alias("text"))
    shards = materialize(_shards(rows))
    answers = materialize(_answers(_questions(shards, order, 2 * partitions_for(docs.sparkSession)), order))
    total, types, aside = (x or 0 for x in answers.agg(F.sum("total"), F.sum("types"), F.sum("aside")).first())
    texts, texts_apart = (x or 0 for x in shards.agg(F.sum("texts"), F.sum(F.when(F.col("apart"), F.col("texts")))).first())
    uniform = 1 / (types + 1)
    events = materialize(_events(shards, answers, order, total, aside, texts, texts_apart))
    weights = learn_weights(events, order, uniform)

    def run(group: pa.Table) -> pa.Table:
        x, every, _ = _read(group, order)
        own, p, context = x.estimates(every, total, texts)
        w = weights[_bucket(context)]
        mixed = w[:, 0] * uniform
        for k in range(order):
            mixed += w[:, k + 1] * p[k]
        sums = [np.add.reduceat(v, x.starts) for v in ((own > 0).astype(np.int64), np.log10((own + 1) / (total + types + 1)), np.log10(mixed))]
        trim()
        return pa.table([pa.array(x.ids, arrow), pa.array(x.sizes), *map(pa.array, sums)], names=["id", "n_tokens", "n_known", "base_score", "score"])

    found = _met(shards, answers, None, run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return found.select(F.col("id").alias(id), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))
    found = scores(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
