"""Toxicity: a factorization machine over hashed terms.

Terms are a text's words (runs of letters and digits, A-Z lower-cased) and their beginnings of some lengths, by their
64-bit hash, so that rare words don't share a weight with common ones. The machine adds all pairwise interactions of the
terms that a text has, so that an insult with a group's mention can count for more than both do apart. It is fitted by
full-batch Adam in numpy.

A term gets a weight and latent factors if it tells the classes apart alone, or together with another term: the TABLE
terms in most of the sample's texts are crossed with each other, and both terms of a pair enter whose texts are toxic
more or less often than the two terms' own rates explain. So a term that says nothing alone is learned all the same.

The model is fitted on a bounded sample: at most SAMPLE_ROWS labelled rows, by the order of a hash of their ids, of at
most SAMPLE_CHARS characters each; near copies within it count once. Whole texts are scored, however long.

Rows: null and wordless texts get the score of a text without terms; labels that are null, or rows without one, aren't
learned from, and of an id's labels the highest counts; repeated rows score alike; an empty table gives an empty result; without labels of both classes the score
is the smoothed share of toxic labels; columns named score or predicted are replaced, others are kept. Only text is an
input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import materialize, table
from heliograph.llm.wordops import ALNUM, prefix_hashes, shingles, texts_of, words

SAMPLE_ROWS, SAMPLE_CHARS = 8_000, 100_000
#: Terms that enter alone, and those that enter in pairs; factors of a term; what a term or pair must reach.
TERMS, PAIRED, FACTORS, LEAST_Z, LEAST_DOCS = 512, 128, 4, 5.0, 3
#: Terms that are crossed with each other, how far a pair must be from what its terms explain, and in how many texts.
TABLE, PAIR_Z, PAIR_DOCS = 1536, 7.0, 20
#: Bytes of words' beginnings that count as terms too, for words built on a common stem.
PREFIXES = (5, 6, 7, 8)


@dataclass
class Model:
    terms: np.ndarray  # sorted hashes
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, term_hashes: np.ndarray) -> float:
        y = self.w0
        if len(self.terms) and len(term_hashes):
            at = np.searchsorted(self.terms, term_hashes)
            at[at == len(self.terms)] = 0
            at = np.unique(at[self.terms[at] == term_hashes])
            v = self.v[at]
            y += self.w[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(y, -40, 40))))


def terms_of(data: np.ndarray | None) -> np.ndarray:
    """Hashes of the text's words, and of their beginnings."""
    return np.concatenate([words(data, ALNUM), prefix_hashes(data, PREFIXES, ALNUM)])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        terms, marks = [], []
        for data in texts_of(b.column("text")):
            terms.append(np.unique(terms_of(data)).tobytes())
            marks.append(shingles(words(data, ALNUM), 3)[:4].tobytes())
        yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("d"), pa.array(terms, pa.binary()), pa.array(marks, pa.binary())], names=["toxic", "d", "terms", "marks"])


def _counts(keep: frozenset):
    """mapInArrow over sampled rows: partial (term, pos, neg), of rows in ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(t, np.frombuffer(x.as_buffer(), np.uint64)) for d, t, x in zip(b.column("d").to_pylist(), b.column("toxic").to_pylist(), b.column("terms")) if d in keep]
            for at in range(0, len(rows), 500):
                part = rows[at : at + 500]
                terms, where = np.unique(np.concatenate([x for _, x in part]), return_inverse=True)
                label = np.repeat(np.array([t for t, _ in part], float), [len(x) for _, x in part])
                pos = np.bincount(where, label, len(terms)).astype(np.int64)
                neg = np.bincount(where, 1 - label, len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(pos), pa.array(neg)], names=["term", "pos", "neg"])

    return run


def _chosen(terms: np.ndarray, keep: frozenset):
    """mapInArrow over sampled rows: the places of ``terms`` in each row of ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(d, t, np.flatnonzero(np.isin(terms, np.frombuffer(x.as_buffer(), np.uint64))).tolist()) for d, t, x in zip(b.column("d").to_pylist(), b.column("toxic").to_pylist(), b.column("terms")) if d in keep]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, *_ in out], pa.int64()), pa.array([t for _, t, _ in out], pa.int32()), pa.array([i for *_, i in out], pa.list_(pa.int32()))], names=["d", "toxic", "at"])

    return run


def paired(rows: list[list[int]], y: np.ndarray, width: int) -> np.ndarray:
    """Places of terms that tell the classes apart only together: the best PAIRED of those in a pair beyond PAIR_Z.

    ``rows`` name the places, below ``width``, of each text's terms. A pair's toxic texts are held against what the rates
    of its two terms make likely if they don't interact (odds ratios multiply).
    """
    if not width:
        return np.zeros(0, int)
    x = np.zeros((len(rows), width), np.float32)
    for k, at in enumerate(rows):
        x[k, at] = 1
    bad = x[y > 0]
    n, pos = x.sum(axis=0), bad.sum(axis=0)
    share = y.mean()
    odds = np.log((pos + share) / (n - pos + 1 - share)) - np.log(share / (1 - share))
    best = np.full(width, 0.0)
    for lo in range(0, width, 256):
        part = slice(lo, lo + 256)
        both = x[:, part].T @ x
        p = 1 / (1 + np.exp(-np.clip(odds[part, None] + odds[None, :] + np.log(share / (1 - share)), -20, 20)))
        z = np.abs(bad[:, part].T @ bad - both * p) / np.sqrt(np.maximum(both * p * (1 - p), 1.0))
        # of terms that nearly always stand together a pair says no more than one of them
        z[(both < PAIR_DOCS) | (both >= 0.8 * np.minimum(n[part, None], n[None, :]))] = 0
        best[part] = np.maximum(best[part], z.max(axis=1))
    order = np.argsort(-best, kind="stable")[:PAIRED]
    return np.sort(order[best[order] >= PAIR_Z])


def train(rows: list[list[int]], y: np.ndarray, terms: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 2e-4, seed: int = 5) -> Model:
    """Fit the machine on rows that name the places of ``terms`` they have."""
    x = np.zeros((len(rows), len(terms)), np.float32)
    for k, at in enumerate(rows):
        x[k, at] = 1
    rng = np.random.default_rng(seed)
    base = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    theta = [np.array([base]), np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS))]
    m, s = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        w0, w, v = theta
        xv = x @ v
        out = w0[0] + x @ w + 0.5 * ((xv**2).sum(axis=1) - x @ (v**2).sum(axis=1))
        g = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y) / len(y)
        grads = [np.array([g.sum()]), x.T @ g + decay * w / 10, x.T @ (g[:, None] * xv) - v * (x.T @ g)[:, None] + decay * v]
        for k, d in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * d
            s[k] = 0.999 * s[k] + 0.001 * d * d
            theta[k] = theta[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Model(terms, float(theta[0][0]), theta[1], theta[2])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Terms are counted where the sampled rows are; the best of them, and their places in each row, come to the driver."""
    rows = labels.filter(usable & F.col(label).isin(0, 1)).select(F.col(id).alias("id"), F.col(label).cast("int").alias("toxic"), F.xxhash64(F.col(id), F.lit("sample")).alias("d"))
    few = rows.groupBy("id", "d").agg(F.max("toxic").alias("toxic")).orderBy("d", "id").limit(SAMPLE_ROWS)
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).filter(F.length("text") <= SAMPLE_CHARS)
    # SAMPLE_ROWS rows; of rows that share an id, the first text counts
    drawn = texts.join(F.broadcast(few), "id").groupBy("id").agg(F.min(F.struct("toxic", "d", "text")).alias("r")).select("r.*")
    sampled = materialize(drawn.select("toxic", "d", "text").mapInArrow(_sampled, "toxic int, d long, terms binary, marks binary"))
    seen, keep, y = set(), set(), []
    for r in sorted(sampled.select("d", "toxic", "marks").collect(), key=lambda r: (r["d"], bytes(r["marks"]))):
        marks = set(np.frombuffer(bytes(r["marks"]), np.uint64).tolist())
        if len(marks & seen) < 2 and r["d"] not in keep:  # else a near copy of a row before it
            seen |= marks
            keep.add(r["d"])
            y.append(r["toxic"])
    n1, n0 = sum(y), len(y) - sum(y)
    base = float(np.log((n1 + 1) / (n0 + 1)))
    none = Model(np.zeros(0, np.uint64), base, np.zeros(0), np.zeros((0, FACTORS)))
    if not n1 or not n0:
        return none
    counts = sampled.mapInArrow(_counts(frozenset(keep)), "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = (F.col("pos") + F.col("neg")) / (n1 + n0)
    z = F.abs(F.col("pos") / n1 - F.col("neg") / n0) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    n = F.col("pos") + F.col("neg")
    counts = counts.filter(n >= LEAST_DOCS).withColumn("z", z).persist()  # at most one row a term of the sample
    alone = counts.filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(TERMS).collect()
    common = counts.filter(n >= PAIR_DOCS).orderBy(n.desc(), "term").limit(TABLE).collect()
    counts.unpersist()

    def rows_of(terms: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
        got = sorted(sampled.mapInArrow(_chosen(terms, frozenset(keep)), "d long, toxic int, at array<int>").collect(), key=lambda r: r["d"])
        return [r["at"] for r in got], np.array([r["toxic"] for r in got], float)

    ordered = lambda found: np.sort(np.array([r["term"] for r in found], np.int64).view(np.uint64))
    table_ = ordered(common)
    terms = np.union1d(ordered(alone), table_[paired(*rows_of(table_), len(table_))])
    if not len(terms):
        return none
    return train(*rows_of(terms), terms)


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score and predicted added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TERMS weights

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(terms_of(d)) for d in texts_of(column)], pa.float64())

    return docs.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fold(id: str) -> Column:
    return F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(3))


def op5(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, fold("doc_id") != 1)
    held_out = F.coalesce(fold("doc_id") == 1, F.lit(False))
    return scored(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")
