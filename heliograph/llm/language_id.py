"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's features are the runs of 1 to 3 letters inside its words (with a mark at word borders), lower-cased and hashed
into BUCKETS rows of an embedding; their mean goes through a linear softmax. As that is linear in the features, a
trained model is one table of logits a bucket, and a text's logits are the mean of its features' rows: whole texts are
scored in chunks, with no cut. A temperature fitted on rows kept out of training calibrates the probabilities.

A text is rejected if its probability is below a threshold, or if its subwords are too surprising for any language
learned: one more column of the table holds each bucket's surprisal among the training texts, so a text's mean surprisal
comes with its logits. It is held against that of kept-out texts of the predicted language, in deviations that allow for
the text's length; both limits are taken from kept-out rows, so that texts of learned languages stay.

The model is fitted on a bounded sample: at most SAMPLE_ROWS labelled rows, shared out evenly among the languages, of
at most SAMPLE_CHARS characters each (longer texts aren't sampled; they are scored like all others).

Rows: a null text or one without letters is `und` with score 0, and is rejected; repeated rows score alike; an empty
table gives an empty result; without labelled rows every text is `und`; columns named lang_pred, score or accepted are
replaced by ``identify``, all others, and all columns in ``accepted``, are kept. Only text is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import fresh, table
from heliograph.llm.wordops import trim

SAMPLE_ROWS, SAMPLE_CHARS = 3_000, 50_000
BITS = 14
BUCKETS, DIM, GRAMS = 1 << BITS, 16, (1, 2, 3)
#: Labels that may be learned, at most: a class a language.
MAX_LABELS = 1_000
CHUNK = 1 << 18
#: A language's texts differ in mean surprisal by so many bits at least; and the fewest deviations that reject a text.
LEAST_SPREAD, LEAST_LIMIT = 0.1, 6.0
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Code point -> lower-case code point of letters, 0 of all else."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def pieces(text: str) -> Iterator[str]:
    """The text in stretches of at most CHUNK characters, cut where no word is cut unless one is longer than that."""
    at = 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in " \n\t")
            end = cut + 1 if cut > at else end
        yield text[at:end]
        at = end


def _grams(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the first letter, bucket) of the subwords of code points ``x``, 0 at borders, both ends included."""
    letter = x != 0
    h = np.full(len(x), 2166136261, np.uint32)
    inner = None  # letters only, after the first one
    for g in range(1, max(GRAMS) + 1):
        end = len(x) - g + 1
        if end <= 0:
            return
        last = letter[g - 1 :]
        h = (h[:end] ^ x[g - 1 :]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        if g == 1:
            ok = letter
        else:
            ok = letter[:end] | last if g == 2 else inner[:end]
        if g in GRAMS:
            at = np.flatnonzero(ok)
            yield at + ~letter[at], (h[at] * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        # of the next length: what lies between its ends are letters
        inner = last.copy() if g == 2 else (inner[:end] & last if g > 2 else None)


def score_sums(texts: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``rows`` over each text's subwords, and their numbers; texts are scored many at a time."""
    total, n = np.zeros((len(texts), rows.shape[1])), np.zeros(len(texts), np.int64)
    owner: list[int] = []
    parts: list[str] = []
    held = 0

    def flush():
        nonlocal owner, parts, held
        if not parts:
            return
        sizes = np.array([len(p) + 1 for p in parts])
        x = _letters()[np.frombuffer(("\n" + "\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        starts = np.concatenate([[1], 1 + np.cumsum(sizes)])
        who = np.array(owner)
        for first, bucket in _grams(x):
            cut = np.searchsorted(first, starts)
            got = np.flatnonzero(np.diff(cut))
            if len(got):
                sums = np.add.reduceat(rows[bucket], cut[got], axis=0)
                np.add.at(total, who[got], sums)
                np.add.at(n, who[got], np.diff(cut)[got])
        owner, parts, held = [], [], 0

    for k, t in enumerate(texts):
        for p in pieces(t or ""):
            if held + len(p) > CHUNK:
                flush()
            owner.append(k)
            parts.append(p)
            held += len(p) + 1
    flush()
    return total, n


def features(text: str | None) -> np.ndarray:
    """Buckets of the text's subwords."""
    out = [b for p in pieces(text or "") for _, b in _grams(_letters()[np.frombuffer(f"\n{p}\n".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)])]
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # (BUCKETS, labels + 1): logits, and the surprisal in bits
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    usual: np.ndarray | None = None  # (labels, 3): mean surprisal, its variance between texts, and that of a subword
    limit: float = np.inf

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, probability, whether it is accepted)."""
        if not self.labels:
            return [(UNKNOWN, 0.0, False)] * len(texts)
        total, n = score_sums([t or "" for t in texts], self.table)
        mean = total / np.maximum(n, 1)[:, None]
        p = _softmax((mean[:, :-1] + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        score = p[np.arange(len(texts)), best]
        fine = (score >= self.threshold) & (self.strangeness(mean[:, -1], n, best) <= self.limit)
        return [(self.labels[k], float(score[r]), bool(fine[r])) if n[r] else (UNKNOWN, 0.0, False) for r, k in enumerate(best)]

    def strangeness(self, surprisal: np.ndarray, n: np.ndarray, label: np.ndarray) -> np.ndarray:
        mean, between, within = self.usual[label].T
        return (surprisal - mean) / np.sqrt(between + within / np.maximum(n, 1))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 2.0, batch: int = 32, seed: int = 11, keep_share: float = 0.999) -> Model:
    """SGD on the averaged embeddings; every fifth text is kept out, for the temperature and the threshold."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    sparse, sizes = [], []  # (buckets, shares, label): 6 bytes a distinct subword; subwords
    for t, g in zip(texts, langs):
        if len(f := features(t)):
            u, c = np.unique(f, return_counts=True)
            sparse.append((u.astype(np.uint16), (c / len(f)).astype(np.float32), labels.index(g)))
            sizes.append(len(f))
    if not sparse:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(0))
    order = rng.permutation(len(sparse))
    held = set(order[::5].tolist()) if len(sparse) >= 20 else set()
    fit = np.array([k for k in order if k not in held])
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    epochs = max(epochs, -(-400 * batch // max(1, len(fit))))  # few texts: 400 steps all the same
    steps, step = max(1, epochs * -(-len(fit) // batch)), 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for s in range(0, len(fit), batch):
            part = [sparse[k] for k in fit[s : s + batch]]
            x = np.zeros((len(part), BUCKETS), np.float32)
            for r, (u, c, _) in enumerate(part):
                x[r, u] = c
            h = x @ emb
            p = _softmax(h @ w + b)
            p[np.arange(len(part)), [y for *_, y in part]] -= 1
            p /= len(part)
            lr = rate * (1 - step / steps)
            step += 1
            back = p @ w.T
            w -= lr * (h.T @ p)
            b -= lr * p.sum(axis=0)
            used = np.unique(np.concatenate([u for u, *_ in part]))
            emb[used] -= lr * 20 * (x[:, used].T @ back)  # rows of rare subwords see small weights
    share = np.full(BUCKETS, 0.5)
    for k in fit:
        share[sparse[k][0]] += sparse[k][1] * sizes[k]
    surprisal = -np.log2(share / share.sum())
    model = Model(labels, np.column_stack([(emb @ w).astype(np.float64), surprisal]), b.astype(np.float64))
    test = [k for k in range(len(sparse)) if k in held] or list(range(len(sparse)))
    z = np.stack([sparse[k][1].astype(np.float64) @ model.table[sparse[k][0], :-1] + model.bias for k in test])
    y = np.array([sparse[k][2] for k in test])
    grid = np.geomspace(0.05, 5, 40)
    # targets short of 1, as of so many texts: a clean separation doesn't make every score 1
    off = 1 / (len(y) + 2)
    target = np.full(z.shape, off / max(1, len(labels) - 1))
    target[np.arange(len(y)), y] = 1 - off
    model.temperature = float(min(grid, key=lambda t: -(target * np.log(np.maximum(_softmax(z / t), 1e-12))).sum(axis=1).mean()))
    p = _softmax(z / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    # texts known to be of their language stay; half of even odds is the most that is ever asked for
    model.threshold = float(min(0.5, np.quantile(right, 1 - keep_share))) * 0.9 if len(right) else 0.0
    # surprisals of kept-out texts, by language
    mean = np.array([sparse[k][1] @ surprisal[sparse[k][0]] for k in test])
    inner = np.array([sparse[k][1] @ (surprisal[sparse[k][0]] - m) ** 2 for k, m in zip(test, mean)])
    n = np.array([sizes[k] for k in test])
    rows = [y == g if (y == g).sum() >= 5 else np.ones(len(y), bool) for g in range(len(labels))]
    model.usual = np.array([[mean[r].mean(), max(LEAST_SPREAD**2, mean[r].var() - (inner[r] / n[r]).mean()), inner[r].mean()] for r in rows])
    strange = model.strangeness(mean, n, p.argmax(axis=1))
    model.limit = max(LEAST_LIMIT, 1.5 * float(np.quantile(strange, keep_share)))
    return model


def sample(docs: DataFrame, usable: Column, text: str, lang: str, id: str) -> tuple[list[str], list[str]]:
    """At most SAMPLE_ROWS labelled texts, shared out among the languages, by the order of a hash of their ids."""
    few = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[lang]: r["count"] for r in few.groupBy(lang).count().limit(MAX_LABELS + 1).collect()}
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} languages are labelled")
    if not counts:
        return [], []
    each = max(1, SAMPLE_ROWS // len(counts))
    spread = 1 << 30
    cut = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 1.2 * each / n + 20 / n) * spread))])
    draw = F.pmod(F.xxhash64(F.col(id), F.lit("sample")), F.lit(spread))
    rows = few.filter((draw < cut[F.col(lang)]) & (F.length(text) <= SAMPLE_CHARS)).select(text, lang, draw.alias("d")).collect()
    out, used, seen = [], dict.fromkeys(counts, 0), set()
    for r in sorted(rows, key=lambda r: (r["d"], r[lang], r[text])):
        if used[r[lang]] < each and r[text] not in seen:
            seen.add(r[text])
            used[r[lang]] += 1
            out.append((r[text], r[lang]))
    return [t for t, _ in out], [g for _, g in out]


def fit(docs: DataFrame, usable: Column | None = None, text: str = "text", lang: str = "lang", id: str = "doc_id") -> Model:
    return train(*sample(docs, usable if usable is not None else F.lit(True), text, lang, id))


def _found(docs: DataFrame, model: Model, text: str):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers: bounded by MAX_LABELS

    @F.arrow_udf("struct<lang_pred:string,score:double,accepted:boolean>")
    def score(texts: pa.Array) -> pa.Array:
        found: list[tuple[str, float, bool]] = []
        for at in range(0, len(texts), 1000):
            found += shared.value.predict(texts.slice(at, 1000).to_pylist())
        trim()
        names, scores, fine = zip(*found) if found else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(fine, pa.bool_())], names=["lang_pred", "score", "accepted"])

    return score(F.col(text))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and accepted (false: the calibrated rejection)."""
    at = fresh(docs, "found")
    return docs.withColumn(at, _found(docs, model, text)).withColumns({c: F.col(f"{at}.{c}") for c in ("lang_pred", "score", "accepted")}).drop(at)


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows that are rejected."""
    at = fresh(docs, "found")
    return docs.withColumn(at, _found(docs, model, text)).filter(F.col(f"{at}.accepted")).drop(at)


def fold(id: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(folds))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = fit(docs, fold("doc_id", 5) != 0)
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")
