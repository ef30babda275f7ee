"""URL filters: host rules, and gradient-boosted trees on lexical features for URLs that no rule fits.

Features: lengths of URL, host, path and query, depth, digits' shares, entropies, numbers of parameters, hyphens and host
labels, the longest label, marks of fragment, page and scheme, and the smoothed block rates of the host's suffixes (its last
label, and its last two) among labelled URLs. They are counted on the URLs' bytes, many URLs at a time.
The trees are learned from labelled URLs that the caller gives, at most SAMPLE_ROWS of them, by the order of a hash. The
query, whose tables label no URLs, learns from ``made_urls``: URLs made by stated rules of what is common in unwanted
ones. None of its hosts is taken from the tables; who has labelled URLs gives these. A model is a few hundred numbers.

Rows: a null URL, or one without `://`, has an empty host and path, fits no rule and is judged by the trees on an
otherwise empty URL; repeated rows are judged alike; URLs may be of any length; an empty table gives an empty result;
columns named host, path, rule, p_block or verdict are replaced, others are kept. Labels that are null, and null URLs,
aren't learned from; without labels of both classes the trees say what the labels' share is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import table

# The rules of the contract, (verdict, host/path prefix).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SAMPLE_ROWS = 20_000
#: Labelled URLs that a suffix must have for a rate of its own.
LEAST_URLS = 20
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def made_urls(n: int = 4_000, seed: int = 19) -> list[tuple[str, int]]:
    """(url, 1: unwanted) in equal parts, by rules: unwanted URLs have two or more of seven marks, others at most one.

    Marks: a host name of words joined by hyphens, digits in it, a long random name, many host labels, many parameters,
    a path with long codes, an ending that is cheap to register.
    """
    rng = np.random.default_rng(seed)
    word = lambda k=2: "".join(rng.choice(list("bcdfghklmnprstvw")) + rng.choice(list("aeiou")) for _ in range(int(rng.integers(2, 2 + k))))
    code = lambda k: "".join(rng.choice(list("0123456789abcdefghijklmnopqrstuvwxyz"), k))
    out = []
    for row in range(n):
        bad = row % 2
        marks = set(rng.choice(7, int(rng.integers(2, 5)) if bad else int(rng.random() < 0.25), replace=False).tolist())
        name = word(3)
        if 0 in marks:
            name = "-".join(word() for _ in range(int(rng.integers(2, 5))))
        if 2 in marks:
            name = code(int(rng.integers(12, 26)))
        if 1 in marks:
            name += str(rng.integers(1, 10_000))
        labels = [name, rng.choice(["info", "top", "xyz", "click"]) if 6 in marks else rng.choice(["com", "org", "net", "edu", "de", "fr", "es"])]
        lead = [code(4) for _ in range(int(rng.integers(2, 4)))] if 3 in marks else [["www"], ["m"], ["blog"], [], []][int(rng.integers(5))]
        steps = [word(3) for _ in range(int(rng.integers(0, 3)))] + ([str(rng.integers(1, 10_000))] if rng.random() < 0.5 else [])
        if 5 in marks:
            steps += [code(int(rng.integers(16, 33))) for _ in range(int(rng.integers(1, 3)))]
        asked = int(rng.integers(4, 9)) if 4 in marks else int(rng.choice([0, 0, 1, 2]))
        query = "&".join(f"{word(1)}={code(int(rng.integers(1, 8)))}" for _ in range(asked))
        end = rng.choice(["", "", "/", ".html", "#top"])
        page = "/" + "/".join(steps) + (end if end != "#top" else "")
        out.append((f"{rng.choice(['http', 'https'])}://{'.'.join([*lead, *labels])}{page}{'?' + query if query else ''}{'#top' if end == '#top' else ''}", bad))
    return out


def host_of(url: Column) -> Column:
    """After the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, prefix = rule.split("/", 1)
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


class _Bytes:
    """The bytes of a column of texts, with counts by row."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data, self.at = body[at[0] : at[-1]], at - at[0]
        self.size = np.diff(self.at)
        self.row = np.repeat(np.arange(len(column)), self.size)

    def count(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.row[mask], minlength=len(self.size))

    def of(self, char: str) -> np.ndarray:
        return self.data == ord(char)

    def digits(self) -> np.ndarray:
        return (self.data >= 48) & (self.data <= 57)

    def entropy(self) -> np.ndarray:
        key, n = np.unique(self.row * 256 + self.data, return_counts=True)
        p = n / self.size[key >> 8]
        return -np.bincount(key >> 8, p * np.log2(p), len(self.size))

    def longest(self, gap: np.ndarray) -> np.ndarray:
        """The longest stretch without a gap, by row."""
        out = np.zeros(len(self.size), np.int64)
        cuts = np.concatenate([[-1], np.flatnonzero(gap), [len(self.data)]])
        cuts = np.union1d(cuts, self.at[1:-1] - 0.5)  # rows end between bytes
        length = np.ceil(cuts[1:]) - np.floor(cuts[:-1]) - 1
        row = np.minimum(np.searchsorted(self.at, np.floor(cuts[:-1]) + 1, side="right") - 1, len(out) - 1)
        if len(out):
            np.maximum.at(out, row, length.astype(np.int64))
        return out


FEATURES = ("url", "host", "path", "query", "depth", "digits", "host digits", "host entropy", "path entropy", "parameters", "hyphens", "labels", "longest label", "fragment", "page", "secure", "last label", "last two labels")


def suffixes(host: pa.Array) -> list[np.ndarray]:
    """The last label, and the last two, of each host."""
    host = pc.fill_null(host, "")
    return [pc.struct_field(pc.extract_regex(host, pattern), 0).to_numpy(zero_copy_only=False) for pattern in (r"(?P<s>[^.]*)$", r"(?P<s>[^.]*(?:\.[^.]*)?)$")]


def lexical(url: pa.Array, host: pa.Array, path: pa.Array) -> np.ndarray:
    """(URLs, features but the suffixes' rates)."""
    query = pc.struct_field(pc.extract_regex(pc.fill_null(url, ""), r"(?s)^[^?#]*(?P<q>(?:\?[^#]*)?)"), 0)
    u, h, p, q = (_Bytes(c) for c in (url, host, path, query))
    asked = np.where(q.size > 1, q.count(q.of("&")) + 1, 0)
    secure, page = pc.starts_with(pc.fill_null(url, ""), "https"), pc.ends_with(pc.fill_null(path, ""), ".html")
    columns = [
        u.size, h.size, p.size, q.size, p.count(p.of("/")), u.count(u.digits()) / np.maximum(1, u.size), h.count(h.digits()) / np.maximum(1, h.size), h.entropy(), p.entropy(), asked, h.count(h.of("-")), h.count(h.of(".")),
        h.longest(h.of(".")), u.count(u.of("#")) > 0, page.to_numpy(zero_copy_only=False), secure.to_numpy(zero_copy_only=False),
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


@dataclass
class Model:
    prior: float
    rates: dict[str, float]
    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature, cut, leaf values of complete trees

    def matrix(self, url: pa.Array, host: pa.Array, path: pa.Array) -> np.ndarray:
        share = 1 / (1 + math.exp(-self.prior))
        ends = []
        for column in suffixes(host):
            names, which = np.unique(column.astype(str), return_inverse=True)
            ends.append(np.array([self.rates.get(n, share) for n in names.tolist()] or [share])[which] if len(column) else np.zeros(0))
        return np.column_stack([lexical(url, host, path), *ends])

    def block(self, url: pa.Array, host: pa.Array, path: pa.Array) -> np.ndarray:
        x = self.matrix(url, host, path)
        y = np.full(len(x), self.prior)
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            y += leaf[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-y))


def train(url: pa.Array, host: pa.Array, path: pa.Array, y: np.ndarray) -> Model:
    """Newton boosting of complete trees on binned features."""
    if not len(y):
        return Model(0.0, {}, [], [])
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    rates, strength = {}, float(LEAST_URLS)
    for column in suffixes(host):
        names, which = np.unique(column.astype(str), return_inverse=True)
        n, bad = np.bincount(which), np.bincount(which, y)
        known = n >= LEAST_URLS  # a suffix of few URLs would only repeat their labels
        rates |= dict(zip(names[known].tolist(), ((bad + strength * share) / (n + strength))[known].tolist()))
    model = Model(math.log(share / (1 - share)), rates, [], [])
    if y.min() == y.max():
        return model
    x = model.matrix(url, host, path)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    z = np.full(len(y), model.prior)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, np.inf)
        at = np.zeros(len(y), int)
        for node in range(2**DEPTH - 1):
            rows = np.flatnonzero(at == node)
            best = (1e-9, 0, np.inf)
            if len(rows) > 1:
                sg, sh = g[rows].sum(), h[rows].sum()
                for k, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, k], g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, k], h[rows], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (sg - gl) ** 2 / (sh - hl + 1) - sg**2 / (sh + 1)
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (float(gain[j]), k, float(e[j]))
            feature[node], cut[node] = best[1], best[2]
            at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
        leaf = np.zeros(2**DEPTH)
        for k in range(2**DEPTH):
            rows = at == k + 2**DEPTH - 1
            leaf[k] = -RATE * g[rows].sum() / (h[rows].sum() + 1)
        z += leaf[at - (2**DEPTH - 1)]
        model.trees.append((feature, cut, leaf))
    return model


def with_rules(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path and rule added."""
    address = F.col(url)
    parted = pages.withColumns({"host": F.coalesce(host_of(address), F.lit("")), "path": F.coalesce(path_of(address), F.lit(""))})
    return parted.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))


def fit(labelled: DataFrame, url: str = "url", label: str = "blocked") -> Model:
    """Learn from labelled URLs (1: unwanted, 0: wanted), of which SAMPLE_ROWS count."""
    rows = labelled.filter(F.col(url).isNotNull() & F.col(label).isin(0, 1)).select(F.col(url).alias("url"), F.col(label).cast("int").alias("blocked"))
    drawn = with_rules(rows).select("url", "host", "path", "blocked", F.xxhash64("url", F.lit("sample")).alias("d")).orderBy("d", "url", "blocked").limit(SAMPLE_ROWS).collect()
    return train(*(pa.array([r[c] for r in drawn], pa.string()) for c in ("url", "host", "path")), np.array([r["blocked"] for r in drawn], float))


def judge(pages: DataFrame, model: Model, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, p_block and verdict added."""
    ruled = with_rules(pages, url, rules)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # TREES trees, and a rate a suffix of at most SAMPLE_ROWS URLs

    @F.arrow_udf("double")
    def p_block(u: pa.Array, h: pa.Array, p: pa.Array) -> pa.Array:
        return pa.array(shared.value.block(u, h, p), pa.float64())

    scored = ruled.withColumn("p_block", p_block(F.col(url), F.col("host"), F.col("path")))
    by_rule = F.lit(None).cast("string")
    for v, r in rules:
        by_rule = F.when(F.col("rule") == r, F.lit(v)).otherwise(by_rule)
    return scored.withColumn("verdict", F.coalesce(by_rule, F.when(F.col("p_block") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))))


def op6(spark, sf_dir: str) -> DataFrame:
    model = fit(spark.createDataFrame(made_urls(), "url string, blocked int"))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict", "p_block")
