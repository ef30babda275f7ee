"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Segments of every whole text (its lines; of lines of over LONG words, overlapping windows) are compared with license
templates by the cosine of TF-IDF vectors; document frequencies count all files. So are windows of the whole text, across
its lines, that are as long as a template and overlap by seven eighths, with the short notices and with licence texts and
file headers; only those windows that can reach the threshold are. The best segment at THRESHOLD or above gives a file
its license. A file without one inherits from the nearest directory at or above its own that has a
licence file (LICENSE, COPYING or NOTICE, with any ending) with a license.

Rows: a null text has no license of its own; a null path has no directory and inherits nothing; repeated rows are
scanned each for itself; an empty table gives an empty result. Ties go to the template that is listed first, and among
licence files of a directory to the highest score, then the smallest path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import hot_keys, materialize, salted_join, table
from heliograph.llm.license_texts import TEXTS
from heliograph.llm.wordops import ALNUM, hash_bytes, texts_of, words

# Short notices by which files state their license.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is free software under the terms of the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("ISC", "Permission to use, copy, modify, and distribute this software is granted under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
THRESHOLD = 0.7
#: What windows are compared with; lines are with TEMPLATES, which come first.
ALL = TEMPLATES + TEXTS
#: Words whose windows are held at a time.
STRETCH = 100_000
#: Lines of more words are cut in windows of LONG words that overlap by half.
LONG = 32
LICENCE_FILE = r"(?i)(^|/)(LICEN[CS]E|COPYING|NOTICE)[^/]*$"


def _template_terms(templates: tuple = ALL) -> tuple[np.ndarray, list[np.ndarray]]:
    each = [words(np.frombuffer(t.encode(), np.uint8), ALNUM) for _, t in templates]
    return np.unique(np.concatenate(each)), each


def document_frequencies(files: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """(files, files that have each template term), over all files: a few hundred sums of partial counts."""
    vocabulary, _ = _template_terms()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts = 0, np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for data in texts_of(b.column(0)):
                n += 1
                counts += np.isin(vocabulary, words(data, ALNUM))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(counts)), pa.int32()), pa.array([n, *counts.tolist()], pa.int64())], names=["k", "n"])

    got = {r["k"]: r["n"] for r in files.select(text).mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    return got.get(-1, 0), np.array([got.get(k, 0) for k in range(len(vocabulary))])


def _rows(vocabulary: np.ndarray, each: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    rows = np.stack([np.bincount(np.searchsorted(vocabulary, w), minlength=len(vocabulary)) for w in each]) * idf
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Matcher:
    def __init__(self, n: int, df: np.ndarray, threshold: float = THRESHOLD):
        self.rare, self.threshold = math.log(n + 1) + 1, threshold
        self.all_words, each = _template_terms()
        self.all_idf = np.log((n + 1) / (df + 1)) + 1
        self.all_rows = _rows(self.all_words, each, self.all_idf)
        self.squares = np.ascontiguousarray((self.all_rows**2).T)
        self.lengths = [len(x) for x in each]
        self.vocabulary, each = _template_terms(TEMPLATES)
        self.idf = self.all_idf[np.searchsorted(self.all_words, self.vocabulary)]
        self.rows = _rows(self.vocabulary, each, self.idf)

    def best(self, data: np.ndarray | None) -> tuple[int, float]:
        """(template, cosine) of the best segment; (-1, 0) if none has two template terms."""
        if data is None or not len(data):
            return -1, 0.0
        w, starts, _ = hash_bytes(data, ALNUM)
        if not len(w):
            return -1, 0.0
        line, window = self._lines(data, w, starts), self._windows(w)
        return window if window[1] > line[1] + 1e-12 else line

    def _windows(self, w: np.ndarray) -> tuple[int, float]:
        """(template, cosine) of the best window of the whole text; windows below the threshold may be left out."""
        at = np.searchsorted(self.all_words, w)
        at[at == len(self.all_words)] = 0
        known = self.all_words[at] == w
        # a cosine is at most the length of the part of a template's vector that is there
        there = np.zeros(len(self.all_words), bool)
        there[at[known]] = True
        best = (-1, 0.0)
        for t in np.flatnonzero(self.squares[there].sum(axis=0) >= self.threshold**2 - 1e-9).tolist():
            for lo in range(0, len(w), STRETCH):
                part = slice(lo, lo + STRETCH + self.lengths[t])
                got = self._window(t, w[part], at[part], known[part])
                if got > best[1] + 1e-12:
                    best = (t, got)
        return best

    def _window(self, t: int, w: np.ndarray, at: np.ndarray, known: np.ndarray) -> float:
        """Cosine of the best window with template ``t``, 0 if that is below the threshold."""
        step = max(1, self.lengths[t] // 8)
        width = -(-self.lengths[t] // step)  # blocks in a window
        terms = np.flatnonzero(self.all_rows[t])
        blocks = np.arange(len(w)) // step
        column = np.full(len(self.all_words), -1)
        column[terms] = np.arange(len(terms))
        own = np.where(known, column[at], -1)
        n = int(blocks[-1]) + 1
        counts = np.bincount(blocks[own >= 0] * len(terms) + own[own >= 0], minlength=n * len(terms)).reshape(n, len(terms))
        idf = np.where(known, self.all_idf[at], self.rare)
        other = np.bincount(blocks, np.where(own < 0, idf**2, 0), n)
        first = np.arange(max(1, n - width + 1))
        last = np.minimum(first + width, n)
        sums, others = np.concatenate([np.zeros((1, len(terms))), counts.cumsum(axis=0)]), np.concatenate([[0], other.cumsum()])
        tf = (sums[last] - sums[first]) * self.all_idf[terms]
        # other words count at least once each: no cosine is more than this
        most = tf @ self.all_rows[t, terms] / np.sqrt(np.maximum((tf**2).sum(axis=1) + others[last] - others[first], 1e-9))
        best = 0.0
        for k in np.argsort(-most, kind="stable"):
            if most[k] < max(best, self.threshold) - 1e-9:
                break
            a, b = first[k] * step, min(len(w), last[k] * step)
            strange = own[a:b] < 0
            _, which, count = np.unique(w[a:b][strange], return_index=True, return_counts=True)
            norm = (tf[k] ** 2).sum() + ((count * idf[a:b][strange][which]) ** 2).sum()
            best = max(best, float(tf[k] @ self.all_rows[t, terms] / math.sqrt(norm)))
        return best if best >= self.threshold - 1e-9 else 0.0

    def _lines(self, data: np.ndarray, w: np.ndarray, starts: np.ndarray) -> tuple[int, float]:
        """(template, cosine) of the best line, or window of a long line, with the short notices."""
        at = np.searchsorted(self.vocabulary, w)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == w
        if known.sum() < 2:
            return -1, 0.0
        line = np.cumsum(data == 10)[starts]
        cuts = np.concatenate([[0], np.flatnonzero(line[1:] != line[:-1]) + 1, [len(w)]])
        hits = np.concatenate([[0], np.cumsum(known)])
        best = (-1, 0.0)
        for s, e in zip(cuts[:-1], cuts[1:]):
            if hits[e] - hits[s] < 2:
                continue
            windows = [(s, e)] if e - s <= LONG else [(k, min(e, k + LONG)) for k in range(s, e - LONG // 2, LONG // 2)]
            for a, b in windows:
                if hits[b] - hits[a] < 2:
                    continue
                tf = np.bincount(at[a:b][known[a:b]], minlength=len(self.vocabulary)) * self.idf
                other = np.unique(w[a:b][~known[a:b]], return_counts=True)[1] * self.rare
                cos = self.rows @ tf / math.sqrt((tf**2).sum() + (other**2).sum())
                k = int(cos.argmax())
                if cos[k] > best[1] + 1e-12:
                    best = (k, float(cos[k]))
        return best


def own_licenses(files: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``files`` with own_license and cosine (of the best segment) added."""
    matcher = files.sparkSession.sparkContext.broadcast(Matcher(*document_frequencies(files, text), threshold))

    @F.arrow_udf("struct<template:int,cosine:double>")
    def match(column: pa.Array) -> pa.Array:
        got = [matcher.value.best(d) for d in texts_of(column)]
        return pa.StructArray.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([c for _, c in got], pa.float64())], names=["template", "cosine"])

    names = F.array(*[F.lit(n) for n, _ in ALL])
    found = files.withColumn("_m", match(F.col(text)))
    return found.withColumn("own_license", F.when(F.col("_m.cosine") >= threshold, F.get(names, F.col("_m.template")))).withColumn("cosine", F.col("_m.cosine")).drop("_m")


def directory(path: Column) -> Column:
    """All before the last slash; empty at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def inherit(licensed: DataFrame, path: str = "path") -> DataFrame:
    """``licensed`` (own_license, cosine) with license and license_from (the file's path or a directory) added.

    Directories, not files, are joined with their ancestors; directories with very many files are salted.
    """
    dirs_of = licensed.withColumn("_dir", directory(F.col(path)))
    counted = materialize(dirs_of.filter("_dir is not null").groupBy("_dir").agg(F.count(F.lit(1)).alias("n")))
    holders = dirs_of.filter(F.col("own_license").isNotNull() & F.col(path).rlike(LICENCE_FILE))
    holders = holders.groupBy("_dir").agg(F.min(F.struct(-F.col("cosine"), F.col(path), "own_license")).alias("b")).select(F.col("_dir").alias("holder"), F.col("b.own_license").alias("dir_license"))
    parts = F.split("_dir", "/")
    above = counted.select("_dir", F.explode(F.concat(F.array(F.lit("")), F.when(F.col("_dir") != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array()))).alias("holder"))
    sizes = above.groupBy("holder").agg(F.count(F.lit(1)).alias("m"))
    found = salted_join(above, holders, "holder", hot_keys(sizes, "holder", "m"), spread="_dir")
    nearest = found.groupBy("_dir").agg(F.max(F.struct(F.length("holder"), "holder", "dir_license")).alias("b")).select("_dir", F.col("b.holder").alias("_holder"), F.col("b.dir_license").alias("_inherited"))
    hot = hot_keys(counted, "_dir", "n")
    out = salted_join(dirs_of, nearest, "_dir", hot, "left", spread=path)
    own = F.col("own_license").isNotNull()
    return out.withColumn("license", F.coalesce("own_license", "_inherited")).withColumn("license_from", F.when(own, F.col(path)).otherwise(F.col("_holder"))).drop("_dir", "_holder", "_inherited")


def op9(spark, sf_dir: str) -> DataFrame:
    """Documents as a file tree: source/doc_id div 500/doc_id, every tenth a licence file of its directory."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    base = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("_")), F.floor(F.col("doc_id") / 500).cast("string"), base)).select("doc_id", "path", "text")
    licensed = materialize(own_licenses(files).select("doc_id", "path", "own_license", "cosine"))
    return inherit(licensed).select("doc_id", "path", "own_license", "cosine", "license", "license_from")
