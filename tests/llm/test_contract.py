"""The registered queries over tables with nulls, empty and long texts, ties and repeated rows, against plain Python."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from test_llm import WORD, base_spans, brute_distance, brute_near, brute_targets, brute_url, lower

import corpus_pipeline
from heliograph.llm import decontaminate, license_scan, queries, token_scan, url_filter

RNG = np.random.default_rng(17)
VOCAB = {g: [g + "".join(RNG.choice(list(a), 4)) for _ in range(300)] for g, a in (("en", "thewinsr"), ("fr", "éauoxlpq"))}
ITEM = [" ".join(RNG.choice(VOCAB["en"], n)) for n in (12, 30)]


def make_documents():
    prose = lambda g, n: " ".join(RNG.choice(VOCAB[g], n))
    texts = [(prose("en" if k % 3 else "fr", int(RNG.integers(20, 70))), "en" if k % 3 else "fr") for k in range(70)]
    toxic = set(range(0, 70, 4))
    texts = [(t + " vile wretch scum" if k in toxic else t, g) for k, (t, g) in enumerate(texts)]
    base = prose("en", 60)
    texts += [(base, "en"), (base.upper(), "en"), (base + " more", "en"), (base, "en")]
    texts += [(f"x {ITEM[1]} y", "en"), (prose("en", 30) + " " + ITEM[0].replace(" ", "  ", 3), "en"), (" ".join(ITEM[1].split()[5:]) + " z", "en")]
    texts += [(f"key password = 'abc{k}def' {'0123456789abcdef' * 2} é", "en") for k in range(3)] + [("AKIA" + "A1" * 10, "en")]
    texts += [("Licensed under the Apache License, Version 2.0.", "en"), ("text\nReleased under the MIT License.\nmore", "en")]
    texts += [(None, "en"), (None, None), ("", None), (" \n ", "en"), ("1 2 3", "fr"), ("one", None), (prose("en", 40_000), None)]
    rows = [(k, t, g, [None, "a", "b", "ä", "Z"][k % 5], len(t or "")) for k, (t, g) in enumerate(texts)]
    rows += [(5, *rows[5][1:]), (None, rows[70][1], "en", "a", 3)]  # a repeated row, and one without an id
    return rows, toxic


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows, toxic = make_documents()
    write = lambda name, data, schema: spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{at}/{name}.parquet")
    write("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    write("labels", [(k, 1, int(k in toxic)) for k in range(70)] + [(71, 1, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    write("benchmark", [(7, ITEM[0]), (8, ITEM[1]), (9, None), (10, ""), (None, ITEM[0])], "item_id long, text string")
    urls = ["http://A.example.NET/en/1?x=1", "https://x.net/", "http://example.com/de/", "ftp://w.org/fr/2", "no url", None, "", "http://h?x://y/", "http://plain.example.org/a"]
    write("pages", [*enumerate(urls), (1, urls[1]), (None, urls[0])], "page_id long, url string")
    x = RNG.normal(size=(12, 16))
    vectors = [(k, [float(z) for z in x[k % 12] + 0.1 * (k >= 12) * RNG.normal(size=16)], k % 12 % 2) for k in range(60)]
    vectors += [(60, None, 1), (61, [0.0] * 16, 1), (62, [float("inf")] + [1.0] * 15, 1), (63, vectors[0][1], None), (64, vectors[0][1], vectors[0][2]), (3, vectors[3][1], vectors[3][2])]
    write("embeddings", vectors, "vec_id long, embedding array<float>, label int")
    return str(at), rows, toxic, urls, vectors


def ran(spark, sf, name):
    return queries.queries()[name](spark, sf[0])


def ids(rows):
    return sorted((r[0] for r in rows), key=lambda k: (k is None, k))


def test_op1(spark, sf):
    got = ran(spark, sf, "op1_secret_scan").collect()
    assert ids(got) == ids(sf[1])
    text = {r[0]: r[1] for r in sf[1]}
    for r in got:
        spans = base_spans(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k + ":") for s in spans) for k in ("assign", "access", "hex"))
        assert set(spans) <= set(r.spans.split(",")) | {""}


def test_op2(spark, sf):
    got = ran(spark, sf, "op2_source_mix").collect()
    assert ids(got) == ids(sf[1])
    source = {r[0]: r[3] for r in sf[1]}
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in sf[1]}
    order = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    whole = [sum(size[r[0]] for r in sf[1] if r[3] == s) for s in order]
    want = dict(zip(order, zip(whole, brute_targets(whole, [(5, 2, 1)[k % 3] for k in range(len(order))]))))
    for r in got:
        assert (r["size"], r.source_size) == (size[r.doc_id], want[source[r.doc_id]][0]) and r.target == pytest.approx(want[source[r.doc_id]][1])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == sum(p.words for p in r.pieces)
    for s in order:
        assert sum(r.taken for r in got if source[r.doc_id] == s) == pytest.approx(want[s][1], abs=1)
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in ran(spark, sf, "op2_source_mix").collect())


def test_op3(spark, sf):
    got = ran(spark, sf, "op3_language_id")
    assert dict(got.dtypes)["held_out"] == "boolean" and dict(got.dtypes)["score"] == "double"
    got = got.collect()
    assert ids(got) == ids(sf[1])
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" for k, t, *_ in sf[1] if not re.search(r"[^\W\d_]", t or ""))
    assert np.mean([by[k].lang_pred == sf[1][k][2] for k in range(70) if by[k].held_out]) > 0.9


def test_op4(spark, sf):
    got = {r.doc_id: r for r in ran(spark, sf, "op4_minhash_dedup").collect()}
    rows = [r for r in sf[1] if r[0] is not None][:-1]  # without the repeated row
    sizes, comp = brute_near([r[1] for r in rows], 3, 85)
    assert [got[k].n_shingles for k in range(len(rows))] == sizes and [got[k].component_id for k in range(len(rows))] == comp
    assert all(got[k].kept == (comp[k] == k) for k in range(len(rows))) and got[None].component_id is None


def test_op5(spark, sf):
    got = ran(spark, sf, "op5_toxicity").collect()
    assert ids(got) == ids(sf[1])
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.doc_id < 70]
    assert len(held) > 10 and np.mean([(r.score >= 0.5) == (r.doc_id in sf[2]) for r in held]) > 0.9


def test_op6(spark, sf):
    got = ran(spark, sf, "op6_url_filter").collect()
    verdict = {r: v for v, r in url_filter.RULES}
    assert ids(got) == sorted([*range(len(sf[3])), 1]) + [None]
    for r in got:
        host, path, rule = brute_url(sf[3][r.page_id or 0])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == verdict.get(rule, r.verdict) and r.verdict in ("allow", "block")


def test_op7(spark, sf):
    got = {(r.doc_id, r.item_id): r.distance for r in ran(spark, sf, "op7_decontaminate").collect()}
    norm = lambda t: re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", lower(t or ""))
    want = {}
    for k, t, *_ in sf[1]:
        for i, item in ((7, ITEM[0]), (8, ITEM[1])):
            if t and len(t) < 10_000 and (d := brute_distance(norm(item), norm(t))) <= decontaminate.allowed(len(norm(item)), 0.8):
                want[k, i] = d
    assert got == want and len(want) >= 3


def test_op8(spark, sf):
    got = {r.vec_id: r for r in ran(spark, sf, "op8_embedding_dedup").collect()}
    sound = {k: (np.array(v, np.float32).astype(float), g) for k, v, g in sf[4] if v and g is not None and np.isfinite(v).all() and any(v)}
    links = {k: set() for k, *_ in sf[4]}
    for a, b in itertools.combinations(sound, 2):
        (u, g), (v, h) = sound[a], sound[b]
        if g == h and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
            links[a].add(b)
            links[b].add(a)
    comp = {k: k for k in links}
    for _ in links:
        for a in links:
            for b in links[a]:
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert {k: r.n_links for k, r in got.items()} == {k: len(v) for k, v in links.items()} and sum(map(len, links.values())) > 100
    assert {k: r.component_id for k, r in got.items()} == comp and all(r.kept == (comp[k] == k) for k, r in got.items())


def test_op9(spark, sf):
    got = {r.doc_id: r for r in ran(spark, sf, "op9_license_scan").collect() if r.doc_id is not None}
    text = {r[0]: r[1] for r in sf[1] if r[0] is not None}
    words = lambda t: re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", lower(t or ""))
    n = len(sf[1])
    df = {}
    for r in sf[1]:
        for w in set(words(r[1])):
            df[w] = df.get(w, 0) + 1
    vocabulary = {w for _, t in license_scan.ALL for w in words(t)}
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 if w in vocabulary else math.log(n + 1) + 1

    def cosine(line, template):
        a, b = ({w: c.count(w) * idf(w) for w in c} for c in (words(line), words(template)))
        return sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    for k, t in text.items():
        if t and "License" in t:
            best = max((round(cosine(line, s), 9), name) for line in t.split("\n") if words(line) for name, s in license_scan.TEMPLATES)
            assert got[k].own_license == best[1] and got[k].cosine == pytest.approx(best[0], abs=1e-6)
        else:
            assert got[k].own_license is None
    # licence files (every tenth document) give their directory's other files their licence
    holder = {sf[1][k][3]: got[k] for k in range(0, len(text), 10) if got[k].own_license}
    for k, r in got.items():
        want = r.own_license or (holder[sf[1][k][3]].own_license if sf[1][k][3] in holder else None)
        assert r.license == want, k


def test_op10(spark, sf):
    enc = token_scan.encoder(token_scan.ranks_of(token_scan.RANKS))
    want = sorted((str(r[0]), len(enc.encode_ordinary(r[1] or ""))) for r in sf[1])
    assert sorted((str(r.doc_id), r.n_tokens) for r in ran(spark, sf, "op10_token_scan").collect()) == want


# --- pipeline ----------------------------------------------------------------------------------------------------

CLASH = ("size", "target", "taken", "pieces", "score", "found", "accepted", "lang_pred", "blob", "spans", "kept", "id", "bucket", "recall")


def test_pipeline_stages(spark, sf):
    """Each stage on its own input, with columns of other names' making; documents that should stay do."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf[0]}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1)).cast("string")) for c in CLASH})
    held, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, sf[0])
        if name != "source_mix":
            assert out.columns == docs.columns, name
            rows = out.collect()
            assert all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for r in rows for c in CLASH), name
            held = spark.createDataFrame(rows, docs.schema)
            seen[name] = rows
        assert stage(spark, docs.filter("false"), sf[0]).count() == 0, name
    text = {r[0]: r[1] for r in sf[1]}
    spoken = {k for k, t in text.items() if k is not None and re.search(r"[^\W\d_]", t or "")}
    first = {r.doc_id for r in seen["language_id"]}
    assert not {k for k in first if k is not None} - spoken and len(spoken - first) <= 3
    named = [r for r in seen["language_id"] if r.doc_id is not None]
    _, comp = brute_near([r.text for r in named], 5, 80)
    best = {c: min(r.doc_id for r, d in zip(named, comp) if d == c) for c in set(comp)}
    kept = [r.doc_id for r in seen["minhash_dedup"] if r.doc_id is not None]
    assert sorted(kept) == sorted(best.values()) and {70, 5} <= set(kept) and not {71, 73} & set(kept)
    assert len(seen["minhash_dedup"]) - len(kept) == len(first_rows := [r for r in seen["language_id"] if r.doc_id is None]) and len(first_rows) == 1
    clean = {r.doc_id for r in seen["decontaminate"]}
    assert not clean & {74, 75, 76} and set(kept) - clean <= {74, 75, 76}
    redacted = {r.doc_id: r for r in seen["secret_scan"]}
    assert set(redacted) == clean and not any(base_spans(r.text) for r in redacted.values()) and all(r.n_chars == len(r.text) for r in redacted.values())
    assert all(redacted[k].text == text[k] for k in clean if k is not None and not base_spans(text[k]) and "AKIA" not in text[k])
    mixed = corpus_pipeline.STAGES[-1][1](spark, held, sf[0]).collect()
    assert all(0 < r.taken <= 2 * r["size"] for r in mixed) and {r.doc_id for r in mixed} <= clean
    whole = corpus_pipeline.run(spark, sf[0])
    assert sorted((str(r.doc_id), r["size"]) for r in whole.collect()) == sorted((str(r.doc_id), r["size"]) for r in mixed)
