"""Sessions, collocations and language-model scores against plain Python, over rows of every awkward kind."""

import datetime as dt
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.llm import collocations, language_model, queries, sessions

MINUTE = 60_000_000
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def lower(text):
    return text.translate({a: a + 32 for a in range(65, 91)})


# --- sessions


def at(minutes, micro=0):
    return dt.datetime(2024, 3, 31, 0, 30) + dt.timedelta(minutes=minutes, microseconds=micro)


def us(t):
    return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def brute_sessions(rows, gap=30, span=120, late=60):
    one = {}
    for i, ts, arrived, client, kind, value, _ in rows:
        if None not in (i, ts, client):
            r = (us(ts), arrived is not None and us(arrived) - us(ts) > late * MINUTE, client, kind, value)
            one.setdefault(i, r)
    clients = defaultdict(list)
    for i, (t, is_late, client, kind, value) in one.items():
        value = value if value is not None and math.isfinite(value) else None
        fin = kind == "purchase" and value is not None and value >= 60
        clients[client].append((t, i, is_late, fin, 0 if value is None else math.floor(value * 100 + 0.5)))
    out = {}
    for client, clicks in clients.items():
        found = []
        for t, i, is_late, fin, cents in sorted(clicks):
            if is_late:
                continue
            if found:
                first, last = found[-1][0], found[-1][-1]
                why = "end" if last[2] else "gap" if t - last[0] >= gap * MINUTE else "length" if t - first[0] > span * MINUTE else None
            if not found or why:
                if found:
                    closed[-1] = why
                else:
                    closed = []
                found.append([])
                closed.append(None)
            found[-1].append((t, i, fin, cents))
        for k, s in enumerate(found):
            until = found[k + 1][0][0] if k + 1 < len(found) else math.inf
            n_late = sum(c[2] and s[0][0] <= c[0] < until for c in clicks)
            path = hashlib.sha256(",".join(str(c[1]) for c in s).encode()).hexdigest()
            out[s[0][1]] = (client, s[0][0], s[-1][0], len(s), n_late, sum(c[3] for c in s), closed[k] or ("end" if s[-1][2] else "none"), path)
    return out


def made_clicks():
    rnd, rows, n = random.Random(5), [], 0

    def add(client, t, kind="view", value=1.0, delay=1, i=None):
        nonlocal n
        n += 1
        rows.append((n if i is None else i, t, None if delay is None or t is None else t + dt.timedelta(minutes=delay), client, kind, value, "{}"))

    for k in range(700):  # one client's island of many lengths, across a day's end and a change of summer time
        add(1, at(k * 2.9 + rnd.random()), value=rnd.choice([0.005, 1.115, None, 70.0]))
    for m in (0, 30, 60 - 1e-6 / 60, 120, 149, 240, 240, 269.999, 300):  # gaps at the limit, ties
        add(2, at(m))
    for m, kind, value in ((0, "purchase", 60.0), (0, "purchase", 60.0), (1, "purchase", 59.99), (2, None, 90.0), (3, "purchase", None), (4, "purchase", float("nan")), (200, "purchase", 99.0)):
        add(3, at(m), kind, value)
    for m in range(0, 241, 20):  # length at the limit: 120 minutes stay, a microsecond more doesn't
        add(4, at(m, 1 if m == 120 else 0))
        add(5, at(m))
    for c in range(6, 30):
        t = rnd.uniform(0, 3000)
        for _ in range(rnd.randrange(1, 60)):
            t += rnd.expovariate(1 / 12)
            add(c, at(t), rnd.choice(["view", "purchase"]), rnd.uniform(-5, 120), rnd.choice([0, 1, 60, 60.5, 300, None]))
    add(40, at(5), delay=61)  # only late
    add(None, at(1)), add(41, None), add(41, at(1), i=-5), add(41, at(9), delay=-3)
    rows.append((None, *rows[0][1:]))
    return rows + rows[:40] + rows[650:720]


def read(spark, rows, schema, path, name):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def found_sessions(spark, sf):
    return {r["session_id"]: tuple(r[c] for c in ("client_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", "path_sha256")) for r in queries.queries()["op11_sessions"](spark, sf).collect()}


@pytest.mark.parametrize("zone", ["UTC", "Europe/Paris"])
def test_sessions_are_those_of_a_plain_walk(spark, tmp_path, zone):
    rows = made_clicks()
    sf = read(spark, rows, CLICKS, tmp_path, "clicks")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got, want = found_sessions(spark, sf), brute_sessions(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want
    assert {s[6] for s in want.values()} == {"end", "gap", "length", "none"}
    assert sum(s[0] == 1 and s[6] == "length" for s in want.values()) >= 15  # as many rounds


def test_clicks_whose_rows_differ_count_once(spark, tmp_path):
    rows = made_clicks()[700:790]
    odd = [(rows[3][0], rows[3][1] - dt.timedelta(hours=3), *rows[3][2:]), (*rows[5][:2], None, *rows[5][3:]), (*rows[8][:3], 77, *rows[8][4:])]
    sf = read(spark, rows + odd, CLICKS, tmp_path, "clicks")
    least = {}
    for r in rows + odd:
        if None not in (r[0], r[1], r[3]):
            fin = r[4] == "purchase" and r[5] is not None and math.isfinite(r[5]) and r[5] >= 60
            cents = math.floor(r[5] * 100 + 0.5) if r[5] is not None and math.isfinite(r[5]) else 0
            key = (us(r[1]), (r[2] is not None, us(r[2]) if r[2] else 0), r[3], fin, cents)
            least[r[0]] = min(least.get(r[0], (key, r)), (key, r), key=lambda x: x[0])
    assert found_sessions(spark, sf) == brute_sessions([r for _, r in least.values()])


def test_marks_from_earlier_blocks_are_found_once(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 3, None), (2, 1, None)], "key long, block long, mark string")
    filled = sessions._filled(rows, rows, "key")
    assert {tuple(r) for r in filled.select("key", "block", "mark").collect()} == {(1, 0, "a"), (1, 1, "a"), (1, 3, "a"), (2, 1, None)}
    assert "Join" not in filled._jdf.queryExecution().executedPlan().toString()


def test_sessions_of_no_clicks_and_of_clashing_columns(spark, tmp_path):
    assert found_sessions(spark, read(spark, [], CLICKS, tmp_path, "clicks")) == {}
    rows = made_clicks()[700:760]
    clicks = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], CLICKS + ", us long, mark long, session_id long, island string")
    assert {r["session_id"] for r in sessions.sessions(clicks).collect()} == set(brute_sessions(rows))


# --- collocations


def brute_phrases(docs, least=10, most=3, covered=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    cand = {(g, p): a for (g, p), a in f.items() if len(p) > 1 and a >= least}
    longest = defaultdict(int)
    for (g, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longest[g, p[i : i + k]] = max(longest[g, p[i : i + k]], a)
    out = defaultdict(list)
    for (g, p), a in cand.items():
        if 100 * longest[g, p] >= covered * a and (g, p) in longest:
            continue
        cuts = [(math.floor(Fraction(1_000_000 * a * a, f[g, p[:k]] * f[g, p[k:]])), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[g].append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
    return sorted((g, i + 1, p.decode(), -a, left, right, n[g], -s) for g, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def made_texts():
    rnd = random.Random(11)
    words = ["The", "of", "new", "york", "city", "ÉTÉ", "été", "a\x01", "a", "zß", "x-y", "don't", "東京", "hot", "pair"]
    texts = []
    for k in range(160):
        parts = [rnd.choice(words) if rnd.random() < 0.8 else rnd.choice(["New York city", "hot pair", "a\x01 a a a", f"w{rnd.randrange(40)}"]) for _ in range(rnd.randrange(5, 60))]
        texts.append(("".join(p + rnd.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n"]) for p in parts), [None, "und", "en", "fr", ""][k % 5]))
    texts += [("hot pair " * 30_000, "en"), ("x" * 300_000 + " " + "y " * 20, "fr"), (None, "en"), ("", None), (" \n.,", "de"), ("one", "it")]
    return texts + texts[:30]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("shard", [collocations.SHARD, 3_000])
def test_collocations_are_those_of_plain_counts(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(collocations, "SHARD", shard)
    texts = made_texts()
    sf = read(spark, [(k, t, g, "s", 0) for k, (t, g) in enumerate(texts)], DOCS, tmp_path, "documents")
    got = queries.queries()["op12_collocations"](spark, sf)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == brute_phrases(texts)


def test_longer_phrases_more_ranges_than_paths_and_no_limit(spark):
    texts = made_texts()[:60] * 2
    docs = spark.createDataFrame(texts, "text string, lang string").withColumn("path", F.lit(1)).withColumn("rank", F.lit(1))
    got = collocations.collocations(docs, most_words=4, least=6, covered_percent=80, top=None)
    assert sorted(map(tuple, got.collect())) == brute_phrases(texts, 6, 4, 80, None)
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).collect() == []


def test_products_over_64_bits_are_exact(spark, monkeypatch):
    a, big = 5_000_000_011, 7_000_000_033
    rows = [("en", 0, [], 3 * big), ("en", 1, ["x"], big), ("en", 1, ["y"], big + 1), ("en", 2, ["x", "y"], a)]
    made = spark.createDataFrame(rows, "lang string, depth int, path array<string>, a long")
    monkeypatch.setattr(collocations, "frequent_paths", lambda *_: made)
    got = collocations.collocations(made, most_words=2).collect()
    assert [tuple(r) for r in got] == [("en", 1, "x y", a, big, big + 1, 3 * big, 1_000_000 * a * a // (big * (big + 1)))]


def test_a_trie_is_cut_where_its_paths_are(spark):
    texts = [np.frombuffer(t.encode(), np.uint8) for t in ("a b c a b d", "b a b a", "c")]
    trie = collocations.Trie(texts, [b"en", b"fr", b"en"], 3)
    paths = [[], [], [], []]
    for k, (parents, words, _) in enumerate(trie.levels):
        for p, w in zip(parents, words):
            paths[k].append(((trie.langs[w],) if k == 0 else (*paths[k - 1][p], trie.words[int(w)].as_py())))
        assert paths[k] == sorted(paths[k])
    every = [p for level in paths for p in level] + [(b"en", b"a", b"bb"), (b"de",), (b"fr", b"a", b"b", b"zz"), (b"zz", b"a"), (b"en", b"aa", b"b")]
    for cut in every:
        assert trie.cut(cut) == [sum(p < cut for p in level) for level in paths]


# --- language model


def tokens_of(text):
    return [w for w in re.split("[ \t-\r]+", lower(text or "")) if w] + [None]


def brute_model(docs, order, weights):
    """id: (n, known, N, base, score), for given weights of (log-bucket, estimates)."""
    learned = [tokens_of(t) for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = [Counter() for _ in range(order + 1)]
    for w in learned:
        padded = ["^"] * (order - 1) + w
        for j in range(len(w)):
            for k in range(1, order + 1):
                c[k][tuple(padded[j + order - k : j + order])] += 1
    total, texts = sum(c[1].values()), len(learned)
    v = len(c[1])
    out = []
    for i, t in docs:
        w = tokens_of(t)
        padded, base, score = ["^"] * (order - 1) + w, 0.0, 0.0
        for j, x in enumerate(w):
            p, context = [1 / (v + 1)], total
            for k in range(1, order + 1):
                run = tuple(padded[j + order - k : j + order])
                context = total if k == 1 else texts if set(run[:-1]) == {"^"} else c[k - 1][run[:-1]]
                p.append(c[k][run] / context if context else 0.0)
            bucket = 0 if context == 0 else int(math.log2(context)) + 1
            score += math.log10(sum(a * b for a, b in zip(weights[bucket], p)))
            base += math.log10((c[1][(x,)] + 1) / (total + v + 1))
        out.append((i, len(w), sum(c[1][(x,)] > 0 for x in w), total, base, score))
    return out


def model_docs():
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(words[int(rnd.paretovariate(0.8)) % 60] for _ in range(rnd.randrange(1, 80)))) for k in range(150)]
    docs += [(200, None), (201, ""), (202, " \t\n"), (203, "É é É"), (204, "W1 w1 W2"), (None, "w1 w2"), (5, docs[5][1]), (205, "x" * 100_000 + " " + "w3 " * 40_000)]
    return docs


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))


@pytest.mark.parametrize(("order", "shard"), [(2, 4_000), (3, language_model.SHARD), (1, 4_000)])
def test_scores_are_those_of_plain_counts(spark, monkeypatch, order, shard):
    monkeypatch.setattr(language_model, "SHARD", shard)
    weights = np.random.default_rng(1).dirichlet(np.ones(order + 1), language_model.BUCKETS)
    monkeypatch.setattr(language_model, "learn_weights", lambda *_: weights)
    docs = model_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("learn", F.lit(1)).repartition(3)
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = by_id(map(tuple, language_model.scores(df, learn, order=order).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()))
    want = by_id(brute_model(docs, order, weights))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    np.testing.assert_allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9)


def test_weights_are_those_of_plain_expectation_maximisation(spark):
    rng = np.random.default_rng(2)
    rows = [(int(b), float(rng.random() < 0.7) * float(rng.random()) * 0.1, float(rng.random() < 0.5) * float(rng.random()), int(rng.integers(1, 5))) for b in rng.integers(0, 6, 400)]
    events = spark.createDataFrame(rows, "bucket int, p1 double, p2 double, n long")
    got = language_model.learn_weights(events, 2, 0.001, steps=8, gain=-1.0)
    b, n = np.array([r[0] for r in rows]), np.array([r[3] for r in rows])
    p = np.array([(0.001, r[1], r[2]) for r in rows])
    w = np.full((6, 3), 1 / 3)
    for _ in range(8):
        x = w[b] * p
        g = x / x.sum(1, keepdims=True) * n[:, None]
        for k in range(6):
            w[k] = (g[b == k].sum(0) + 1) / (n[b == k].sum() + 3)
    np.testing.assert_allclose(got[:6], w, rtol=1e-9)
    np.testing.assert_allclose(got[6:], np.tile(got[5], (language_model.BUCKETS - 6, 1)))


def test_what_is_set_apart_counts_without_itself(spark):
    """Texts set apart meet only what other texts hold: unique ones have no estimate but the end's."""
    docs = [(k, f"only{k}a only{k}b") for k in range(80)]
    rows = spark.createDataFrame(docs, "id long, text string").select("id", F.lit(True).alias("learn"), (F.col("id") % 4 == 0).alias("apart"), "text").repartition(2)
    shards = language_model.materialize(language_model._shards(rows))
    answers = language_model.materialize(language_model._answers(language_model._questions(shards, 2, 5), 2))
    total, types, aside = answers.agg(F.sum("total"), F.sum("types"), F.sum("aside")).first()
    assert (total, types, aside) == (240, 161, 60)
    events = language_model._events(shards, answers, 2, total, aside, 80, 20).collect()
    assert sum(r["n"] for r in events) == 60
    assert {(r["p1"], r["p2"]) for r in events} == {(0.0, 0.0), (60 / 180, 0.0)}


def test_the_query_beats_its_base_on_texts_held_out_and_handles_empty_tables(spark, tmp_path):
    rnd = random.Random(4)
    chains = [f"a{k} b{k} c{k} d{k}" for k in range(20)]
    docs = [(k, " ".join(rnd.choice(chains) for _ in range(30)), None, None, 0) for k in range(120)] + [(None, "a1 b1", None, None, 0), (121, None, "en", "x", None)]
    got = queries.queries()["op13_language_model"](spark, read(spark, docs, DOCS, tmp_path, "documents"))
    assert [c for c in got.columns] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(docs) and {r["doc_id"] for r in held} == {None} | {d[0] for d in docs if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 2}
    assert sum(r["score"] for r in held) > 0.6 * sum(r["base_score"] for r in held)  # both negative
    assert all(r["score"] < 0 for r in rows)
    empty = queries.queries()["op13_language_model"](spark, read(spark, [], DOCS, tmp_path / "empty", "documents"))
    assert empty.collect() == []
    nothing = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    only = language_model.scores(nothing, F.lit(False)).collect()[0]
    assert (only["n_tokens"], only["n_known"], only["train_tokens"], only["base_score"]) == (3, 0, 0, 0.0)
