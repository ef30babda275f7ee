"""Operators on small tables of our own, with results worked out by hand or by plain Python."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from heliograph.functions import text as T
from heliograph.functions.aliases import Catalog
from heliograph.operators import adapters, delivery, dense, documents, filters, fusion, judging, lexical, manifest, metrics, parsing, rerank, routing, skew, story

ANN = "item_id string, summary string, objects array<string>, object_counts array<struct<name:string,count:int>>, actions array<string>, scene string, attributes array<string>, spatial_relations array<string>, style array<string>, mood array<string>, colors array<string>, ocr_text array<string>"
NAMES = ("item_id", "summary", "objects", "object_counts", "actions", "scene", "attributes", "spatial_relations", "style", "mood", "colors", "ocr_text")


def ann(spark, *rows):
    empty = {c: "" if c in ("summary", "scene") else [] for c in NAMES}
    return spark.createDataFrame([tuple((empty | r)[c] for c in NAMES) for r in rows], ANN)


def rows_of(spark, text, schema):
    """Rows written as `a 1 x; b 2 y`."""
    kinds = [c.split()[1] for c in schema.split(", ")]
    cast = {"int": int, "long": int, "double": float, "string": str}
    return spark.createDataFrame([tuple(cast[k](v) for k, v in zip(kinds, r.split())) for r in text.split("; ")], schema)


# --- fusion ------------------------------------------------------------------------------------------------------


def test_rrf_is_a_sum_over_first_places(spark):
    r = rows_of(spark, "7 image tea 0.5 1; 7 image cup 0.4 2; 7 image tea 0.3 3; 7 bm25 cup 9 1; 7 bm25 pot 2 2", "query_id int, branch string, item_id string, score double, rank int")
    got = {x.item_id: x for x in fusion.top(fusion.rrf(r, 10), 5).collect()}
    assert {k: round(v.fused_score, 9) for k, v in got.items()} == {"cup": round(1 / 12 + 1 / 11, 9), "tea": round(1 / 11, 9), "pot": round(1 / 12, 9)}
    assert [got[k].rank for k in ("cup", "tea", "pot")] == [1, 2, 3] and got["tea"].branch_ranks == {"image": 1} and got["cup"].branch_scores == {"image": 0.4, "bm25": 9.0}
    with pytest.raises(ValueError, match="negative"):
        fusion.rrf(r, -1)


def test_weighted_is_a_mean_of_min_max_scores(spark):
    r = rows_of(spark, "7 image tea 3 1; 7 image cup 2 2; 7 image pot 1 3; 7 bm25 pot 5 1; 7 bm25 cup 5 2", "query_id int, branch string, item_id string, score double, rank int")
    got = {x.item_id: x.fused_score for x in fusion.weighted(r, {"image": 3, "bm25": 1}, ("image", "bm25")).collect()}
    assert got == {"tea": pytest.approx(0.75), "cup": pytest.approx((3 * 0.5 + 1) / 4), "pot": pytest.approx(0.25)}  # equal scores count as 1
    for weights, said in (({"image": -0.1}, "non-negative"), ({"smell": 1}, "inactive"), ({"image": 0, "bm25": 0}, "zero")):
        with pytest.raises(ValueError, match=said):
            fusion.weighted(r, weights, ("image", "bm25"))


def test_ties_go_by_id(spark):
    r = rows_of(spark, "1 b b 0.5 1; 1 c a 0.5 1", "query_id int, branch string, item_id string, score double, rank int")
    assert [x.item_id for x in fusion.top(fusion.rrf(r), 2).orderBy("rank").collect()] == ["a", "b"]


# --- filters and parsing -----------------------------------------------------------------------------------------


def decided(spark, row, mode="hybrid", **slots):
    a = documents.normalized_fields(documents.fields(ann(spark, {"item_id": "x"} | row)))
    for k, v in slots.items():
        a = a.withColumn("t_" + k, F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v))
    a = a.select("item_id", "f", "n", a["object_counts"], *[F.col("t_" + k).alias(k) for k in slots])
    return filters.decide(a, Catalog(), mode).first()


def test_excluded_terms_look_in_their_home_field(spark):
    assert not decided(spark, {"objects": ["小狗"]}, excluded_terms=["狗"])["allowed"]
    assert decided(spark, {"summary": "一只狗", "objects": ["猫"]}, excluded_terms=["狗"])["allowed"]
    assert not decided(spark, {"summary": "一把雨伞"}, excluded_terms=["雨伞"])["allowed"]  # no home: any field
    # a one-letter alias must be the whole value
    assert decided(spark, {"objects": ["机器人"]}, excluded_terms=["人物"])["allowed"]


def test_required_and_read_terms(spark):
    d = decided(spark, {"mood": ["宁静"]}, required_terms=["宁静", "海边"])
    assert not d["allowed"] and d["matched_fields"] == ["mood"] and d["mismatch"] == ["missing:海边"]
    # full-width letters and case make no difference
    assert decided(spark, {"ocr_text": ["ＣＡＦＥ 24h"]}, ocr_terms=["cafe24H"])["allowed"]
    assert not decided(spark, {"summary": "cafe"}, ocr_terms=["cafe"])["allowed"]


@pytest.mark.parametrize(("operator", "value", "ok"), [("eq", 4, True), ("eq", 3, False), ("gte", 4, True), ("gte", 5, False), ("lte", 4, True), ("lte", 3, False)])
def test_counts(spark, operator, value, ok):
    asked = {"count_target": "猫", "count_value": value, "count_operator": operator}
    assert decided(spark, {"object_counts": [("狗", 9), ("小猫", 4), ("猫", 1)]}, **asked)["allowed"] == ok
    assert not decided(spark, {"objects": ["猫"]}, **asked)["allowed"]  # an unknown count


def test_modes(spark):
    for mode, weather, mood in (("soft", True, True), ("hybrid", False, True), ("hard", False, False)):
        assert decided(spark, {"attributes": ["weather:雪天"]}, mode, weather=["晴天"])["allowed"] == weather
        assert decided(spark, {"mood": ["忧伤"]}, mode, mood=["快乐"])["allowed"] == mood
    assert decided(spark, {}, "hard", mood=["快乐"])["allowed"]  # nothing is known of it


def test_parse(spark):
    said = ["避开任何小猫，找蓝色的餐厅", "找最多两只猫的室内", "招牌写着“营业中”", "都市夜色", "平静"]
    got = {r.query_id: r for r in parsing.parse(spark.createDataFrame(list(enumerate(said)), "query_id int, text string")).collect()}
    assert (got[0].query_type, got[0].excluded_terms, got[0].objects, got[0].colors, got[0].semantic_text) == ("negative", ["猫"], ["餐馆"], ["蓝色"], "找蓝色的餐厅")
    assert (got[1].query_type, got[1].count_target, got[1].count_value, got[1].count_operator, got[1].scene) == ("count", "猫", 2, "lte", ["室内"])
    assert (got[2].query_type, got[2].ocr_terms) == ("ocr", ["营业中"])
    assert (got[3].query_type, got[3].scene, got[3].time_of_day) == ("compositional", ["城市"], ["夜晚"])
    assert got[4].query_type == "simple"


def test_merged(spark):
    parsed = parsing.parse(spark.createDataFrame([(1, "平静的湖"), (2, "三只狗"), (3, "湖")], "query_id int, text string"))
    answers = {1: {"mood": "calm", "query_type": "compositional", "semantic_text": "still lake", "excluded_terms": ["船"], "count_target": "船", "count_value": 2}, 2: {"count_target": "猫", "count_value": 9, "style": ["film", "FILM"]}}
    a = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in answers.items()], "query_id int, answer string")
    got = {r.query_id: r for r in parsing.merged(parsed.join(a, "query_id", "left")).collect()}
    assert (got[1].mood, got[1].query_type, got[1].semantic_text, got[1].excluded_terms, got[1].count_value, got[1].backend) == (["calm"], "compositional", "still lake", [], 2, "generator")
    assert (got[2].count_target, got[2].count_value, got[2].style, got[2].query_type) == ("狗", 3, ["film"], "count")
    assert got[3].backend == "rules"


# --- lexical and dense -------------------------------------------------------------------------------------------

CORPUS = ["red kite over the hill", "the hill and the red barn and the hill", "barn swallows", "", "kite kite kite", "THE Red-Barn"]


def brute_bm25(texts, query, k1=1.5, b=0.75):
    docs = [[w.lower() for w in T.re.findall(r"[^\W_]+", t)] for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {w: sum(w in d for d in docs) for w in set(itertools.chain(*docs))}
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    return [round(sum(idf[w] * d.count(w) * (k1 + 1) / (d.count(w) + k1 * (1 - b + b * len(d) / avg)) for w in query.lower().split() if w in idf and d.count(w)), 6) for d in docs]


def test_bm25(spark, tmp_path):
    items = spark.createDataFrame(list(enumerate(CORPUS)), "item_id int, text string")
    asked = ["red kite", "barn barn hill", "nothing known", "the"]
    lexical.build(items, str(tmp_path))
    index = lexical.Index.load(spark, str(tmp_path))
    got = lexical.search(index, spark.createDataFrame(list(enumerate(asked)), "query_id int, text string"), 4).collect()
    for q, text in enumerate(asked):
        score = brute_bm25(CORPUS, text)
        want = sorted(range(len(CORPUS)), key=lambda k: (-score[k], k))[:4]
        mine = sorted((r.rank, r.item_id, r.score) for r in got if r.query_id == q)
        assert [i for _, i, _ in mine] == want and [s for *_, s in mine] == pytest.approx([score[k] for k in want])


def test_dense(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 3)
    monkeypatch.setattr(dense, "TILE", 2)
    rng = random.Random(3)
    vec = lambda: [float(rng.randint(-2, 2)) for _ in range(3)] + [1.0]  # noqa: E731  many ties
    items, asked = [(f"i{k}", vec()) for k in range(60)], [(k, vec()) for k in range(8)]
    schema = "item_id string, vector array<double>"
    given = spark.createDataFrame([*items], schema)
    dense.save(given, str(tmp_path / "v"), model="m")
    got = dense.search(dense.load(spark, str(tmp_path / "v"), "m").repartition(4), spark.createDataFrame(asked, "query_id int, vector array<double>"), 5).collect()
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b), 6)
    for q, v in asked:
        want = sorted(((-cos(v, x), i) for i, x in items))[:5]
        assert [(-r.score, r.item_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want
    with pytest.raises(ValueError, match="m"):
        dense.load(spark, str(tmp_path / "v"), "other")
    for bad in ([("a", [0.0, 0.0])], [("a", [1.0]), ("a", [1.0])], [("a", [1.0]), ("b", [1.0, 2.0]), ("c", [2.0])], []):
        with pytest.raises(ValueError):
            dense.save(spark.createDataFrame(bad, schema), str(tmp_path / "w"))
    with pytest.raises(Exception, match="dimensions"):
        dense.search(dense.prepared(given), spark.createDataFrame([(1, [1.0])], "query_id int, vector array<double>"), 2).collect()


# --- metrics -----------------------------------------------------------------------------------------------------


def test_metrics(spark):
    ranking = rows_of(spark, "1 d 1; 1 a 2; 1 x 3; 1 b 4; 2 y 1", "query_id int, item_id string, rank int")
    judged = rows_of(spark, "1 a 1; 1 b 2; 1 c 1; 1 d 0; 2 z 2; 3 z 1", "query_id int, item_id string, grade int")
    got = {r.query_id: r for r in metrics.per_query(ranking, judged, (1, 2, 4), 4).collect()}
    dcg = 1 / math.log2(3) + 3 / math.log2(5)
    ideal = 3 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    one = got[1]
    assert (one.recall_1, one.recall_2, one.recall_4, one.mrr) == (0, pytest.approx(1 / 3), pytest.approx(2 / 3), 0.5)
    assert one.ap == pytest.approx((1 / 2 + 2 / 4) / 3) and one.ndcg == pytest.approx(dcg / ideal)
    assert all(getattr(got[k], c) == 0 for k in (2, 3) for c in ("recall_4", "mrr", "ap", "ndcg"))
    variants = ranking.withColumn("variant", F.explode(F.array(F.lit("p"), F.lit("q")))).filter("variant = 'p' or query_id = 2")
    by = {r.variant: r for r in metrics.by_variant(variants, judged, (1,)).collect()}
    assert by["p"].n == by["q"].n == 3 and by["p"].mrr == pytest.approx(0.5 / 3) and by["q"].mrr == 0


def test_overlap(spark):
    a = rows_of(spark, "1 p 1; 1 q 2; 1 r 3; 2 p 1", "query_id int, item_id string, rank int")
    b = rows_of(spark, "1 r 1; 1 p 2; 1 s 3; 2 q 1; 2 r 2", "query_id int, item_id string, rank int")
    got = {r.query_id: (r.overlap, r.rank_shift) for r in metrics.overlap(a, b, 3).collect()}
    assert got == {1: (pytest.approx(2 / 3), 1.5), 2: (0, 2)}
    summary = metrics.overlap_summary(metrics.overlap(a, b, 3).withColumn("category", F.lit("k"))).filter("scope = 'overall'").first()
    assert summary.n == 2 and summary.rank_shift == 1.75


# --- reranking ---------------------------------------------------------------------------------------------------


def test_pointwise(spark):
    c = rows_of(spark, "1 a 0.04 1; 1 b 0.02 2; 1 c 0.03 3; 1 d 0.03 4; 2 a 0 1", "query_id int, item_id string, fused_score double, rank int")
    said = {"a": "fine: {\"score\": 20}", "b": '{"image_id": "b", "score": 250}', "c": '{"image_id": "d", "score": 90}', "d": "nothing"}
    answers = spark.createDataFrame([(q, i, t) for q in (1, 2) for i, t in said.items()], "query_id int, item_id string, answer string")
    got = {(r.query_id, r.item_id): r for r in rerank.pointwise(rerank.pointwise_answers(c, answers)).collect()}
    assert [got[1, k].rerank_score for k in "abcd"] == [20, 100, 0, 0]
    # what the scorer failed at keeps its part of the fused score, and ties go by id
    assert [got[1, k].combined for k in "abcd"] == pytest.approx([0.35 + 0.13, 0.175 + 0.65, 0.2625, 0.2625])
    assert [got[1, k].new_rank for k in "bacd"] == [1, 2, 3, 4] and got[1, "a"].mismatch == []
    assert got[1, "c"].mismatch == ["rerank failed: names d"] and got[1, "d"].mismatch == ["rerank failed: no JSON object"]
    assert got[2, "a"].combined == pytest.approx(0.13)  # a best score of 0


def test_listwise(spark):
    c = rows_of(spark, "; ".join(f"{q} im-{k} {k}" for q in range(1, 6) for k in (1, 2, 3, 4)), "query_id int, item_id string, rank int")
    said = ['Here: {"ranking": ["04", {"image_id": "im-2", "score": 130}, 4]}', '{"ranking": ["im-1", "im-9"]}', '{"ranking": [{"image_id": "im-1", "score": "high"}]}', '{"ranking": []}', '{"ranking": [2, 1, 4, 3]}']
    got = {(r.query_id, r.item_id): r for r in rerank.listwise(c, spark.createDataFrame([(k + 1, t) for k, t in enumerate(said)], "query_id int, answer string")).collect()}
    assert [got[1, f"im-{k}"].new_rank for k in (4, 2, 1, 3)] == [1, 2, 3, 4] and got[1, "im-1"].degraded
    assert [got[1, f"im-{k}"].score for k in (4, 2, 1, 3)] == [100, 100, 0, 0]
    for q in (2, 3, 4):
        assert [(got[q, f"im-{k}"].new_rank, got[q, f"im-{k}"].score) for k in (1, 2, 3, 4)] == [(k, 0) for k in (1, 2, 3, 4)] and got[q, "im-1"].error
    assert [got[5, f"im-{k}"].score for k in (2, 1, 4, 3)] == pytest.approx([100, 200 / 3, 100 / 3, 0]) and not got[5, "im-1"].degraded


def test_benchmarks(spark):
    runs = spark.createDataFrame([(1, "q", "c", 3, 10.0, True, 5, 1, False), (2, "q", "c", 3, 30.0, True, None, 1, True), (3, "p", "d", 5, 99.0, False, 9, 2, False)], "run int, query_id string, category string, top_k int, latency_ms double, success boolean, peak_bytes long, repeat int, degraded boolean")
    suite = {(r.scope, r.group): r for r in rerank.latency_suite(runs).collect()}
    assert suite["phase", "cold"].mean == 10 and suite["phase", "warm"].failures == 1 and suite["overall", "all"].p50 == 20 and suite["overall", "all"].peak_bytes == 9
    assert suite["category", "d"].mean is None and suite["top_k", "5"].failure_rate == 1
    b = rerank.benchmark(runs.withColumn("method", F.lit("m"))).first()
    assert (b.runs, b.failures, b.degraded, b.total_ms, b.repeat_total_ms, b.peak_bytes) == (3, 1, 1, 139, [40, 99], 9)
    sizes = spark.range(1).select(rerank.image_size(F.lit(4000), F.lit(1000), 1_000_000).alias("i"), rerank.sheet_size(F.lit(7)).alias("s")).first()
    assert tuple(sizes.i) == (2000, 500) and tuple(sizes.s) == (2, 960, 384)


# --- manifests ---------------------------------------------------------------------------------------------------


def test_duplicates(spark):
    m = manifest.mark_duplicates(spark.createDataFrame([(f"n{k:03}", "one" if k % 3 else f"own{k}") for k in range(200)] + [("null", None)], "item_id string, sha256 string"))
    got = {r.item_id: r.duplicate_of for r in m.collect()}
    assert got == {f"n{k:03}": "n001" if k % 3 and k != 1 else None for k in range(200)} | {"null": None}
    x = spark.createDataFrame([("a", "h", "Val"), ("b", "h", "Train"), ("c", "h", "Train"), ("d", "k", "Val")], "item_id string, sha256 string, split string")
    crossed = manifest.mark_across(x, F.when(F.col("split") == "Train", 0).otherwise(1))
    assert {r.item_id: r.duplicate_of for r in crossed.collect()} == {"a": "b", "b": None, "c": "b", "d": None}


def test_reconcile_and_import(spark):
    a, b = rows_of(spark, "p 1; q 2; r 3", "item_id string, v int"), rows_of(spark, "q 2; r 4; s 5", "item_id string, v int")
    assert {r.item_id: r.status for r in manifest.reconcile(a, b, ("v",)).collect()} == {"p": "missing", "q": "matched", "r": "mismatched", "s": "extra"}
    raw = rows_of(spark, "x7 1; y07 2; z8 3; w 4", "raw_id string, line int")
    good, bad = manifest.imported(raw, spark.createDataFrame([("val-7",), ("val-9",)], "item_id string"))
    assert [(r.raw_id, r.item_id) for r in good.collect()] == [("x7", "val-7")]
    assert {(r.raw_id, r.error) for r in bad.collect()} == {("y07", "repeated"), ("z8", "not in manifest"), ("w", "not in manifest")}
    with pytest.raises(ValueError, match="ambiguous"):
        manifest.imported(raw, spark.createDataFrame([("a-7",), ("b-7",)], "item_id string"))


def test_order_and_choice(spark):
    ids = ["v-10", "v-9", "v-100", "u-3", "w"]
    placed = manifest.placed(manifest.in_id_order(spark.createDataFrame([(i,) for i in ids * 1], "item_id string").repartition(4)))
    assert {r.item_id: r.place for r in placed.collect()} == {"u-3": 1, "v-9": 2, "v-10": 3, "v-100": 4, "w": 5}
    c = rows_of(spark, "; ".join(f"{q} i{k} {k}" for q in range(1, 5) for k in range(1, 6)), "query_id int, item_id string, rank int")
    asked = rows_of(spark, "1 i4 1; 1 i2 2; 1 i4 3; 2 nope 1; 3 i1 1", "query_id int, item_id string, place int")
    taken, errors = manifest.chosen(c, asked, 2, 3)
    assert sorted((r.query_id, r.place, r.item_id) for r in taken.collect()) == [(1, 1, "i4"), (1, 2, "i2"), (4, 1, "i1"), (4, 2, "i2"), (4, 3, "i3")]
    assert sorted(r.query_id for r in errors.collect()) == [2, 3]
    assert manifest.index_errors({"count": 1, "branches": {"bm25": 1}}, {"count": 2}, ["image"]) == ["count differs", "branches not built: ['image']"]


def test_dealt_join(spark):
    many = spark.range(500).select(F.col("id").alias("n"), (F.col("id") % 2).alias("k"))
    got = skew.dealt_join(many, spark.createDataFrame([(0, "zero")], "k long, name string"), ["k"], "n")
    assert got.count() == 500 and got.filter("name = 'zero' and k = 0").count() == 250 and got.filter("k = 1 and name is null").count() == 250


# --- adapters ----------------------------------------------------------------------------------------------------


def test_adapters(spark):
    flat = {"summary": "boat", "objects": ["boat"], "object_counts": {"boat": 2}}
    nested = {"caption_short": "yard", "scene": "farm", "objects": [{"name": "hen", "count": 5, "attrs": {"size": "small"}}, "HEN"], "persons": {"count": 0, "attire": "coat"}, "ocr": ["EGGS", {"text": "eggs"}], "style": ["film", "Film"]}
    canonical = {
        "image_id": "12", "processed_sha256": "s",
        "annotation": {"captions": {"dense_zh": "桥"}, "entities": [{"entity_id": "1", "name_zh": "桥", "count": 1, "count_exact": True, "salience": "high", "attributes": {"colors_zh": ["Gray", "木色"], "states_zh": ["湿"]}}, {"entity_id": "2", "name_zh": "船", "count": 4, "count_exact": False}],
        "relations": [{"subject_id": "2", "predicate": "under", "object_id": "1"}, {"subject_id": "2", "predicate": "moored", "predicate_other_zh": "系在", "object_id": "7"}], "capture_visual": {"weather": "fog", "angle": "low"},
        "scene": {"primary_type": "nature", "secondary_types": ["transport"], "media_type": "illustration"}, "event": {"summary_zh": "渡河"}, "uncertainties": [{"field_path": "ocr", "reason": "blur", "note_zh": ""}], "subjective": {"mood_terms_zh": "安静"}, "ocr": [{"text_raw": "止"}]},
    }
    rows = [("a-1", flat), ("a-2", nested), ("a-12", canonical), ("a-13", canonical), ("a-14", {"caption_short": " "}), ("a-15", {"objects": []}), ("b-12", canonical | {"processed_sha256": "t"}), ("gone", flat)]
    given = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in rows] + [("cut", "{")], "item_id string, payload string")
    good, bad = adapters.adapt(given, given.filter("item_id <> 'gone'").select("item_id", F.lit("s").alias("sha256")))
    got = {r.item_id: r for r in good.collect()}
    assert {r.item_id: r.error for r in bad.collect()} == {"a-13": "another item", "a-14": "no caption", "a-15": "unknown shape", "b-12": "another file", "gone": "not in manifest", "cut": "not JSON"}
    counts = lambda r: [(c["name"], c["count"]) for c in r.object_counts]
    assert counts(got["a-1"]) == [("boat", 2)] and got["a-1"].summary == "boat"
    n = got["a-2"]
    assert (n.objects, counts(n), n.scene, n.ocr_text, n.style) == (["hen"], [("hen", 5), ("人物", 0)], "farm", ["EGGS"], ["film"])
    assert n.attributes == ["count:hen=5", "size:small", "count:人物=0", "person_attire:coat"] and n.search_queries == ["yard", "farm", "yard"]
    c = got["a-12"]
    assert (c.objects, counts(c), c.spatial_relations) == (["桥", "船"], [("桥", 1)], ["船位于下面桥", "船系在未知实体"])
    assert c.attributes == ["salience:桥=high", "states_zh:桥=湿", "weather:雾天", "weather_code:fog", "angle:low", "scene_primary_type:nature", "scene_media_type:illustration", "scene_secondary:transport"]
    assert (c.scene, c.colors, c.actions, c.style, c.uncertainty, c.mood) == ("自然风景 交通出行", ["灰色", "木色"], ["渡河"], ["插画"], ["ocr | blur"], ["安静"])
    assert c.search_queries == ["桥", "桥 船 自然风景 交通出行 安静 灰色 木色 止", "自然风景 交通出行"]


# --- routing, stories, sets --------------------------------------------------------------------------------------


def test_routing(spark):
    prompts = spark.createDataFrame([("wet", 0, [2.0, 0.0]), ("wet", 0, [1.0, 1.0]), ("dry", 1, [0.0, -3.0])], "category string, ordinal int, vector array<double>")
    items = spark.createDataFrame([("a", [5.0, 1.0]), ("b", [0.0, -1.0]), ("c", [0.0, 0.0])], "item_id string, vector array<double>")
    routed = routing.route(items, routing.centroids(prompts), 2, digits=4)
    got = {(r.item_id, r.place): (r.category, r.score) for r in routed.collect()}
    wet = [(1 + math.sqrt(0.5)) / 2, math.sqrt(0.5) / 2]
    assert got["a", 1] == ("wet", round((5 * wet[0] + wet[1]) / math.hypot(*wet) / math.sqrt(26), 4)) and got["b", 1] == ("dry", 1) and len(got) == 4
    said = {r.item_id: r.prompt for r in routing.prompts_for(items, routed, {"dry": "Name the dust."}, "Describe.").collect()}
    assert said == {"a": "Describe.", "b": "Describe.\nName the dust.", "c": "Describe."}


def brute_story(items):
    out = []
    for bucket in sorted({b for _, _, b, _ in items}):
        left = sorted([i for i in items if i[2] == bucket], key=lambda i: i[1])
        here = left.pop(0)
        out.append(here[0])
        while left:
            alike = lambda i: len(set(i[3]) & set(here[3])) / max(1, len(set(i[3]) | set(here[3])))  # noqa: E731, B023
            here = max(left, key=lambda i: (alike(i), -i[1]))
            left.remove(here)
            out.append(here[0])
    return out


def test_story_order_by_brute_force(spark):
    rng = random.Random(5)
    stories = {s: [(f"{s}-{k}", k, rng.randint(0, 2), [f"f{x}" for x in rng.sample(range(6), rng.randint(0, 3))]) for k in range(rng.randint(2, 9))] for s in range(40)}
    rows = [(s, *i) for s, items in stories.items() for i in items]
    got = {}
    for r in story.order(spark.createDataFrame(rows, "story_id int, item_id string, position int, bucket int, features array<string>")).orderBy("place").collect():
        got.setdefault(r.story_id, []).append(r.item_id)
    assert got == {s: brute_story(items) for s, items in stories.items() if 3 <= len(items) <= 8}


def test_gaps_and_sections(spark):
    rows = [("s", "a", 1, "pier", 0, ["sea"]), ("s", "b", 2, "pier", 3, ["sea"]), ("s", "c", 3, "mill", 3, ["wheat"]), ("s", "d", 4, "barn", 4, ["hay"])]
    ordered = spark.createDataFrame(rows, "story_id string, item_id string, place int, scene string, bucket int, features array<string>")
    gaps = story.gaps(ordered, most=2)
    assert [(r.after_item_id, r.before_item_id) for r in gaps.orderBy("gap").collect()] == [("a", "b"), ("b", "c")]
    assert [s["gap"] for s in story.written(ordered, gaps).first().sections] == [1, 2, None, None]
    made = story.filled(gaps, lambda df: df.filter("gap = 1").select("story_id", "gap", F.concat(F.lit("pic"), F.col("seed").cast("string")).alias("generated"), F.lit(None).cast("string").alias("error")), seed=40)
    assert [(r.status, r.generated, r.error) for r in made.orderBy("gap").collect()] == [("generated", "pic40", None), ("failed", None, "nothing was generated")]


def test_judgments(spark):
    text = spark.createDataFrame([(1, "p : 2；q:0; p:1\nr：1;s:3")], "query_id int, judgments string")
    got = sorted((r.item_id or "", r.relevance or 0, r.error or "") for r in judging.parse_judgments(text).collect())
    assert got == [("", 0, "form"), ("p", 1, "repeated"), ("p", 2, ""), ("r", 1, "")]
    back = judging.format_judgments(judging.parse_judgments(text).filter("error is null")).first()
    assert back.judgments == "p:2\nr:1"


def test_refusals(spark):
    q = spark.createDataFrame([(1, "x", "c", True), (2, " ", "c", True), (3, "x", "auto_seed", True), (4, "x", "c", None), (5, "x", "c", True)], "query_id int, text string, category string, reviewed boolean")
    j = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "query_id int")
    with pytest.raises(ValueError, match=r"\[2, 3, 4\]"):
        judging.refuse(q, j)
    with pytest.raises(ValueError, match=r"without judgments: \[5\]"):
        judging.refuse(q.filter("query_id in (1, 5)"), j)
    with pytest.raises(ValueError, match=r"repeated: \[1\]"):
        judging.refuse(q.filter("query_id = 1").unionByName(q.filter("query_id = 1")), j)
    with pytest.raises(ValueError, match="no queries"):
        judging.refuse(q.filter("false"), j)
    judging.refuse(q.filter("query_id = 1"), j)


def test_sample_by_brute_force(spark):
    items = spark.range(300).select(F.col("id").alias("item_id"))
    hashed = sorted((r.h, r.item_id) for r in items.select("item_id", F.xxhash64(F.lit(7), "item_id").alias("h")).collect())
    assert [r.item_id for r in judging.sample(items, 40).collect()] == sorted(i for _, i in hashed[:40])
    assert judging.sample(items.repartition(7), 40).collect() == judging.sample(items, 40).collect()


@pytest.mark.parametrize("ring", [3, 50_000])
def test_training_pairs(spark, monkeypatch, ring):
    monkeypatch.setattr(judging, "RING_ROWS", ring)
    rows = [(f"t{k}", "alone" if k == 0 else "ab"[k % 2], ["first", "second"], f"doc {k}") for k in range(31)]
    a = spark.createDataFrame(rows, "item_id string, scene string, queries array<string>, document string")
    pairs = judging.training_pairs(a.drop("document")).collect()
    scene = {r[0]: r[1] for r in rows}
    assert len(pairs) == 62 and all(p.item_id != p.negative_item_id for p in pairs)
    assert all((p.negative_kind == "hard") == (p.query == "first" and p.item_id != "t0") for p in pairs)
    assert all(scene[p.item_id] == scene[p.negative_item_id] for p in pairs if p.negative_kind == "hard")
    for kind, query in (("hard", "first"), ("random", "second")):  # a ring: every item is a negative once
        picked = [p.negative_item_id for p in pairs if p.query == query and p.negative_kind == kind]
        assert len(set(picked)) == len(picked)
    triple = judging.training_triples(judging.training_pairs(a.drop("document")), a.select("item_id", "document")).first()
    assert triple.positive == "doc " + triple.item_id[1:] and triple.negative == "doc " + triple.negative_item_id[1:]
    with pytest.raises(ValueError, match="Train"):
        judging.training_pairs(a.withColumn("split", F.lit("Val")))


def test_delivery(spark):
    rows = [(q, f"i{k:02}", 1.0 / k, k) for q in (1, 2) for k in range(1, 22 if q == 1 else 11)]
    fused = spark.createDataFrame(rows, "query_id int, item_id string, fused_score double, rank int")
    with pytest.raises(ValueError, match=r"\[2\]"):
        delivery.full_batches(fused)
    full = delivery.full_batches(fused.filter("query_id = 1"))
    shaped = full.withColumns({"query": F.lit("x"), "category": F.lit("c"), "relative_path": F.concat(F.lit("val/"), "item_id", F.lit(".jpg")), "branch_scores": F.create_map(F.lit("bm25"), F.lit(0.5)), "branch_ranks": F.create_map(F.lit("bm25"), F.col("rank")), "matched_fields": F.array().cast("array<string>")})
    header = {"split": "val", "fusion_method": "rrf", "annotation_version": "v", "index_manifest_sha256": "a", "config_sha256": "b"}
    lines = delivery.lines(shaped, header)
    batch = json.loads(lines.first().value)
    assert len(batch["candidates"]) == 20 and [c["rank"] for c in batch["candidates"]] == list(range(1, 21)) and batch["query_id"] == 1
    items = spark.createDataFrame([(f"i{k:02}", f"val/i{k:02}.jpg", "s") for k in range(1, 22)], "image_id string, relative_path string, sha256 string")
    expected = {"index_manifest_sha256": "a", "config_sha256": "b", "annotation_version": "v"}
    assert delivery.validate(lines.select(F.lit(1).alias("line"), "value"), items, expected, {"val": "val"}).count() == 0
