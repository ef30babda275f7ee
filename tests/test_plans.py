"""Searches, indexes, generators, the service and the jobs, end to end on small tables."""

import json
import re

import pytest
from pyspark.sql import functions as F
from test_operators import ann

from heliograph import jobs
from heliograph.functions.vectors import l2_normalize
from heliograph.operators import documents
from heliograph.plans import evaluation, generation, indexing
from heliograph.plans.search import Searcher
from heliograph.plans.service import Service, Settings
from heliograph.sources import tables

ITEMS = [
    {"item_id": "p1", "summary": "猫 on a red wall", "objects": ["猫"], "scene": "街道", "colors": ["红色"]},
    {"item_id": "p2", "summary": "wall at night", "objects": ["建筑"], "scene": "街道", "attributes": ["time_of_day:夜晚"]},
    {"item_id": "p3", "summary": "two 猫 in a room", "objects": ["小猫"], "object_counts": [("猫", 2)], "scene": "室内"},
    {"item_id": "p4", "summary": "empty room", "scene": "室内", "attributes": ["time_of_day:白天"]},
    {"item_id": "p5", "summary": "red boat", "objects": ["船"], "colors": ["红色"], "ocr_text": ["SEA"]},
]


def ranking(spark, text):
    rows = [("q", i, 1.0 / k, k) for k, i in enumerate(text.split(), 1)]
    table = spark.createDataFrame(rows, "query_id string, item_id string, score double, rank int")
    return lambda q, k: table.filter(F.col("rank") <= k)


def broken(q, k):
    raise RuntimeError("no such index")


def late(q, k):
    """Planned without complaint, fails when it runs."""
    return q.select("query_id", F.raise_error(F.lit("died")).cast("string").alias("item_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))


def asked(spark, **slots):
    q = spark.createDataFrame([("q", "find")], "query_id string, text string")
    for k, v in slots.items():
        q = q.withColumn(k, F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))
    return q


def test_filters_come_after_recall_and_ranks_are_counted_anew(spark):
    a = ann(spark, *ITEMS).withColumn("relative_path", F.concat(F.lit("val/"), "item_id"))
    s = Searcher(a, {"bm25": ranking(spark, "p1 p2 gone p3 p1 p5"), "text": ranking(spark, "p3 p5")})
    got = {r.item_id: r for r in s.search(asked(spark, excluded_terms=["建筑"], colors=["红色"]), 4, 10).collect()}
    assert {k: v.branch_ranks for k, v in got.items()} == {"p1": {"bm25": 1}, "p3": {"bm25": 2, "text": 1}, "p5": {"text": 2}}
    assert [k for k in sorted(got, key=lambda k: got[k].rank)] == ["p3", "p1", "p5"] and got["p1"].relative_path == "val/p1"
    assert got["p1"].evidence == ["colors:红色"] and got["p1"].active_branches == ["text", "bm25"] and got["p3"].matched_fields == []
    assert s.search(asked(spark), 0, 5).count() == 0 and s.search(asked(spark), 5, -1).count() == 0


def test_failed_branches_are_left_out(spark):
    a = ann(spark, *ITEMS)
    branches = {"image": broken, "bm25": ranking(spark, "p1 p2"), "text": late}
    s = Searcher(a, branches, method="weighted", weights={"image": 5, "bm25": 2}, keep=tables.kept)
    got = s.search(asked(spark)).collect()
    assert {r.item_id for r in got} == {"p1", "p2"} and set(s.errors) == {"image", "text"} and "died" in s.errors["text"]
    assert all(r.active_branches == ["bm25"] for r in got) and max(r.fused_score for r in got) == 1
    with pytest.raises(RuntimeError, match="all retrieval branches failed"):
        Searcher(a, {"image": broken}).search(asked(spark))
    with pytest.raises(ValueError):
        Searcher(a, branches, method="other")


def test_recall_is_by_the_query_document(spark):
    seen = []

    def branch(q, k):
        seen.append(q.first()["text"])
        return ranking(spark, "p1")(q, k)

    Searcher(ann(spark, *ITEMS), {"bm25": branch}).search(asked(spark, objects=["猫"], count_target="猫", count_value=2).withColumn("semantic_text", F.lit("cats")))
    assert seen == ["cats 主体:猫 数量:猫:eq:2"]


def test_fallback_and_ablation(spark):
    a = ann(spark, *ITEMS)
    s = Searcher(a, {"image": ranking(spark, "p4 p2 p1"), "bm25": ranking(spark, "p2 p3")}, keep=tables.kept)
    q = asked(spark, time_of_day=["夜晚"])
    assert {r.item_id for r in s.search(q, 10, 3).collect()} == {"p1", "p2", "p3"}  # p4 is known to be by day
    assert {(r.item_id, r.mode) for r in s.with_fallback(q, 10, 4).collect()} == {(k, "soft") for k in ("p1", "p2", "p3", "p4")}
    assert {r.mode for r in s.with_fallback(q, 10, 3).collect()} == {"hybrid"}
    queries = q.withColumns({"category": F.lit("c"), "reviewed": F.lit(True)})
    judged = spark.createDataFrame([("q", "p2", 2), ("q", "p3", 1)], "query_id string, item_id string, grade int")
    got = {r.variant: r for r in evaluation.ablation(s, queries, judged, {"image": 1, "bm25": 3}, 10, 5).collect()}
    assert set(got) == {"image", "bm25", "rrf", "weighted"} and got["bm25"].recall_5 == 1 and got["image"].recall_5 == 0.5 and got["bm25"].ndcg == 1
    assert got["rrf"].branches == "image,bm25" and got["weighted"].fusion_method == "weighted"
    per, summary = evaluation.compared_fusion(s, queries, {"bm25": 2})
    assert per.first().overlap == 1 and summary.filter("scope = 'overall'").first().n == 1


def test_evaluate(spark):
    queries = spark.createDataFrame([(1, "x", "a", True), (2, "y", "b", True)], "query_id int, text string, category string, reviewed boolean")
    judged = spark.createDataFrame([(1, "p", 1), (2, "p", 1)], "query_id int, item_id string, grade int")
    found = spark.createDataFrame([(1, "p", 1), (2, "p", 1)], "query_id int, item_id string, rank int")
    runs = spark.createDataFrame([(1, 0.5, True), (2, 1.5, False)], "query_id int, latency double, success boolean")
    details, summary = evaluation.evaluate(found, queries, judged, runs)
    assert {r.query_id: r.mrr for r in details.collect()} == {1: 1, 2: 0}
    overall = summary.filter("scope = 'overall'").first()
    assert (overall.mrr, overall.latency_p50, overall.failures) == (0.5, 1.0, 1)
    with pytest.raises(ValueError, match="without judgments"):
        evaluation.evaluate(found, queries, judged.filter("query_id = 1"))


def test_compared_encoders(spark):
    runs, overlap = evaluation.compared_encoders({"one": ranking(spark, "p1 p2 p3"), "two": ranking(spark, "p2 p1 p4")}, asked(spark), 3)
    assert [r["encoder"] for r in runs] == ["one", "two"] and all(r["warm_seconds"] > 0 and r["queries"] == 1 for r in runs)
    assert {r.encoder: (round(r.overlap, 3), r.rank_shift) for r in overlap.collect()} == {"one": (1, 0), "two": (0.667, 1)}


def test_hybrid_search_reads_documents_once(spark):
    from heliograph.plans import catalogue

    sf = "/root/testdata/sf0.001"
    found = catalogue.queries()["hybrid_search"](spark, sf)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    reads = [line for line in plan.splitlines() if re.search(r"Relation \[.*\] parquet", line)]
    assert sum("lang#" in line for line in reads) == 1 and len(reads) <= 16 and "Join Cross" not in plan.replace("broadcast", "")


# --- indexes and jobs --------------------------------------------------------------------------------------------


def vectors(spark, ids):
    rows = [(i, [float(k == n) + 0.1 for n in range(64)]) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "item_id string, vector array<double>")


def test_indexes(spark, tmp_path):
    a, path = ann(spark, *ITEMS), str(tmp_path / "ix")
    with pytest.raises(ValueError, match="no vectors"):
        indexing.build(a, path)
    told = indexing.build(a, path, text=vectors(spark, ["p1", "p2", "p3", "p4", "other"]), version="v1", allow_missing=True)
    assert told["branches"] == {"text": 4, "bm25": 5} and set(told["failed"]) == {"image"} and told["count"] == 5
    assert indexing.errors(spark, path, a, ["text"], version="v1") == []
    assert indexing.errors(spark, path, a.limit(4), ["image"], version="v2") == ["count differs", "digest differs", "annotation_version differs", "branches not built: ['image']"]
    encode = {"text": lambda q: q.select("query_id", F.array(*map(F.lit, [float(n == 2) for n in range(64)])).alias("vector"))}
    branches = indexing.load(spark, path, encode)
    q = spark.createDataFrame([("q", "night wall")], "query_id string, text string")
    best = {name: search(q, 1).first().item_id for name, search in branches.items()}
    assert best == {"text": "p3", "bm25": "p2"}
    assert indexing.load(spark, path, encode, width=32)["text"](q, 2).count() == 2
    with pytest.raises(ValueError, match="image"):
        indexing.load(spark, path, encode, ["image"])
    with pytest.raises(ValueError, match="repeated"):
        indexing.build(a.unionByName(a.limit(1)), path)


def test_jobs(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    many = [{"item_id": f"m{k:02}", "summary": f"boat {k}", "objects": ["船"]} for k in range(25)]
    a = ann(spark, *many).withColumns({"relative_path": F.concat(F.lit("val/"), "item_id"), "search_queries": F.array("summary", F.lit("sea")), "document": F.col("summary")})
    a.write.parquet(at("a"))
    vectors(spark, ["m00", "m01"]).write.parquet(at("v"))
    jobs.main(["index", "--annotations", at("a"), "--indexes", at("ix"), "--text-vectors", at("v"), "--allow-missing-branches"], spark)
    common = ["--annotations", at("a"), "--indexes", at("ix"), "--results", "5"]
    jobs.main(["search", *common, "--query", "boat 7", "--out", at("found")], spark)
    assert spark.read.parquet(at("found")).filter("rank = 1").first().item_id == "m07"
    jobs.main(["smoke", *common, "--query", "boat", "--branch", "bm25"], spark)
    with pytest.raises(SystemExit, match="image"):
        jobs.main(["smoke", *common, "--query", "boat", "--branch", "image"], spark)
    spark.createDataFrame([("q1", "boat 3", "c", True)], "query_id string, text string, category string, reviewed boolean").write.parquet(at("q"))
    (tmp_path / "j.csv").write_text("query_id,image_id,relevance\nq1,m03,2\n")
    jobs.main(["evaluate", *common, "--queries", at("q"), "--judgments", at("j.csv"), "--out", at("e")], spark)
    assert spark.read.json(at("e/summary_json")).filter("scope = 'overall'").first().mrr == 1
    jobs.main(["ablate", *common, "--queries", at("q"), "--judgments", at("j.csv"), "--out", at("ab")], spark)
    assert {r.variant for r in spark.read.json(at("ab/json")).collect()} == {"bm25", "rrf", "weighted"}
    jobs.main(["compare", *common, "--queries", at("q"), "--out", at("c")], spark)
    jobs.main(["deliver", *common, "--queries", at("q"), "--out", at("d")], spark)
    assert len(json.loads(spark.read.text(at("d/batches")).first().value)["candidates"]) == 20
    jobs.main(["parse", "--query", "两只猫", "--out", at("parsed")], spark)
    assert spark.read.json(at("parsed")).first().count_target == "猫"
    jobs.main(["pairs", "--annotations", at("a"), "--out", at("p")], spark)
    assert spark.read.parquet(at("p")).count() == 50
    jobs.main(["sample", "--annotations", at("a"), "--n", "4", "--out", at("s")], spark)
    with pytest.raises(SystemExit, match="--force"):
        jobs.main(["sample", "--annotations", at("a"), "--n", "4", "--out", at("s")], spark)


# --- generators and the service ----------------------------------------------------------------------------------


def says(answers, again=None):
    """A generator that answers by id, and otherwise after a repaired prompt."""

    def generate(rows):
        first = F.create_map(*[F.lit(x) for kv in answers.items() for x in kv])[F.col(rows.columns[0])]
        second = F.when(F.contains("prompt", F.lit(generation.AGAIN)), F.lit(again)) if again else F.lit(None).cast("string")
        return rows.withColumns({"raw": F.coalesce(second, first), "error": F.when(F.coalesce(second, first).isNull(), "timeout")})

    return generate


def test_annotated(spark):
    items = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False)], "item_id string, valid boolean")
    good = '{"summary": "s", "search_queries": ["1", "2", "3"]}'
    done, bad = generation.annotated(items, "describe", says({"a": "so: " + good, "b": '{"summary": ""}', "c": '{"summary": "s", "search_queries": []}'}), "v2", retries=1)
    assert [(r.item_id, r.attempts, r.prompt_version) for r in done.collect()] == [("a", 1, "v2")]
    assert {r.item_id: (r.error, r.attempts) for r in bad.collect()} == {"b": ("no summary", 2), "c": ("fewer than three search queries", 2)}
    done, bad = generation.annotated(items, "describe", says({"a": good}, again=good), "v2", retries=2)
    assert {r.item_id: r.attempts for r in done.collect()} == {"a": 1, "b": 2, "c": 2} and bad.count() == 0


def test_parsed_with(spark):
    service = Service(Searcher(ann(spark, *ITEMS), {"bm25": ranking(spark, "p1")}), generate=says({1: '{"mood": ["calm"]}', 2: '{"query_type": "odd"}', 3: "prose"}))
    got = {r.query_id: r for r in service.parse(spark.createDataFrame([(1, "湖"), (2, "湖"), (3, "湖"), (4, "湖")], "query_id int, text string")).collect()}
    assert {k: (r.backend, r.error) for k, r in got.items()} == {1: ("generator", None), 2: ("rules_fallback", "query_type"), 3: ("rules_fallback", "no JSON object"), 4: ("rules_fallback", "timeout")}
    assert got[1].mood == ["calm"] and got[2].query_type == "simple"


def test_prompts(spark):
    requests = spark.createDataFrame([(1, "a long walk through an old town", None), (2, "sea", "c")], "request_id int, query string, context string")
    got = {r.request_id: r for r in generation.picture_prompts(requests, "t", says({1: "no", 2: '{"positive_prompt": "waves", "negative_prompt": "text"}'})).collect()}
    assert got[1].source == "fallback" and got[1].positive_prompt.endswith("a long walk through an o") and (got[2].positive_prompt, got[2].source) == ("waves", "generator")
    each = generation.compared_prompts(spark.createDataFrame([("a",), ("b",)], "item_id string"), {"x": "X", "y": "Y"}, says({"a": "A"}))
    assert {(r.item_id, r.name, r.raw, r.error) for r in each.collect()} == {("a", "x", "A", None), ("a", "y", "A", None), ("b", "x", None, "timeout"), ("b", "y", None, "timeout")}


def test_service(spark):
    searcher = Searcher(ann(spark, *ITEMS), {"bm25": ranking(spark, "p1 p2 p3 p4 p5")})
    q = spark.createDataFrame([("q", "red")], "query_id string, text string")
    scores = {"p1": 10, "p3": 100}
    scorer = lambda c: c.select("query_id", "item_id", F.to_json(F.struct(F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])[F.col("item_id")].alias("score"))).alias("answer"))
    found = Service(searcher, Settings(result_count=2), scorer).search(q, reranked=True).orderBy("rank").collect()
    assert [(r.item_id, r.rerank_score) for r in found] == [("p3", 100), ("p1", 10)]
    listwise = Service(searcher, Settings(rerank_method="listwise", result_count=3), lambda c: c.select("query_id", F.lit('{"ranking": [5, 4, 3, 2, 1]}').alias("answer")).distinct())
    assert [r.item_id for r in listwise.search(q, reranked=True).orderBy("rank").collect()] == ["p5", "p4", "p3"]
    with pytest.raises(ValueError, match="scorer"):
        Service(searcher).search(q, reranked=True)
    with pytest.raises(ValueError, match="rerank_method"):
        Settings(rerank_method="x")

    service, candidates = Service(searcher), Service(searcher).search(q)
    pick = lambda *ids: spark.createDataFrame([("q", i, k) for k, i in enumerate(ids)], "query_id string, item_id string, place int")
    evidence = lambda t: t.select("query_id", "item_id", (F.col("item_id") != "p2").alias("relevant"), F.array(F.concat(F.lit("fact "), "item_id")).alias("facts"))
    answers, errors = service.answer(candidates, pick("p5", "p2"), evidence, 2)
    assert answers.first().answer == "fact p5[img_p5]" and not answers.first().refused and errors.count() == 0
    _, errors = service.answer(candidates, pick("p1", "p2", "p3"), evidence, 2)
    assert "1 to 2" in errors.first().error
    with pytest.raises(ValueError, match="1 to 3"):
        service.answer(candidates, pick("p1"), evidence, 4)
    stories, gaps, errors = service.stories(candidates, pick("p4", "p2", "p3"))
    assert [s["item_id"] for s in stories.first().sections] == ["p3", "p4", "p2"] or [s["item_id"] for s in stories.first().sections][-1] in ("p2", "p3")
    assert errors.count() == 0 and service.stories(candidates, pick("p1", "zz", "p2"))[2].first().error == "not among the candidates"


def test_placeholders(spark):
    from heliograph.operators.filters import decide

    a = documents.placeholders(spark.createDataFrame([("x",)], "item_id string"))
    n = documents.normalized_fields(documents.fields(a)).withColumn("objects_", F.lit(1)).select("item_id", "f", "n", "object_counts", F.array(F.lit("猫")).alias("objects"))
    assert decide(n).first().allowed and a.select(l2_normalize(F.array(F.lit(0.0)))).first()[0] is None
