"""Scores below zero, answers that are no numbers, digests of deliveries, tasks for people."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F
from test_operators import ann

import __spark_entry__
from heliograph import jobs
from heliograph.operators import judging, lexical, rerank
from heliograph.plans import answers
from heliograph.plans.search import Searcher


def test_items_without_a_term_come_before_those_with_negative_scores(spark, tmp_path):
    docs = spark.createDataFrame([(k, "x") for k in range(1, 21)] + [(k, "") for k in range(21, 31)], "item_id int, text string")
    index = lexical.build(docs, f"{tmp_path}/i")
    asked = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x x")], "query_id int, text string")
    got = {}
    for r in lexical.search(index, asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.item_id, r.score))
    assert got == {1: [(k, 0.0) for k in range(21, 26)], 2: [(k, 0.0) for k in range(1, 6)], 3: [(k, 0.0) for k in range(21, 26)]}
    deep = [(r.item_id, r.score) for r in lexical.search(index, asked.filter("query_id = 1"), 12).orderBy("rank").collect()]
    assert [i for i, _ in deep] == [*range(21, 31), 1, 2] and deep[-1][1] < 0


def test_no_number_is_no_score(spark):
    c = spark.createDataFrame([(1, i, 0.1, k) for k, i in enumerate("abcd", 1)], "query_id int, item_id string, fused_score double, rank int")
    said = {"a": '{"score": "NaN"}', "b": '{"score": NaN}', "c": '{"score": "-Infinity"}', "d": '{"score": "Infinity"}'}
    answers = spark.createDataFrame([(1, *x) for x in said.items()], "query_id int, item_id string, answer string")
    got = {r.item_id: r for r in rerank.pointwise(rerank.pointwise_answers(c, answers)).collect()}
    assert [got[k].rerank_score for k in "abcd"] == [0, 0, 0, 100] and got["d"].new_rank == 1
    listed = spark.createDataFrame([(1, '{"ranking": [{"image_id": "b", "score": "NaN"}, {"image_id": "a", "score": 7}, "c", "d"]}')], "query_id int, answer string")
    assert {r.item_id: r.score for r in rerank.listwise(c.select("query_id", "item_id", "rank"), listed).collect()}["b"] == 0


def test_an_answers_evidence_and_mismatch_are_kept(spark):
    c = spark.createDataFrame([(1, i, 0.1, k, ["own"], ["before"]) for k, i in enumerate("abc", 1)], "query_id int, item_id string, fused_score double, rank int, evidence array<string>, mismatch array<string>")
    said = {"a": '{"score": 5, "evidence": ["e1", " ", " e2 "], "mismatch": "m"}', "b": "prose", "c": '{"score": 1}'}
    answers = spark.createDataFrame([(1, *x) for x in said.items()], "query_id int, item_id string, answer string")
    got = {r.item_id: (r.evidence, r.mismatch) for r in rerank.pointwise(rerank.pointwise_answers(c, answers)).collect()}
    assert got == {"a": (["e1", "e2"], ["m"]), "b": (["own"], ["rerank failed: no JSON object"]), "c": ([], [])}


MANIFEST = "item_id string, relative_path string, valid boolean, duplicate_of string"


def test_tasks_for_people_are_blank(spark, tmp_path):
    items = spark.createDataFrame([(f"v{k}", f"v{k}.jpg", k != 3, "v0" if k == 4 else None) for k in range(9)], MANIFEST)
    made = judging.blank_tasks(items, 7).collect()
    assert [r.query_id for r in made] == [f"q00{k}" for k in range(1, 8)] and [r.item_id for r in made] == ["v0", "v1", "v2", "v5", "v6", "v7", "v8"]
    assert {(r.text, r.category, r.annotator, r.reviewed, r.note) for r in made} == {("", "", "", False, "")}
    assert judging.blank_tasks(items, 3, seed=1).collect() == judging.blank_tasks(items.repartition(3), 3, seed=1).collect()
    for n, why in ((0, "positive"), (8, "8 tasks are asked for, of 7")):
        with pytest.raises(ValueError, match=why):
            judging.blank_tasks(items, n)
    items.write.json(f"{tmp_path}/items")
    args = ["tasks", "--manifest", f"{tmp_path}/items", "--out", f"{tmp_path}/tasks", "--n", "2"]
    jobs.main(args, spark)
    with pytest.raises(SystemExit, match="--force"):
        jobs.main(args, spark)
    jobs.main([*args, "--force"], spark)
    assert spark.read.json(f"{tmp_path}/tasks/queries").count() == 2
    check = ["validate", "--manifest", f"{tmp_path}/items", "--tasks", f"{tmp_path}/tasks", "--n", "2"]
    with pytest.raises(SystemExit, match="faults: q001: annotator"):
        jobs.main(check, spark)


def test_a_set_that_people_made_is_validated(spark, tmp_path, capsys):
    spark.createDataFrame([("a", "a.jpg", True, None)], MANIFEST).write.json(f"{tmp_path}/items")
    spark.createDataFrame([("q001", "a wall", "simple", "ann", True)], "query_id string, text string, category string, annotator string, reviewed boolean").write.json(f"{tmp_path}/t/queries")
    spark.createDataFrame([("q001", "a", 2, "ann", "")], "query_id string, image_id string, relevance int, annotator string, note string").write.csv(f"{tmp_path}/t/relevance", header=True)
    jobs.main(["validate", "--manifest", f"{tmp_path}/items", "--tasks", f"{tmp_path}/t", "--n", "1"], spark)
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"tasks": 1, "annotators": "ann", "categories": "simple=1", "judgments": 1}


def test_deliveries_name_their_index_and_configuration(spark, tmp_path, capsys):
    ann = spark.range(30).select(F.concat(F.lit("val-"), "id").alias("item_id"), F.concat(F.lit("wall "), "id").alias("summary"), F.concat(F.lit("val/"), "id").alias("relative_path"), F.lit("room").alias("scene"))
    for c in ("objects", "actions", "attributes", "spatial_relations", "style", "mood", "colors", "ocr_text"):
        ann = ann.withColumn(c, F.array().cast("array<string>"))
    ann.withColumn("object_counts", F.array().cast("array<struct<name:string,count:int>>")).write.parquet(f"{tmp_path}/ann")
    base = ["--annotations", f"{tmp_path}/ann", "--indexes", f"{tmp_path}/idx", "--split", "val"]
    jobs.main(["index", *base, "--version", "v1", "--allow-missing-branches"], spark)
    ask = ["deliver", *base, "--query", "wall", "--out", f"{tmp_path}/out"]
    with pytest.raises(SystemExit, match="version 'v1'"):
        jobs.main([*ask, "--version", "v2"], spark)
    jobs.main([*ask, "--version", "v1"], spark)
    batch = json.loads(spark.read.text(f"{tmp_path}/out/batches").first()[0])
    digest = capsys.readouterr().out.strip().splitlines()[-1]
    assert batch["config_sha256"] == digest and all(re.fullmatch("[0-9a-f]{64}", batch[k]) for k in ("config_sha256", "index_manifest_sha256"))
    assert len(batch["candidates"]) == 20


def test_bm25_scores_items_where_they_lie(spark, tmp_path, monkeypatch):
    for name, most in (("FEW_TERMS", 9), ("TILE", 7), ("SHARED", 5)):
        monkeypatch.setattr(lexical, name, most, raising=False)
    texts = [" ".join(["a"] * (k % 3) + [f"w{k % 5}", f"w{k % 7}"] * (k % 4 > 0)) for k in range(60)]
    docs = spark.createDataFrame([(f"i{k:02}", t) for k, t in enumerate(texts)], "item_id string, text string").repartition(3)
    asked = [*[f"a w{k} w{k} {'w6' * (k % 2)}" for k in range(5)], "", None, "unknown"]
    index = lexical.build(docs, f"{tmp_path}/i")
    found = lexical.search(index, spark.createDataFrame(list(enumerate(asked)), "query_id int, text string"), 12)
    words = [t.split() for t in texts]
    df = {w: sum(w in d for d in words) for w in {w for d in words for w in d}}
    raw = {w: math.log(60 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    mean = sum(map(len, words)) / 60
    score = lambda d, q: round(sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in (q or "").split() if w in d), 6)
    got = found.collect()
    for q, text in enumerate(asked):
        want = sorted((-score(d, text), f"i{k:02}") for k, d in enumerate(words))[:12]
        mine = sorted((r.rank, r.item_id, r.score) for r in got if r.query_id == q)
        assert [i for _, i, _ in mine] == [i for _, i in want] and [s for *_, s in mine] == pytest.approx([-s for s, _ in want], abs=2e-6)
    # what is shuffled is k rows a query and task: one exchange a query, and no join of queries with items
    monkeypatch.undo()
    plan = lexical.search(index, spark.createDataFrame([(0, "a w1")], "query_id int, text string"), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_evidence_runs_its_search_once(spark, tmp_path):
    searched = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            searched.add(b.num_rows)
            yield b

    found = spark.createDataFrame([(1, 7, 1, "why")], "query_id long, item_id long, place int, question string").repartition(1)
    found = found.mapInArrow(noted, found.schema)
    says = lambda rows: rows.withColumn("raw", F.lit('{"facts": ["f"]}')).withColumn("error", F.lit(None).cast("string"))
    got, failed = answers.evidence(found, says, answers.cache(spark, f"{tmp_path}/c", "long", buckets=2), "one")
    assert got.count() == 1 and failed.count() == 0 and searched.value == 1


def test_totals_of_large_benchmarks_are_those_of_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    made = spark.range(0, 4000, 1, 7).select(
        F.col("id").alias("event_id"), F.concat(F.lit("m"), (F.col("id") % 2).cast("string")).alias("event_type"), (F.col("id") % 12).alias("user_id"),
        F.when(F.col("id") % 1000 < 2, 123456789.01).otherwise(F.col("id") % 7 / 100 + 0.07).alias("value"),
    )
    made.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    e = __spark_entry__
    got = [tuple(r) for r in e.queries()["benchmark_summary"](spark, str(tmp_path)).orderBy("method").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == con.execute(f"SELECT * FROM ({e.oracle_sql()['benchmark_summary']}) ORDER BY method").fetchall()
    assert "E" not in got[0][-1]


def test_only_recalled_annotations_are_normalized(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    a = ann(spark, {"item_id": "i1", "scene": "street"}, {"item_id": "i2"})
    hits = spark.createDataFrame([("q", "image", "i1", 1.0, 1)], "query_id string, branch string, item_id string, score double, rank int")
    queries = spark.createDataFrame([("q", ["red"])], "query_id string, excluded_terms array<string>")
    out = Searcher(a, {}).decided(hits, queries)
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "foldCase" in plan and "foldCase" not in plan[plan.rindex("Join") :]  # below the last join are the tables as they are
    assert [(r.item_id, r.allowed) for r in out.collect()] == [("i1", True)]
