"""Cited answers, their evidence's cache, and keyed tables."""

import pytest
from pyspark.sql import functions as F

from heliograph.plans import answers
from heliograph.plans.generation import AGAIN
from heliograph.sources.keyed import KeyedTable

QUESTIONS = "query_id long, question string"
SELECTED = "query_id long, item_id string, place int"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def says(table, by):
    """A generator that answers from a table: by a column's value, or by (value, whether it is asked again)."""

    def generate(df):
        spark = df.sparkSession
        told = [(str(k[0]), k[1], v) if isinstance(k, tuple) else (str(k), None, v) for k, v in table.items()]
        known = spark.createDataFrame(told, "k string, again boolean, raw string")
        met = df.join(known, (known.k == df[by].cast("string")) & (known.again.isNull() | (known.again == df.prompt.endswith(AGAIN))), "left")
        return met.drop("k", "again").withColumn("error", F.when(F.col("raw").isNull(), "silent"))

    return generate


# --- keyed tables


def test_a_keyed_table_replaces_the_same_work_and_lets_later_work_win(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", ("a", "b"), "a long, b string, v int", buckets=4)
    keys = lambda *k: spark.createDataFrame(list(k), "a long, b string")
    found, lacking = t.lookup(keys((1, "x"), (1, "x"), (None, "y")))
    assert (found.count(), rows(lacking, "a", "b")) == (0, [(1, "x")])
    put = lambda data, work: t.upsert(spark.createDataFrame(data, "a long, b string, v int"), work)
    put([(1, "x", 1), (2, "x", 1), (None, "x", 1), (3, "z", 5), (3, "z", 4)], "one")
    put([(2, "x", 2), (4, "w", 2)], "two-a")
    put([(1, "x", 9), (2, "x", 9)], "one")  # the same work again: its own batch, before the other
    assert t.batches() == ["00000001-one", "00000002-two-a"]
    assert rows(t.read(), "a", "b", "v") == [(1, "x", 9), (2, "x", 2), (4, "w", 2)]
    (tmp_path / "t" / ".unfinished" / "bucket=0").mkdir(parents=True)  # a job that died
    before = rows(t.read(), "a", "b", "v")
    t.compact()
    assert len(t.batches()) == 1 and rows(t.read(), "a", "b", "v") == before
    put([(4, "w", 7)], "three")
    found, lacking = t.lookup(keys((4, "w"), (5, "w")))
    assert (rows(found, "a", "b", "v"), rows(lacking, "a", "b")) == ([(4, "w", 7)], [(5, "w")])


def test_a_lookup_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", ("a",), "a long, v int", buckets=32)
    t.upsert(spark.range(500).select(F.col("id").alias("a"), F.lit(1).alias("v")), "all")
    found, _ = t.lookup(spark.createDataFrame([(7,)], "a long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters: [" in line and "bucket" in line.split("PartitionFilters: ")[1].split("]")[0]]
    assert found.count() == 1 and filters


def test_names_and_keys_of_keyed_tables_are_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="lacks"):
        KeyedTable(spark, str(tmp_path), ("a",), "b long")
    with pytest.raises(ValueError, match="own"):
        KeyedTable(spark, str(tmp_path), ("a",), "a long, batch string")


# --- evidence


def test_evidence_is_asked_for_once_and_failures_again(spark, tmp_path):
    store = answers.cache(spark, f"{tmp_path}/e")
    requests = spark.createDataFrame([(1, " q? ", "a", 1), (1, " q? ", "b", 2), (2, "q?", "a", 1), (3, "other", "a", 1)], "query_id long, question string, item_id string, place int")
    known = spark.createDataFrame([("a", "a house")], "item_id string, context string")
    found, failed = answers.evidence(requests, says({"a": '{"facts": "one", "uncertainty": [" ", "x "]}'}, "item_id"), store, "w1", known)
    assert rows(found, "query_id", "item_id", "question", "relevant", "used_annotation", "asked") == [(1, "a", "q?", True, True, True), (2, "a", "q?", True, True, True), (3, "a", "other", True, True, True)]
    assert found.select("facts", "uncertainty").distinct().collect()[0] == (["one"], ["x"])
    assert rows(failed, "query_id", "error") == [(1, "b: silent")]
    found, failed = answers.evidence(requests, says({"b": 'so {"relevant": 0, "facts": []}'}, "item_id"), store, "w2", known)
    assert rows(found, "query_id", "item_id", "relevant", "asked") == [(1, "a", True, False), (1, "b", False, True), (2, "a", True, False), (3, "a", True, False)]
    assert failed.count() == 0
    found, failed = answers.evidence(requests, says({}, "item_id"), store, "w3")
    assert (found.filter("asked").count(), found.count(), failed.count()) == (0, 4, 0)
    assert store.batches() == ["00000001-w1", "00000002-w2"]  # nothing new, no batch


@pytest.mark.parametrize(("said", "want"), [('{"relevant": "false"}', True), ('{"relevant": null}', False), ('{"relevant": []}', False), ("{}", True), ('{"relevant": 1}', True)])
def test_relevance_is_read_as_python_does(spark, tmp_path, said, want):
    found, _ = answers.evidence(spark.createDataFrame([(1, "q", "a", 1)], "query_id long, question string, item_id string, place int"), says({"a": said}, "item_id"), answers.cache(spark, f"{tmp_path}/e"), "w")
    assert found.first()["relevant"] is want


# --- answers


def answered(spark, said, facts=(("a", ["A fact", "more"]), ("b", ["B fact"])), retries=1):
    found = spark.createDataFrame([(1, k, i, "q", True, f, [], False, True) for k, (i, f) in enumerate(facts, 1)], "query_id long, place int, item_id string, question string, relevant boolean, facts array<string>, uncertainty array<string>, used_annotation boolean, asked boolean")
    out = answers.answered(spark.createDataFrame([(1, "q")], QUESTIONS), found, says(said, "query_id"), retries).collect()
    assert len(out) == 1
    return tuple(out[0])[1:]


BY_EVIDENCE = ("A fact[img_a]；B fact[img_b]。", ["a", "b"], 0.5, False, "evidence", 2)


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ('{"answer": "Yes[img_b]", "citations": ["a"], "confidence": "0.25"}', ("Yes[img_b]", ["a", "b"], 0.25, False, "generator", 1)),
        ('{"answer": 5, "citations": "a"}', ("5", ["a"], 0.0, False, "generator", 1)),
        ('{"answer": "", "citations": ["a"]}', (answers.REFUSAL, ["a"], 0.0, False, "generator", 1)),
        ('{"refused": true}', (answers.REFUSAL, [], 0.0, True, "generator", 1)),
        ('{"answer": "Yes"}', BY_EVIDENCE),
        ('{"answer": "Yes[img_c]", "refused": true}', BY_EVIDENCE),
        ('{"answer": "Yes[img_a]", "confidence": 1.5}', BY_EVIDENCE),
        ('{"answer": "Yes[img_a]", "confidence": "high"}', BY_EVIDENCE),
        ('{"answer": "Yes[img_a]", "confidence": NaN}', BY_EVIDENCE),
        ("no object", BY_EVIDENCE),
        (None, BY_EVIDENCE),
    ],
)
def test_answers_are_checked_and_replaced(spark, said, want):
    assert answered(spark, {1: said}) == want


def test_a_bad_answer_is_asked_for_again(spark):
    said = {(1, False): '{"answer": "No[img_x]"}', (1, True): '{"answer": "Yes[img_a]"}'}
    assert answered(spark, said) == ("Yes[img_a]", ["a"], 0.0, False, "generator", 2)
    assert answered(spark, said, retries=0) == (*BY_EVIDENCE[:5], 1)
    assert answered(spark, {1: "x"}, facts=(("a", []),)) == (answers.REFUSAL, [], 0.0, True, "refusal", 0)


def test_questions_go_all_the_way(spark, tmp_path):
    questions = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q3"), (4, "q4")], QUESTIONS)
    selected = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (4, "a", 4), (4, "d", 1)], SELECTED)
    ask = says({"a": '{"facts": ["A"]}', "b": '{"facts": ["B"], "relevant": false}', "c": '{"facts": []}'}, "item_id")
    found, errors = answers.answer(questions, selected, ask, says({1: '{"answer": "see [img_a]"}'}, "query_id"), answers.cache(spark, f"{tmp_path}/e"), "w")
    assert rows(found, "query_id", "answer", "source") == [(1, "see [img_a]", "generator"), (2, answers.REFUSAL, "refusal"), (3, answers.REFUSAL, "refusal")]
    assert rows(errors, "query_id", "error") == [(4, "d: silent")]


def test_free_answers_and_content(spark):
    requests = spark.createDataFrame([(1, "a", "what?"), (2, "b", "who?")], "request_id long, item_id string, question string")
    assert rows(answers.about_item(requests, says({"a": "not sure"}, "item_id")), "request_id", "answer", "error") == [(1, "not sure", None), (2, None, "silent")]
    wanted = spark.createDataFrame([(1, "a", "post", "warm"), (2, "b", "post", "warm"), (3, "nobody", "post", "warm")], "request_id long, item_id string, kind string, tone string")
    known = spark.createDataFrame([("a", "A"), ("b", "B")], "item_id string, context string")
    good, bad = answers.written_content(wanted, known, "Write.", says({1: 'here: {"title": "T"}'}, "request_id"))
    assert rows(good, "request_id", "content") == [(1, '{"title": "T"}')]
    assert rows(bad, "request_id", "error") == [(2, "silent"), (3, "unknown item")]
