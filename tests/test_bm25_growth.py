"""What BM25's queries shuffle doesn't grow with the product of documents and queries, nor with the vocabulary."""

import pytest

import __spark_entry__ as entry
from heliograph.operators import lexical
from heliograph.plans import catalogue

DOCUMENTS, QUERIES = 3_000, 40


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Tables in which each document shares a word with each query."""
    at = str(tmp_path_factory.mktemp("shop"))
    docs = spark.range(DOCUMENTS).selectExpr("id AS doc_id", "concat('common w', id % 7, ' w', id % 11) AS text", "if(id % 6 = 0, 'fr', 'en') AS lang", "'s' AS source", "1L AS n_chars")
    docs.coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.range(DOCUMENTS).selectExpr("id AS doc_id", "id % 2 AS quality", "id % 5 AS toxic").coalesce(1).write.parquet(f"{at}/labels.parquet")
    spark.range(QUERIES).selectExpr("id AS item_id", "concat('common w', id % 9) AS text").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    return at


def shuffled(spark, job) -> int:
    """Rows that a job's stages give to shuffles."""
    sc = spark.sparkContext
    store, numbers = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, numbers, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    job()
    return sum(n for stage, n in stages().items() if stage not in before)


def run(spark, shop, name) -> int:
    return shuffled(spark, lambda: entry.queries()[name](spark, shop).write.format("noop").mode("overwrite").save())


@pytest.mark.parametrize("name", ["cited_answers", "pointwise_answers", "query_metrics", "listwise_repair", "eval_summary", "bm25_negative", "pointwise_rerank", "sql_metrics", "measured_suite"])
def test_queries_shuffle_no_pairs(spark, shop, name):
    """A ranking's rows for each task, and a row a label."""
    assert run(spark, shop, name) < DOCUMENTS * QUERIES / 4


def test_a_search_shuffles_no_vocabulary(spark, tmp_path):
    index = lexical.build(spark.range(20_000).selectExpr("id AS item_id", "concat('common w', id) AS text"), f"{tmp_path}/i")
    asked = spark.createDataFrame([(0, "common w7 w9 unknown")], "query_id int, text string")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")  # the words take more
    try:
        found = []
        assert shuffled(spark, lambda: found.extend(lexical.search(index, asked, 3).collect())) < 1_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert [r.item_id for r in sorted(found, key=lambda r: r["rank"])] == [7, 9, 0]


def test_an_index_shuffles_no_postings(spark, shop, monkeypatch):
    """A row a document, as a small file is spread over tasks, and a row a word and task."""
    monkeypatch.setattr(catalogue, "_INDEXES", {})
    assert 0 < run(spark, shop, "bm25_stats") < 2 * DOCUMENTS
