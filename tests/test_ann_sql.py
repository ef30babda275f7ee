"""Inverted lists against exact search, and SQL text against the searcher."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_plans import ITEMS, ann, asked, ranking

from heliograph.operators import ann as lists
from heliograph.operators import dense
from heliograph.plans import sql
from heliograph.plans.search import Searcher

RNG = np.random.default_rng(3)


def table(spark, x, first=0):
    return spark.createDataFrame([(first + k, [float(v) for v in row]) for k, row in enumerate(x)], "item_id long, vector array<double>")


@pytest.fixture(scope="module")
def grouped(spark, tmp_path_factory):
    """600 items about 12 directions, copies and unsound ones among them; 30 queries near them."""
    middle = RNG.normal(size=(12, 8)) * 4
    x = middle[RNG.integers(12, size=600)] + RNG.normal(size=(600, 8)) * 0.5
    x[17:25] = x[16]
    items = table(spark, x).unionByName(spark.createDataFrame([(900, [0.0] * 8), (901, None)], "item_id long, vector array<double>"))
    q = middle[RNG.integers(12, size=30)] + RNG.normal(size=(30, 8)) * 0.5
    q[0] = x[16]
    queries = table(spark, q).withColumnRenamed("item_id", "query_id").unionByName(spark.createDataFrame([(99, [0.0] * 8)], "query_id long, vector array<double>"))
    return items, queries, lists.build(items, str(tmp_path_factory.mktemp("ivf")), cells=12)


def rows(df):
    return sorted(map(tuple, df.select("query_id", "rank", "item_id", "score").collect()))


@pytest.mark.parametrize(("k", "probes"), [(1, 1), (10, 1), (10, 5), (700, 2)])
def test_the_second_pass_makes_it_exact(grouped, k, probes):
    items, queries, index = grouped
    assert rows(lists.search(index, queries, k, probes, exact=True)) == rows(dense.search(dense.prepared(items), queries, k))


def test_cells_hold_all_items_once_and_know_their_radius(grouped):
    items, _, index = grouped
    assert index.items.count() == 600 == index.sizes.sum() and index.items.select("item_id").distinct().count() == 600
    near = {r["cell"]: r["least"] for r in index.items.groupBy("cell").agg(F.min(F.cos("angle")).alias("least")).collect()}
    assert all(abs(np.cos(index.radius[c]) - least) < 1e-9 for c, least in near.items())
    with pytest.raises(ValueError, match="no vectors"):
        lists.build(items.filter("item_id >= 900"), "/tmp/never")
    with pytest.raises(ValueError, match="positive"):
        lists.search(index, items, 1, 0)


def test_recall_is_measured_and_probes_are_tuned(grouped):
    items, queries, index = grouped
    truth = dense.search(dense.prepared(items), queries, 10)
    one = lists.recall(lists.search(index, queries, 10, 1), truth).agg(F.avg("recall")).first()[0]
    all_ = lists.recall(lists.search(index, queries, 10, 12), truth).agg(F.avg("recall")).first()[0]
    assert 0.5 < one <= all_ == 1.0
    probes, mean = lists.tuned(index, queries, 10, 0.99)
    assert mean >= 0.99 and 1 <= probes <= 12
    assert lists.tuned(index, queries.filter("query_id < 0"), 10) == (1, 1.0)


def test_only_the_cells_asked_for_are_read(grouped):
    _, queries, index = grouped
    plan = lists.search(index, queries.filter("query_id = 0"), 3, 2)._jdf.queryExecution().executedPlan().toString()
    read = [line for line in plan.splitlines() if "PartitionFilters" in line and "cell" in line]
    assert read and "IN (" in read[0].split("PartitionFilters:")[1] or "cell#" in read[0]


def test_cells_that_lose_their_items_begin_anew():
    x = np.vstack([np.eye(3)[[0] * 50], np.eye(3)[[1] * 2], np.eye(3)[[2]]])
    assert sorted(lists.fitted(x, 3, seed=1).argmax(axis=1)) == [0, 1, 2]


# --- SQL


def test_sql_gives_what_the_searcher_gives(spark):
    a = ann(spark, *ITEMS)
    q = asked(spark, excluded_terms=["建筑"])
    branches = {"bm25": ranking(spark, "p1 p2 p3 p5"), "text": ranking(spark, "p3 p5 p4")}
    sql.register(Searcher(a, branches), q, 10, "t_")
    want = [(r.item_id, r["rank"], round(r.fused_score, 9)) for r in Searcher(a, branches).search(q, 10, 3).orderBy("rank").collect()]
    got = [(r.item_id, r["rank"], round(r.fused_score, 9)) for r in spark.sql("SELECT * FROM t_hybrid_search(results => 3) ORDER BY rank").collect()]
    assert got == want and len(got) == 3
    weights = {"bm25": 0.25, "text": 3.0}
    want = [(r.item_id, r["rank"], round(r.fused_score, 9)) for r in Searcher(a, branches, method="weighted", weights=weights).search(q, 10, 9).orderBy("rank").collect()]
    got = [(r.item_id, r["rank"], round(r.fused_score, 9)) for r in spark.sql("SELECT * FROM t_weighted_search(w_bm25 => 0.25D, w_text => 3.0D) ORDER BY rank").collect()]
    assert got == want
    joined = spark.sql("SELECT count(*) AS n FROM t_hybrid_search(results => 2, rrf_k => 0) s JOIN t_rankings r USING (query_id, item_id)").first()["n"]
    assert joined >= 2


def test_metrics_in_sql(spark):
    sql.register_metrics(spark, "string", "t_")
    spark.createDataFrame([("a", 1, 0), ("a", 3, 2), ("a", None, 1), ("a", 2, None), ("b", None, 0), ("c", None, None)], "query_id string, rank int, grade int").createOrReplaceTempView("t_found")
    got = {r.query_id: tuple(r)[1:] for r in spark.sql("SELECT * FROM t_ranking_metrics(TABLE(t_found) PARTITION BY query_id)").collect()}
    ideal = 3 + 1 / np.log2(3)
    assert set(got) == {"a", "b"} and got["a"] == pytest.approx((0, 0.5, 0.5, 1 / 3, 1 / 6, 3 / np.log2(4) / ideal)) and got["b"] == (0,) * 6
