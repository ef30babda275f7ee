"""The audit of embedding near-dedup: links that were lost as a whole show, and make it fall back on exact comparison."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.llm import embedding_dedup


def planted(spark, groups=40, of=5, others=1_500):
    """Groups of near copies among unlike vectors, all of one label."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(groups, 24))
    x = np.vstack([base[np.repeat(np.arange(groups), of)] + rng.normal(size=(groups * of, 24)) * 0.03, rng.normal(size=(others, 24))])
    return spark.createDataFrame([(k, [float(v) for v in row], 1) for k, row in enumerate(x)], "vec_id long, embedding array<double>, label int"), groups * of, of


def lossy(keep, real=embedding_dedup._search):
    """A search that loses all links of the nodes that ``keep`` refuses, unless shards are compared exactly; it notes how it was called."""
    calls = []

    def search(nodes, kind, least, overlap, whole):
        calls.append((overlap, whole))
        found, links = real(nodes, kind, least, overlap, whole)
        return (found, links) if whole else (found.filter(keep("node")), links.filter(keep("a") & keep("b")))

    return search, calls


@pytest.mark.parametrize("keep", [lambda c: F.lit(False), lambda c: F.col(c) >= 25])
def test_lost_groups_make_it_compare_exactly(spark, monkeypatch, keep):
    vectors, members, of = planted(spark)
    search, calls = lossy(keep)
    monkeypatch.setattr(embedding_dedup, "_search", search)
    rows = embedding_dedup.audited(vectors).collect()
    assert calls[0] == (embedding_dedup.OVERLAP, False) and calls[1][1] is True
    links = {r.vec_id: r.n_links for r in rows}
    assert all(links[k] == of - 1 for k in range(members)) and {r.recall for r in rows} == {1.0}


def test_more_nodes_are_audited_while_no_links_are_seen(spark):
    vectors, _, _ = planted(spark, groups=2, of=3, others=2_500)
    rows = vectors.select(F.col("vec_id").alias("node"), F.lit("1").alias("label"), embedding_dedup.packed("<f8")(F.col("embedding")).alias("b"), F.lit(1).alias("copies"))
    nodes = embedding_dedup.materialize(rows)
    nothing = spark.createDataFrame([], "node long, n long")
    assert embedding_dedup._audit(nodes, nothing, "<f8", 0.93) == (0.0, 2_506)
    right = spark.createDataFrame([(k, 2) for k in range(6)], "node long, n long")
    assert embedding_dedup._audit(nodes, right, "<f8", 0.93) == (1.0, 2_506)
    alone = embedding_dedup.materialize(nodes.filter("node >= 6"))
    assert embedding_dedup._audit(alone, nothing, "<f8", 0.93) == (None, 2_500)
