"""Connected components by alternating large-star and small-star steps, for edge lists of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import hot_keys, materialize, salted_join


#: Edges whose rows, both ways, one task may hold whatever their nodes are.
FEW_EDGES = 500_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(id, component_id) for each id that has an edge to another; component_id is the smallest id reachable.

    Each step links nodes to the smallest node that they know of, until only stars about the smallest are left. A node's links
    are merged on the map side before they are dealt, and of more than FEW_EDGES edges the rows of a node with very many
    links are dealt over several tasks. Edges with a null end, and loops, are passed over.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    edges = materialize(edges)
    for step in range(most + 1):
        n, done = _settled(edges)
        if done:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        if step < most:
            # large star: each node's larger neighbours are linked with the smallest node near it
            many = n > FEW_EDGES
            edges = materialize(_star(_star(edges, True, many), False, many))
    raise RuntimeError(f"components did not settle in {most} steps")


def _settled(edges: DataFrame) -> tuple[int, bool]:
    """(number of edges, whether they are stars already: each u has one v, and no v is a u)."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, wrong = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return n, not wrong


def _star(edges: DataFrame, large: bool, many: bool) -> DataFrame:
    """edges: u > v, distinct."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    low = both.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "x"))
    low = materialize(low) if many else low
    joined = salted_join(both, low.select("x", "m"), "x", hot_keys(low, "x", "n") if many else [], spread="y")
    if large:
        out = joined.filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()
