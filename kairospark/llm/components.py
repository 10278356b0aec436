"""Connected components of a graph in a table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairospark.llm.columns import stored
from kairospark.llm.skew import with_facts


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (large: those above it; else those below, and itself) to the least node that it knows. A hub's edges are spread over tasks."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    met = with_facts(both, "a", "b", F.least(F.min("b"), F.col("a")).alias("root"))
    if large:
        return met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("root").alias("b"))
    return met.select(F.when(F.col("b") == F.col("root"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("root").alias("b"))  # the edge to the root stands for the node itself


def _settled(edges: DataFrame) -> bool:
    """Whether all edges (a, b) are stars: every a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("as_a"), F.lit(0).alias("as_b")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("as_a"), F.lit(1).alias("as_b")))
    return ends.groupBy("node").agg(F.sum("as_a").alias("as_a"), F.max("as_b").alias("as_b")).where("as_a > 1 or as_a > 0 and as_b > 0").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge: the least node of its component. edges: a, b of any one orderable type.

    Every round halves the depth of the stars at least; it is written to the shared folder, and rounds end when all edges are stars. Aggregates and equi-joins only: no neighbour list is ever gathered. Self-links and repeated edges are harmless. An empty table gives no rows.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        if _settled(now):
            break
        upper = stored(_star(now, True).where(F.col("a") != F.col("b")).distinct())
        now = stored(_star(upper, False).where(F.col("a") != F.col("b")).distinct())
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
