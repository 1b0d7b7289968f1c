"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylib.session import drop_durable, durable, spread_join


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, component`` (the component's least node) of the nodes of ``edges(a, b)``, longs.

    Rows with a null are dropped; loops make single nodes; direction and repetition don't matter.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
    and Beyond"): each node hands its neighbours its least neighbour, until the graph is a set of
    stars. A node's minimum is an aggregate, summed before the shuffle, and comes back by a
    ``spread_join``, so a node with very many neighbours is never gathered in one task. Each
    round's edges are written, so no lineage grows and lost executors cost one round at most; those of
    the round before are deleted.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    given = durable(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-given")
    e = given.filter("a <> b")
    for rounds in range(max_rounds):
        if _is_forest_of_stars(e):
            break
        last, e = e, durable(_small_star(_large_star(e)), "cc-edges")
        if rounds:
            drop_durable(last)
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    nodes = given.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return spread_join(nodes, roots, ["node"], "left").select("node", F.coalesce("component", "node").alias("component"))


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Whether all edges (a > b) go to nodes that have no smaller neighbour themselves, and each node has one.

    Both steps leave such edges as they are, and others they change.
    """
    centres = e.select(F.col("b").alias("a")).distinct()
    if not e.join(centres, "a", "left_semi").isEmpty():
        return False
    counts = e.agg(F.count("*").alias("n"), F.countDistinct("a").alias("m")).first()
    return counts["n"] == counts["m"]


def _large_star(e: DataFrame) -> DataFrame:
    """Edges (a > b): every larger neighbour of a node gets the least of the node and its neighbours."""
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    hit = spread_join(both.filter("b > a"), least, ["a"])
    return hit.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Edges (a > b): each node and its smaller neighbours get the least of these."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = spread_join(e, least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
