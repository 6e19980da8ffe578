"""Connected components of an edge table by contraction, without any collection on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Each round gives every node its smallest neighbour as parent, jumps once through parents, and contracts the
    edges; rounds are few (logarithmic for paths, two for stars). Every round is written and read again, so that plans stay
    short and lost executors cost one round at most. Hubs are met by map-side minima and by joins that AQE can split.
    """
    # every edge once, smaller end first
    edges = scratch.settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", n := edges.count())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = scratch.settle(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parents", 2 * n)
        jump = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent, old = scratch.settle(parent.join(jump, "p").select("a", F.least("p", "pp").alias("p")), "parents", 2 * n), parent
        to = parent.select(F.col("a").alias("component"), "p")
        if labels is None:
            new = parent.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            new = labels.join(to, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        new = scratch.settle(new, "labels", 2 * n)
        at_a, at_b = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(at_a, "a").join(at_b, "b").where("pa <> pb")
        fewer = scratch.settle(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges", n)
        scratch.drop(edges, old, parent, *([labels] if labels is not None else []))
        edges, labels = fewer, new
    if labels is None:
        labels = scratch.settle(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), "labels")
    scratch.drop(edges)
    return labels
