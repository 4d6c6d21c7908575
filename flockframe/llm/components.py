"""Connected components by alternating star contraction, each step a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..session import checkpoint


def _least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the least of a and all its partners.

    The least are written: a join of plain tables is one whose partitions are split at a hub. It is a merge join
    at every size, so no rounds of broadcasts pile up in the driver.
    """
    least = checkpoint(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    return edges.join(least.hint("merge"), "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in undirected ``edges`` (a, b); root is the least node reachable.

    Large-star hangs every greater partner on a node's least partner, small-star every
    lesser one; both keep the components, and the graph ends as one star for each. The number of
    rounds grows with the logarithm of the longest chain. Loops and repeated edges do no harm;
    without edges there are no rows. No group is gathered: a hub is a skewed join, which is split.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = checkpoint(edges), None
    while True:
        both = edges.union(edges.select("b", "a"))
        large = _least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = _least(large)  # here all partners are lesser
        small = (small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        seen = Observation()
        edges = checkpoint(small.observe(seen, F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s")))
        now = seen.get
        if now == before:
            break
        before = now
    return (nodes.join(edges.hint("merge"), nodes["node"] == edges["a"], "left")
            .select("node", F.coalesce("b", "node").alias("root")))
