"""Neighbour graphs of strata, for all species together.

nodes: species, id (integer), x, y [, ring]; edges: species, node1 < node2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from ..session import checkpoint
from .spatial import closest


def car_edges(pairs: DataFrame) -> DataFrame:
    """Distinct undirected edges with node1 < node2."""
    return pairs.select("species", F.least("node1", "node2").alias("node1"),
                        F.greatest("node1", "node2").alias("node2")).filter(
        F.col("node1") < F.col("node2")).distinct()


def edge_counts(edges: DataFrame) -> DataFrame:
    """Number of edges and of linked nodes per species."""
    both = edges.select("species", F.explode(F.array("node1", "node2")).alias("id")).distinct()
    nodes = both.groupBy("species").agg(F.count(F.lit(1)).alias("n_linked"))
    return edges.groupBy("species").agg(F.count(F.lit(1)).alias("n_edges")).join(nodes, "species")


def contiguity(nodes: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Cells that share a whole edge (corner contact is not enough).

    Edges are direction-free keys of corner coordinates, rounded to ``tolerance`` of the mean
    edge length of all cells; in a grid an edge has at most two owners, so the join gives
    one row per real neighbour.
    """
    edges = nodes.select("species", "id", F.explode(G.ring_edges(F.col("ring"))).alias("e"))
    side = F.avg(F.hypot(F.col("e.a.x") - F.col("e.b.x"), F.col("e.a.y") - F.col("e.b.y")))
    unit = (edges.agg(side.alias("s")).first()["s"] or 1.0) * tolerance

    def corner(p):
        return F.struct(F.round(p["x"] / unit).alias("x"), F.round(p["y"] / unit).alias("y"))

    sides = (edges.select("species", "id", corner(F.col("e.a")).alias("a"), corner(F.col("e.b")).alias("b"))
             .select("species", "id", F.struct(F.least("a", "b").alias("a"),
                                               F.greatest("a", "b").alias("b")).alias("side")))
    other = sides.select("species", F.col("id").alias("node2"), "side")
    return (sides.withColumnRenamed("id", "node1").join(other, ["species", "side"])
            .filter(F.col("node1") < F.col("node2"))
            .select("species", "node1", "node2").distinct())


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Label every node with the least node id it is linked to: species, id, label.

    In each round a node offers the least label two steps away among its
    neighbours to itself and to its own label's node, and moves to its label's
    label; the number of rounds grows with the logarithm of the graph's width.
    """
    both = checkpoint(edges.select("species", F.col("node1").alias("from"), F.col("node2").alias("id"))
                      .union(edges.select("species", "node2", "node1")))
    labels = checkpoint(nodes.select("species", "id", F.col("id").alias("label")))
    while True:
        up = labels.select("species", F.col("id").alias("label"), F.col("label").alias("above"))
        here = labels.join(up, ["species", "label"])
        near = (both.join(here, ["species", "id"]).groupBy("species", F.col("from").alias("id"))
                .agg(F.min("above").alias("near")))
        here = here.join(near, ["species", "id"], "left").withColumn("near", F.coalesce("near", "above"))
        offers = here.select("species", F.explode(F.array(
            F.struct("id", F.least("above", "near").alias("to"), F.col("label").alias("was")),
            F.struct(F.col("label").alias("id"), F.col("near").alias("to"),
                     F.lit(None).cast(nodes.schema["id"].dataType).alias("was")))).alias("o"))
        moved = checkpoint(offers.select("species", "o.*").groupBy("species", "id")
                           .agg(F.min("to").alias("label"), F.max("was").alias("was")))
        labels = moved.select("species", "id", "label")
        if moved.filter(F.col("label") != F.col("was")).isEmpty():
            return labels


def _sides(nodes):
    """The nodes as left and right side of distance joins, computed once."""
    left = checkpoint(nodes.select("species", "id", "x", "y"))
    right = left.select("species", F.col("id").alias("id2"), F.col("x").alias("x2"),
                        F.col("y").alias("y2"))
    return left, right


def knn_fill(nodes: DataFrame, edges: DataFrame, k: int = 2) -> DataFrame:
    """Edges plus links from every node without one to its ``k`` nearest nodes."""
    linked = edges.select("species", F.explode(F.array("node1", "node2")).alias("id")).distinct()
    left, right = _sides(nodes)
    alone = left.join(linked, ["species", "id"], "left_anti").withColumn("own", F.col("id"))
    near = closest(alone, right.withColumn("own2", F.col("id2")), ["species"], ["id"], k=k, apart="own")
    return car_edges(edges.select("species", "node1", "node2").unionByName(
        near.select("species", F.col("id").alias("node1"), F.col("id2").alias("node2"))))


def link_components(nodes: DataFrame, edges: DataFrame, factor: float = 1.2) -> DataFrame:
    """Join separate components by distance until each species has one.

    Again and again the component with the least node is linked from its node
    nearest to the outside, to that outside node and to all outside nodes less
    than ``factor`` times as far from it, and takes their components in. The components are labelled
    once by Spark; the linking itself follows one order, so a task does it for a species of several
    components. It holds the species' cells, whose number the grid sets and not the surveys.
    """
    labels = checkpoint(connected_components(nodes, edges))
    several = (labels.groupBy("species").agg(F.min("label").alias("__a"), F.max("label").alias("__b"))
               .filter(F.col("__a") != F.col("__b")).select("species"))
    cells = (nodes.select("species", "id", "x", "y").join(labels, ["species", "id"])
             .join(several, "species", "left_semi"))
    kind = nodes.schema["id"].dataType
    schema = nodes.select("species").schema.add("node1", kind).add("node2", kind)

    def link(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("id")
        ids, x, y, label = (pdf[c].to_numpy() for c in ("id", "x", "y", "label"))
        outside = np.ones(len(ids), bool)
        # nearest inside node of each outside one; equal to the millimetre counts as equal, then the lesser id
        near, length = np.zeros(len(ids), int), np.full(len(ids), np.inf)
        joining, found = np.flatnonzero(label == label.min()), []
        while True:
            outside[joining] = False
            for i in joining:
                d = np.hypot(x - x[i], y - y[i])
                gap = np.round(d, 3) - np.round(length, 3)
                closer = (gap < 0) | ((gap == 0) & (i < near))
                near, length = np.where(closer, i, near), np.where(closer, d, length)
            rest = np.flatnonzero(outside)
            if not len(rest):
                break
            j = rest[np.lexsort((rest, near[rest], np.round(length[rest], 3)))[0]]
            i, reach = near[j], length[j]
            d = np.hypot(x[rest] - x[i], y[rest] - y[i])
            met = rest[(d <= reach) | (d < reach * factor)]
            found += [(ids[i], ids[k]) for k in met]
            joining = np.flatnonzero(outside & np.isin(label, label[met]))
        return pd.DataFrame({"species": pdf["species"].iloc[0], "node1": [a for a, _ in found], "node2": [b for _, b in found]})

    links = cells.groupBy("species").applyInPandas(link, schema)
    return car_edges(edges.select("species", "node1", "node2").unionByName(links))


def unlinked_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a neighbour; must be empty before a spatial model is fitted."""
    linked = edges.select("species", F.explode(F.array("node1", "node2")).alias("id")).distinct()
    return nodes.join(linked, ["species", "id"], "left_anti")


def neighbour_segments(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Both directions of every edge with the coordinates of its ends."""
    both = edges.select("species", F.col("node1").alias("from"), F.col("node2").alias("to")).union(
        edges.select("species", "node2", "node1"))
    a = nodes.select("species", F.col("id").alias("from"), F.col("x").alias("x_from"),
                     F.col("y").alias("y_from"))
    b = nodes.select("species", F.col("id").alias("to"), F.col("x").alias("x_to"),
                     F.col("y").alias("y_to"))
    return both.join(a, ["species", "from"]).join(b, ["species", "to"])
