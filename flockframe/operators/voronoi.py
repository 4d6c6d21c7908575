"""Neighbours by Voronoi cells, clipped to a buffered area around the nodes.

nodes: species, id (integer), x, y. The cells are found once and do not depend on the clip: each node meets the nodes within a
reach that widens only for the nodes whose cell is not sure yet. A corner at distance R is sure once all nodes within
2 R have been met.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as G
from ..session import checkpoint
from .neighbours import connected_components
from .spatial import convex_hull, near_pairs

#: Shorter borders (metres) are corners where four or more cells meet.
MIN_LENGTH = 1e-3
#: Growth of the reach from round to round.
WIDER = 3.0


def _cell(own: int, ids: np.ndarray, dx: np.ndarray, dy: np.ndarray, min_length: float):
    """Borders (id, d, lo, hi) of a node's cell against the nodes around it, and its corners (R, owned).

    The border with a node lies on the bisector, from lo to hi as seen from the point between the two, turning left. Every
    other node limits it from one side. A corner is owned by the least of the nodes as far from it as this one.
    """
    away = (dx != 0) | (dy != 0)
    ids, dx, dy = ids[away], dx[away], dy[away]
    d2 = dx * dx + dy * dy
    d = np.sqrt(d2)
    lo, hi = np.full(len(d), -np.inf), np.full(len(d), np.inf)
    for at in range(0, len(d), 256):
        j = slice(at, at + 256)
        c = 2 * (dx[j, None] * dy - dy[j, None] * dx) / d[j, None]
        e = d2 - (dx[j, None] * dx + dy[j, None] * dy)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = e / c
        hi[j] = np.where(c > 0, t, np.inf).min(1, initial=np.inf)
        lo[j] = np.where(c < 0, t, -np.inf).max(1, initial=-np.inf)
        lo[j][((c == 0) & (e < 0)).any(1)] = np.inf
    real = np.flatnonzero((lo < hi) & (np.minimum(hi, 1e300) - np.maximum(lo, -1e300) > min_length))
    corners, sure = [], len(real) > 0
    for j in real:
        sure = sure and np.isfinite(lo[j]) and np.isfinite(hi[j])
        if np.isfinite(hi[j]):
            r = math.hypot(d[j] / 2, hi[j])
            x, y = dx[j] / 2 - hi[j] * dy[j] / d[j], dy[j] / 2 + hi[j] * dx[j] / d[j]
            also = ids[np.abs(np.hypot(dx - x, dy - y) - r) <= 2 * min_length]
            corners.append((r, not (also < own).any()))
    return [(int(ids[j]), float(d[j]), float(lo[j]), float(hi[j])) for j in real], corners, sure


_BORDERS = "array<struct<id2:long,d:double,lo:double,hi:double>>"
_SOLVED = pa.schema([("row", pa.int64()), ("sure", pa.bool_()), ("borders", pa.list_(pa.struct(
    [("id2", pa.int64()), ("d", pa.float64()), ("lo", pa.float64()), ("hi", pa.float64())]))), ("corners", pa.list_(pa.float64()))])


def _solve(min_length: float):
    def run(batches):
        for rows in batches:
            out = {c: [] for c in _SOLVED.names}
            columns = [rows.column(c).to_pylist() for c in ("row", "own", "reach", "n", "ids", "dx", "dy")]
            for row, own, reach, n, ids, dx, dy in zip(*columns):
                borders, corners, sure = _cell(own, np.array(ids, np.int64), np.array(dx), np.array(dy), min_length)
                out["row"].append(row)
                out["sure"].append(len(ids) >= n or (sure and 2 * max(r for r, _ in corners) <= reach))
                out["borders"].append([dict(zip(("id2", "d", "lo", "hi"), b)) for b in borders if b[0] > own])
                out["corners"].append([r for r, owned in corners if owned])
            yield pa.record_batch([pa.array(out[f.name], f.type) for f in _SOLVED], schema=_SOLVED)
    return run


def voronoi_cells(nodes: DataFrame, min_length: float = MIN_LENGTH) -> tuple[DataFrame, DataFrame]:
    """All borders (species, node1, node2, d, lo, hi) and corners (species, radius) of the unclipped cells.

    A border runs from lo to hi along the bisector, infinite at the outer cells. A node's list holds the nodes within its
    reach; only nodes at the rim of a species' range come to hold all of its cells, whose number the grid sets.
    """
    kind = nodes.schema["id"].dataType
    box = nodes.groupBy("species").agg(
        F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    box = box.select("species", "n", F.hypot("w", "h").alias("extent"))
    spacing = 2.5 * F.col("extent") / F.sqrt("n")
    left = checkpoint(nodes.select("species", "id", "x", "y").join(box, "species").withColumns({
        "reach": F.when(F.col("extent") > 0, F.least(spacing, 1.001 * F.col("extent"))).otherwise(1.0),
        "row": F.monotonically_increasing_id()}))
    right, open_, found = left.select("species", F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2")), left, None
    while True:
        reach = open_.groupBy("species").agg(F.max("reach").alias("reach"))
        pairs = near_pairs(open_, right.join(reach, "species"), "reach", ["species"])
        around = F.sort_array(F.collect_list(F.struct("id2", (F.col("x2") - F.col("x")).alias("dx"), (F.col("y2") - F.col("y")).alias("dy"))))
        lists = (pairs.groupBy("row", F.col("id").alias("own"), "reach", "n").agg(around.alias("a"))
                 .select("row", F.col("own").cast("long").alias("own"), "reach", "n", F.col("a.id2").cast("array<long>").alias("ids"),
                         F.col("a.dx").alias("dx"), F.col("a.dy").alias("dy")))
        solved = checkpoint(lists.mapInArrow(_solve(min_length), f"row long, sure boolean, borders {_BORDERS}, corners array<double>"))
        done = solved.filter("sure").join(left.select("row", "species", "id"), "row")
        found = done if found is None else found.unionByName(done)
        open_ = checkpoint(open_.join(solved.filter("not sure").select("row"), "row").withColumn(
            "reach", F.least(WIDER * F.col("reach"), 1.001 * F.col("extent"))))
        if open_.isEmpty():
            break
    found = checkpoint(found)
    borders = found.select("species", F.col("id").alias("node1"), F.explode("borders").alias("b")).select(
        "species", "node1", F.col("b.id2").cast(kind).alias("node2"), "b.d", "b.lo", "b.hi")
    return borders, found.select("species", F.explode("corners").alias("radius"))


def whole_radius(nodes: DataFrame, borders: DataFrame, corners: DataFrame, start: float = 10_000.0,
                 growth: float = 1.1) -> DataFrame:
    """Least ``start * growth^n`` whose discs around the nodes form one piece without holes: species, steps, radius.

    The union of the discs has as many holes as pieces less its Euler number, which is nodes less touching pairs of
    clipped cells plus corners inside: all three are counts of what a radius reaches. So only the steps with Euler number 1 are looked
    at, the least first, until there is one piece.
    """
    def step(r):
        return F.greatest(F.ceil(F.log(r / start) / math.log(growth) - 1e-9), F.lit(0)).cast("int")

    outside = F.greatest("lo", -F.col("hi"), F.lit(0.0))  # of the point between the nodes from their border
    edges = checkpoint(borders.select("species", "node1", "node2", step(F.hypot(F.col("d") / 2, outside)).alias("steps")))
    events = (nodes.groupBy("species").agg(F.count("*").alias("by")).select("species", F.lit(0).alias("steps"), "by")
              .union(edges.select("species", "steps", F.lit(-1))).union(corners.select("species", step(F.col("radius")), F.lit(1)))
              .groupBy("species", "steps").agg(F.sum("by").alias("by")))
    up = Window.partitionBy("species").orderBy("steps")
    open_ = checkpoint(events.withColumn("euler", F.sum("by").over(up)).filter("euler = 1").select("species", "steps"))
    found = None
    while True:
        least = checkpoint(open_.groupBy("species").agg(F.min("steps").alias("least")))
        some = nodes.select("species", "id").join(least.select("species"), "species", "left_semi")
        inside = edges.join(least, "species").filter("steps <= least").select("species", "node1", "node2")
        pieces = connected_components(some, inside).groupBy("species").agg(F.countDistinct("label").alias("pieces"))
        judged = checkpoint(least.join(pieces, "species"))
        done = judged.filter("pieces = 1").select("species", F.col("least").alias("steps"))
        found = done if found is None else found.union(done)
        open_ = checkpoint(open_.join(judged.filter("pieces > 1"), "species").filter("steps > least").select("species", "steps"))
        if open_.isEmpty():
            return found.withColumn("radius", F.lit(start) * F.pow(F.lit(growth), F.col("steps")))


def _span(p, v, low, high):
    """From and to of the t with low <= p + t v <= high; from above to where there is none."""
    far = F.lit(float("inf"))
    a, b = (low - p) / F.nullif(v, F.lit(0.0)), (high - p) / F.nullif(v, F.lit(0.0))
    flat = (low <= p) & (p <= high)
    return (F.coalesce(F.least(a, b), F.when(flat, -far).otherwise(far)),
            F.coalesce(F.greatest(a, b), F.when(flat, far).otherwise(-far)))


def within_hull(nodes: DataFrame, borders: DataFrame, distance: float) -> DataFrame:
    """Borders cut to the nodes' convex hull buffered by ``distance``: species, node1, node2, lo, hi.

    The buffered hull is the hull, a rectangle on each of its sides and a disc at each corner. It is convex, so a
    bisector runs inside it from the least to the greatest place that it has in one of these parts.
    """
    at = nodes.select("species", F.col("id").alias("node1"), "x", "y")
    to = nodes.select("species", F.col("id").alias("node2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    lines = borders.join(at, ["species", "node1"]).join(to, ["species", "node2"]).select(
        "species", "node1", "node2", "lo", "hi", ((F.col("x") + F.col("x2")) / 2).alias("mx"), ((F.col("y") + F.col("y2")) / 2).alias("my"),
        ((F.col("y") - F.col("y2")) / F.col("d")).alias("ux"), ((F.col("x2") - F.col("x")) / F.col("d")).alias("uy"))
    hull = convex_hull(nodes.select("species", "x", "y"), ["species"])
    ring = F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    sides = (hull.groupBy("species").agg(ring.alias("ring")).select("species", F.explode(G.ring_edges(F.col("ring"))).alias("e"))
             .select("species", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), (F.col("e.b.x") - F.col("e.a.x")).alias("bx"),
                     (F.col("e.b.y") - F.col("e.a.y")).alias("by")).withColumn("side", F.hypot("bx", "by")).filter("side > 0"))
    px, py = F.col("mx") - F.col("ax"), F.col("my") - F.col("ay")
    along = (px * F.col("bx") + py * F.col("by")) / F.col("side"), (F.col("ux") * F.col("bx") + F.col("uy") * F.col("by")) / F.col("side")
    out = (px * F.col("by") - py * F.col("bx")) / F.col("side"), (F.col("ux") * F.col("by") - F.col("uy") * F.col("bx")) / F.col("side")
    far, reach = F.lit(float("inf")), F.lit(float(distance))
    inside = _span(*out, -far, F.lit(0.0))
    strip, upright = _span(*along, F.lit(0.0), F.col("side")), _span(*out, F.lit(0.0), reach)
    strip = F.greatest(strip[0], upright[0]), F.least(strip[1], upright[1])
    b = px * F.col("ux") + py * F.col("uy")
    root = b * b - (px * px + py * py) + reach * reach
    disc = F.when(root >= 0, -b - F.sqrt(root)), F.when(root >= 0, -b + F.sqrt(root))
    parts = lines.join(sides, "species").groupBy("species", "node1", "node2", "lo", "hi").agg(
        F.max(inside[0]).alias("in0"), F.min(inside[1]).alias("in1"), F.min(F.when(strip[0] <= strip[1], strip[0])).alias("s0"),
        F.max(F.when(strip[0] <= strip[1], strip[1])).alias("s1"), F.min(disc[0]).alias("d0"), F.max(disc[1]).alias("d1"))
    real = F.col("in0") <= F.col("in1")
    return parts.select("species", "node1", "node2",
                        F.greatest("lo", F.least(F.when(real, F.col("in0")), "s0", "d0")).alias("lo"),
                        F.least("hi", F.greatest(F.when(real, F.col("in1")), "s1", "d1")).alias("hi"))


def voronoi_neighbours(nodes: DataFrame, start: float = 10_000.0, growth: float = 1.1, min_length: float = MIN_LENGTH, *,
                       clip: str = "buffer", strict: bool = False) -> DataFrame:
    """Edges between nodes whose clipped Voronoi cells share a border: species, node1 < node2.

    ``clip`` "buffer" cuts the cells to discs of ``whole_radius`` around the nodes, "hull" to the convex hull of the nodes
    buffered by ``start``. ``strict`` raises an error where a node is left without a neighbour.
    """
    if clip not in ("buffer", "hull"):
        raise ValueError(f"no clip {clip!r}")
    nodes = checkpoint(nodes.select("species", "id", "x", "y"))
    borders, corners = voronoi_cells(nodes, min_length)
    if clip == "hull":
        cut = within_hull(nodes, borders, start)
    else:
        half = F.sqrt(F.greatest(F.col("radius") * F.col("radius") - F.col("d") * F.col("d") / 4, F.lit(0.0)))
        cut = borders.join(whole_radius(nodes, borders, corners, start, growth), "species").withColumns(
            {"lo": F.greatest("lo", -half), "hi": F.least("hi", half)})
    edges = cut.filter(F.col("hi") - F.col("lo") > min_length).select("species", "node1", "node2")
    if strict:
        from .neighbours import unlinked_nodes
        alone = unlinked_nodes(nodes, edges).select("species", "id").head(5)
        if alone:
            raise ValueError(f"nodes without a neighbour: {[tuple(r) for r in alone]}")
    return edges
