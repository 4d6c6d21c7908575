import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from flockframe.functions import geometry as G
from flockframe.operators import neighbours as N, voronoi as V


def node_frame(spark, groups):
    data = [(s, i, float(x), float(y)) for s, pts in groups.items() for i, (x, y) in enumerate(pts, 1)]
    return spark.createDataFrame(data, "species string, id int, x double, y double")


def edge_frame(spark, groups):
    data = [(s, a, b) for s, e in groups.items() for a, b in e]
    return spark.createDataFrame(data, "species string, node1 int, node2 int")


def cloud(n, seed, scale=1000.0):
    r = random.Random(seed)
    return [(r.uniform(0, scale), r.uniform(0, scale)) for _ in range(n)]


def components(n, edges):
    label = list(range(n + 1))
    done = False
    while not done:
        done = True
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                done = False
    return {i: label[i] for i in range(1, n + 1)}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    star = [(1, i) for i in range(2, 31)]
    nodes = node_frame(spark, {"chain": cloud(61, 1), "star": cloud(35, 2)})
    got = rows(N.connected_components(nodes, edge_frame(spark, {"chain": chain, "star": star}))
               .select("species", "id", "label"))
    want = sorted([("chain", i, m) for i, m in components(61, chain).items()]
                  + [("star", i, m) for i, m in components(35, star).items()])
    assert got == want


def linked(pts, edges, factor=1.2):
    """Plain loop of the linking rule."""
    edges = {tuple(sorted(e)) for e in edges}
    n = len(pts)

    def d(a, b):
        return math.hypot(pts[a - 1][0] - pts[b - 1][0], pts[a - 1][1] - pts[b - 1][1])
    while True:
        label = components(n, edges)
        main = [i for i in label if label[i] == min(label.values())]
        out = [i for i in label if i not in main]
        if not out:
            return edges
        near, a, _ = min((d(a, b), a, b) for a in main for b in out)
        edges |= {tuple(sorted((a, b))) for b in out if d(a, b) == near or d(a, b) < near * factor}


def test_link_components_follows_the_rule(spark):
    groups = {"a": cloud(14, 3), "b": cloud(9, 4)}
    edges = {"a": [(1, 2), (3, 4), (5, 6), (6, 7), (8, 9), (10, 11), (12, 13), (13, 14), (9, 10)],
             "b": [(1, 2), (2, 3), (4, 5), (5, 6), (7, 8), (8, 9)]}
    got = rows(N.link_components(node_frame(spark, groups), edge_frame(spark, edges)))
    want = sorted((s, *e) for s, pts in groups.items() for e in linked(pts, edges[s]))
    assert got == want


def test_knn_fill_links_lonely_nodes_both_ways(spark):
    pts = [(0, 0), (1, 0), (0, 1), (10, 10), (12, 10)]
    got = rows(N.knn_fill(node_frame(spark, {"a": pts}), edge_frame(spark, {"a": [(1, 2), (1, 3)]})))
    assert {("a", 1, 2), ("a", 1, 3)} <= set(got)
    for i in (4, 5):
        others = sorted((math.hypot(pts[i - 1][0] - x, pts[i - 1][1] - y), j)
                        for j, (x, y) in enumerate(pts, 1) if j != i)[:2]
        assert all(("a", *sorted((i, j))) in got for _, j in others)


def voronoi(pts, b, eps=1e-3):
    """Edge test on every pair against every other node."""
    out = set()
    for i, (xi, yi) in enumerate(pts, 1):
        for j, (xj, yj) in enumerate(pts, 1):
            d = math.hypot(xi - xj, yi - yj)
            if i >= j or d > 2 * b:
                continue
            lo, hi = -math.sqrt(b * b - d * d / 4), math.sqrt(b * b - d * d / 4)
            ux, uy = -(yj - yi) / d, (xj - xi) / d
            mx, my = (xi + xj) / 2, (yi + yj) / 2
            for k, (xk, yk) in enumerate(pts, 1):
                if k in (i, j):
                    continue
                # |m + t u - k|^2 >= |m + t u - i|^2 as t * c <= e
                c = 2 * (ux * (xk - xi) + uy * (yk - yi))
                e = xk ** 2 + yk ** 2 - xi ** 2 - yi ** 2 - 2 * (mx * (xk - xi) + my * (yk - yi))
                if c > 0:
                    hi = min(hi, e / c)
                elif c < 0:
                    lo = max(lo, e / c)
                elif e < 0:
                    hi = lo
            if hi - lo > eps:
                out.add((i, j))
    return out


def corners(pts):
    """Radii of the circles through three or more points that hold no other, each circle once."""
    n, out = len(pts), {}
    for i in range(n):
        for j in range(i):
            for k in range(j):
                (ax, ay), (bx, by), (cx, cy) = pts[i], pts[j], pts[k]
                t = 2 * ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
                if abs(t) < 1e-9:
                    continue
                b2, c2 = (bx - ax) ** 2 + (by - ay) ** 2, (cx - ax) ** 2 + (cy - ay) ** 2
                x, y = ((cy - ay) * b2 - (by - ay) * c2) / t, ((bx - ax) * c2 - (cx - ax) * b2) / t
                r = math.hypot(x, y)
                gaps = [math.hypot(ax + x - px, ay + y - py) - r for px, py in pts]
                if min(gaps) > -1e-3:
                    out[tuple(q for q, g in enumerate(gaps) if g < 1e-3)] = r
    return list(out.values())


def steps_needed(pts, start, growth):
    """Steps until the discs are one piece and their Euler number says that there is no hole."""
    n, circles = 0, corners(pts)
    while True:
        b = start * growth ** n
        near = [(i, j) for i, p in enumerate(pts, 1) for j, q in enumerate(pts, 1)
                if i < j and math.hypot(p[0] - q[0], p[1] - q[1]) <= 2 * b]
        euler = len(pts) - len(voronoi(pts, b, 0.0)) + sum(r <= b for r in circles)
        if len(set(components(len(pts), near).values())) == 1 and euler == 1:
            return n
        n += 1


def ring(n=12, seed=8, a=100_000.0, b=70_000.0, jitter=3000.0):
    r = random.Random(seed)
    return [(a * math.cos(2 * math.pi * k / n) + r.uniform(-jitter, jitter),
             b * math.sin(2 * math.pi * k / n) + r.uniform(-jitter, jitter)) for k in range(n)]


def test_voronoi_neighbours_against_brute_force(spark):
    lattice = [(x + (y % 2) / 2, y * 0.75 ** 0.5) for x in range(5) for y in range(4) if (x, y) not in ((2, 1), (2, 2))]
    groups = {"a": cloud(25, 5), "b": cloud(12, 6, 300.0), "c": [(0, 0), (500, 0), (500, 500), (900, 450)],
              "ring": [(x / 100, y / 100) for x, y in ring()], "lattice": [(300 * x, 300 * y) for x, y in lattice],
              "one": [(5, 5)], "line": [(0, 0), (100, 0), (350, 0)], "two": [(0, 0), (30, 40)],
              "remote": [*cloud(15, 7, 500.0), (20_000, 9_000)]}
    nodes = node_frame(spark, groups)
    borders, corner = V.voronoi_cells(nodes)
    radii = {r.species: r.steps for r in V.whole_radius(nodes, borders, corner, 10.0, 1.1).collect()}
    want = set()
    for s, pts in groups.items():
        n = steps_needed(pts, 10.0, 1.1)
        assert (s, radii[s]) == (s, n)
        want |= {(s, *e) for e in voronoi(pts, 10.0 * 1.1 ** n)}
    got = {tuple(r) for r in V.voronoi_neighbours(nodes, 10.0, 1.1).collect()}
    assert got == want
    assert rows(N.unlinked_nodes(nodes, V.voronoi_neighbours(nodes, 10.0, 1.1)).select("species")) == [("one",)]
    with pytest.raises(ValueError, match="one"):
        V.voronoi_neighbours(nodes, 10.0, 1.1, strict=True)


def test_a_ring_of_cells_closes(spark):
    """The discs grow until the middle of the ring is covered; then opposite cells meet there."""
    pts = ring()
    nodes = node_frame(spark, {"ring": pts})
    radius = V.whole_radius(nodes, *V.voronoi_cells(nodes)).first()["radius"]
    assert radius > 60_000
    side = [i * 1000.0 for i in range(-200, 201, 5)]
    dry = {(x, y) for x in side for y in side if all(math.hypot(x - a, y - b) > radius for a, b in pts)}
    reached, todo = set(), [(side[0], side[0])]
    while todo:
        x, y = todo.pop()
        if (x, y) in dry and (x, y) not in reached:
            reached.add((x, y))
            todo += [(x + 5000, y), (x - 5000, y), (x, y + 5000), (x, y - 5000)]
    assert reached == dry
    edges = {tuple(r)[1:] for r in V.voronoi_neighbours(nodes).collect()}
    assert {(i, i + 1) for i in range(1, 12)} | {(1, 12)} < edges and len(edges) > 12


def test_a_remote_cell_leaves_the_others_corners(spark):
    pts = cloud(60, 9, 50_000.0)
    near, far = ({(r["node1"], r["node2"]): (r["lo"], r["hi"]) for r in V.voronoi_cells(node_frame(spark, {"a": p}))[0].collect()}
                 for p in (pts, [*pts, (9e6, 9e6)]))
    kept = [e for e, (lo, hi) in near.items() if max(abs(lo), abs(hi)) < 20_000]
    assert len(kept) > 100 and all(abs(near[e][0] - far[e][0]) + abs(near[e][1] - far[e][1]) < 1e-6 for e in kept)


def hull_gap(pts, x, y):
    """Distance of a point from the convex hull, by its sides and all points."""
    sides = []
    for ax, ay in pts:
        for bx, by in pts:
            if (ax, ay) != (bx, by) and all((bx - ax) * (cy - ay) - (by - ay) * (cx - ax) >= -1e-9 for cx, cy in pts):
                sides.append((ax, ay, bx, by))
    if sides and all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for ax, ay, bx, by in sides):
        return 0.0
    gaps = [math.hypot(x - a, y - b) for a, b in pts]
    for ax, ay, bx, by in sides:
        d2 = (bx - ax) ** 2 + (by - ay) ** 2
        t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / d2))
        gaps.append(math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
    return min(gaps)


def test_cells_clipped_to_the_buffered_hull(spark):
    groups = {"a": cloud(20, 11), "b": cloud(7, 12), "line": [(0, 0), (100, 0), (350, 0)]}
    nodes = node_frame(spark, groups)
    borders, _ = V.voronoi_cells(nodes)
    cut = {(r["species"], r["node1"], r["node2"]): (r["lo"], r["hi"]) for r in V.within_hull(nodes, borders, 40.0).collect()}
    assert len(cut) == borders.count()
    for r in borders.collect():
        pts = groups[r["species"]]
        (ax, ay), (bx, by) = pts[r["node1"] - 1], pts[r["node2"] - 1]
        lo, hi = cut[r["species"], r["node1"], r["node2"]]

        def gap(t):
            return hull_gap(pts, (ax + bx) / 2 - t * (by - ay) / r["d"], (ay + by) / 2 + t * (bx - ax) / r["d"])
        if lo < hi:
            assert all(abs(gap(t) - 40) < 1e-6 for t, own in ((lo, r["lo"]), (hi, r["hi"])) if t != own)
            assert gap((lo + hi) / 2) < 40 + 1e-6 and gap(lo) < 40 + 1e-6 and gap(hi) < 40 + 1e-6
        else:
            assert all(gap(max(r["lo"], -1e5) + k * (min(r["hi"], 1e5) - max(r["lo"], -1e5)) / 50) > 40 - 1e-6 for k in range(51))
    edges = {tuple(r) for r in V.voronoi_neighbours(nodes, 40.0, clip="hull").collect()}
    assert edges == {e for e, (lo, hi) in cut.items() if hi - lo > 1e-3}


def test_contiguity_needs_a_whole_edge(spark):
    cells = [(0, 0), (1, 0), (0, 1), (5, 5)]
    df = spark.createDataFrame([("s", i, q, r) for i, (q, r) in enumerate(cells, 1)],
                               "species string, id int, q int, r int")
    nodes = df.withColumn("ring", G.hex_ring(F.col("q"), F.col("r"), 3e5))
    assert rows(N.contiguity(nodes)) == [("s", 1, 2), ("s", 1, 3), ("s", 2, 3)]


def test_car_edges_and_segments(spark):
    nodes = node_frame(spark, {"a": [(0, 0), (1, 0), (2, 0)]})
    pairs = edge_frame(spark, {"a": [(1, 2), (2, 1), (3, 2), (2, 2)]})
    edges = N.car_edges(pairs)
    assert rows(edges) == [("a", 1, 2), ("a", 2, 3)]
    assert rows(N.edge_counts(edges)) == [("a", 2, 3)]
    seg = rows(N.neighbour_segments(nodes, edges).select("from", "to", "x_from", "x_to"))
    assert seg == [(1, 2, 0, 1), (2, 1, 1, 0), (2, 3, 1, 2), (3, 2, 2, 1)]


def test_contiguity_holds_for_small_units(spark):
    """Overlapping squares of 0.4 degrees, 0.05 apart, share no edge; those side by side do."""
    def square(i, x):
        return ("s", i, [(x, 0.0), (x + 0.4, 0.0), (x + 0.4, 0.4), (x, 0.4)])
    nodes = spark.createDataFrame([square(1, 0.0), square(2, 0.05), square(3, 0.4)],
                                  "species string, id long, ring array<struct<x:double,y:double>>")
    from flockframe.operators import neighbours as N
    assert sorted(map(tuple, N.contiguity(nodes).collect())) == [("s", 1, 3)]
