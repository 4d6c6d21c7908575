import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from flockframe.functions import geometry as G
from flockframe.operators import spatial

RING = "array<struct<x:double,y:double>>"


def points(n, seed, scale=100.0):
    r = random.Random(seed)
    return [(i, r.uniform(0, scale), r.uniform(0, scale)) for i in range(n)]


def pair_frames(spark, a, b):
    return (spark.createDataFrame(a, "id long, x double, y double"),
            spark.createDataFrame(b, "id2 long, x2 double, y2 double"))


@pytest.mark.parametrize("hot", [3, 2000])
def test_near_pairs_with_a_crowded_cell(spark, hot):
    """A third of the points lie in one cell; splitting it changes nothing."""
    a = points(60, 1) + [(1000 + i, 50 + i * 1e-3, 50.0) for i in range(30)]
    left, right = pair_frames(spark, a, a)
    got = {(r.id, r.id2) for r in spatial.near_pairs(left, right, 7.0, hot=hot).collect()}
    want = {(i, j) for i, x, y in a for j, u, v in a if math.hypot(x - u, y - v) <= 7.0}
    assert got == want


def test_near_pairs_with_a_radius_per_group(spark):
    a = [(s, i, x, y) for s in ("p", "q") for i, x, y in points(40, 2)]
    left = spark.createDataFrame([(*r, 5.0 if r[0] == "p" else 20.0) for r in a],
                                 "species string, id long, x double, y double, reach double")
    right = left.select("species", F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "reach")
    got = {(r.species, r.id, r.id2) for r in spatial.near_pairs(left, right, "reach", ["species"]).collect()}
    want = {(s, i, j) for s, i, x, y in a for t, j, u, v in a
            if s == t and math.hypot(x - u, y - v) <= (5.0 if s == "p" else 20.0)}
    assert got == want


def test_near_sites_folds_equal_places(spark):
    a = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 100.0, 0.0), (4, 1000.0, 0.0), (10, 160.0, 0.0)]
    sites = spark.createDataFrame(a, "locality_id long, x double, y double")
    got = rows(spatial.near_sites(sites).select("locality_id", "n_near", "near_ids"))
    assert got == [(1, 3, "1-2-3"), (2, 3, "1-2-3"), (3, 4, "1-2-3-10"), (4, 1, "4"), (10, 2, "3-10")]
    named = sites.withColumn("name", F.when(F.col("locality_id") != 2, F.concat(F.lit("s"), "locality_id")))
    got = {r.locality_id: r.near_names for r in spatial.near_sites(named, name="name").collect()}
    assert got[3] == "s1-NA-s3-s10" and got[4] == "s4"
    assert spatial.near_places(sites).count() == 8


def test_great_circle_at_the_poles_and_the_date_line(spark):
    r = random.Random(9)
    pts = [(i, r.uniform(-180, 180), r.uniform(89.95, 90.0)) for i in range(25)]
    pts += [(100 + i, r.choice((-179.99, 179.99)) + r.uniform(-0.01, 0.01), r.uniform(-0.02, 0.02)) for i in range(25)]
    sites = spark.createDataFrame(pts, "locality_id long, longitude double, latitude double")

    def distance(a, b):
        (la, pa), (lb, pb) = ((math.radians(v) for v in p[1:]) for p in (a, b))
        h = math.sin((pb - pa) / 2) ** 2 + math.cos(pa) * math.cos(pb) * math.sin((lb - la) / 2) ** 2
        return 2 * G.MEAN_RADIUS * math.asin(min(1.0, math.sqrt(h)))
    got = {r.locality_id: r.n_near for r in spatial.near_sites(sites, 1500.0, great_circle=True).collect()}
    assert got == {a[0]: sum(distance(a, b) < 1500.0 for b in pts) for a in pts}


def test_closest_k_against_brute_force(spark):
    a, b = points(25, 3), [(100 + i, x, y) for i, x, y in points(60, 4)] + [(500, 4000.0, 4000.0)]
    left, right = pair_frames(spark, a, b)
    for k in (1, 2):
        got = sorted((r.id, r.id2) for r in spatial.closest(left, right, [], ["id"], k=k).collect())
        want = sorted((i, j) for i, x, y in a
                      for _, j in sorted((math.hypot(x - u, y - v), j) for j, u, v in b)[:k])
        assert got == want


def test_closest_with_too_few_points(spark):
    left, right = pair_frames(spark, points(3, 5), [(7, 1.0, 1.0)])
    assert spatial.closest(left, right, [], ["id"], k=2).count() == 3
    assert spatial.closest(left, right.limit(0), [], ["id"]).count() == 0


def star(cx, cy, r, n, seed):
    g = random.Random(seed)
    return [(cx + r * g.uniform(0.4, 1) * math.cos(2 * math.pi * k / n),
             cy + r * g.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def segment_distance(x, y, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0, min(1, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(a[0] + t * dx - x, a[1] + t * dy - y)


def ring_distance(x, y, ring):
    edges = list(zip(ring, ring[1:] + ring[:1]))
    if sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1])
           for a, b in edges) % 2:
        return 0.0
    return min(segment_distance(x, y, a, b) for a, b in edges)


def test_nearest_polygon_against_brute_force(spark):
    polys = [(f"p{i}", star(*c, 12, 9, i)) for i, c in enumerate([(20, 20), (70, 30), (40, 80), (400, 400)])]
    pts = points(80, 6) + [(900, -300.0, 50.0), (901, 20.0, 20.0), (902, 20.0, 20.0)]
    got = spatial.nearest_polygon(spark.createDataFrame(pts, "id long, x double, y double"),
                                  spark.createDataFrame(polys, f"poly_id string, ring {RING}"))
    want = {i: min((ring_distance(x, y, r), p) for p, r in polys) for i, x, y in pts}
    got = {r.id: (r.distance, r.poly_id) for r in got.collect()}
    assert got.keys() == want.keys()
    for i, (d, p) in want.items():
        assert got[i][1] == p and got[i][0] == pytest.approx(d, abs=1e-9)


def test_contains_join(spark):
    polys = [("p0", star(30, 30, 25, 11, 1)), ("p1", star(60, 60, 30, 7, 2))]
    pts = points(150, 8)
    got = spatial.contains_join(spark.createDataFrame(pts, "id long, x double, y double"),
                                spark.createDataFrame(polys, f"poly_id string, ring {RING}"))
    want = sorted((i, p) for i, x, y in pts for p, r in polys if ring_distance(x, y, r) == 0)
    assert rows(got.select("id", "poly_id")) == want


def clip_area(subject, convex):
    ring = subject
    for a, b in zip(convex, convex[1:] + convex[:1]):
        def side(p):
            return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            if side(p) * side(q) < 0:
                t = side(p) / (side(p) - side(q))
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if side(q) >= 0:
                out.append(q)
        ring = out
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2 if ring else 0.0


def test_largest_overlap_against_plain_clip(spark):
    polys = [("p0", star(30, 30, 45, 12, 3)), ("p1", star(75, 60, 50, 8, 4))]
    cells = spark.range(-1, 8).selectExpr("id q").crossJoin(spark.range(-1, 8).selectExpr("id r")).select(
        F.concat_ws("_", "q", "r").alias("cell_id"), G.hex_ring(F.col("q"), F.col("r"), 15.0).alias("ring"))
    plain = {r.cell_id: [(p.x, p.y) for p in r.ring] for r in cells.collect()}
    got = {r.cell_id: (r.poly_id, r.area) for r in spatial.largest_overlap(
        cells, spark.createDataFrame(polys, f"poly_id string, ring {RING}")).collect()}
    assert got.keys() == plain.keys()
    for c, ring in plain.items():
        area, p = max((clip_area(r, ring), p) for p, r in polys)
        if area < 1e-9:
            assert got[c][0] is None or got[c][1] < 1e-9
        else:
            assert got[c][0] == p and got[c][1] == pytest.approx(area, rel=1e-9)


def test_measures_of_a_known_polygon(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)]
    df = spark.createDataFrame([("a", ring), ("a", [(x + 4, y) for x, y in ring])], f"label string, ring {RING}")
    r = spatial.merged_centroids(df, "label").first()
    assert (r.area, r.x, r.y, r.xmin, r.xmax) == (16.0, 4.0, 1.0, 0.0, 8.0)


def test_convex_hull_drops_inner_and_collinear_points(spark):
    pts = [("s", x, y) for x, y in [(0.0, 0.0), (2.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (1.0, 2.0)]]
    hull = spatial.convex_hull(spark.createDataFrame(pts, "species string, x double, y double"), ["species"],
                               slice_rows=2)
    assert [(r.x, r.y) for r in hull.orderBy("seq").collect()] == [(0, 0), (4, 0), (4, 4), (0, 4)]
    area = spatial.buffered_hull_area(hull, ["species"], 1.0).first().buffered_area
    assert area == pytest.approx(16 + 16 + math.pi)
