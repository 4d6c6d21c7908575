"""Registered queries: projection, cells, polygons, distance joins, neighbour graphs.

Customers are sites; market segments and nations stand for species, so that each
has its own set of occupied cells.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import coverage, neighbours, spatial, voronoi
from . import testdata as T
from .registry import query
from .testdata import sql


def _mm(df, *columns):
    return df.withColumns({c: F.round(F.col(c), 3) for c in columns})


@query(sql("site_xy", "SELECT locality_id, round(x, 3) AS x, round(y, 3) AS y FROM site_xy"))
def project_laea(spark, sf):
    return _mm(spatial.project_laea(T.sites(spark, sf)).select("locality_id", "x", "y"), "x", "y")


@query(sql("sites", """SELECT locality_id, round(6378137e0 * radians(longitude), 3) AS x,
    round(6378137e0 * radians(latitude), 3) AS y FROM sites"""))
def project_equidistant(spark, sf):
    x, y = G.equidistant(F.col("longitude"), F.col("latitude"))
    return _mm(T.sites(spark, sf).select("locality_id", x.alias("x"), y.alias("y")), "x", "y")


@query(sql("site_hex", "SELECT locality_id, q, r, hex_name FROM site_hex"))
def hex_assign(spark, sf):
    return T.site_cells(spark, sf).select("locality_id", "q", "r", "hex_name")


_CELLS = """cells AS (SELECT DISTINCT c_mktsegment AS species, hex_name, q, r,
      (q + r / 2e0) * 300000e0 AS x, r * (1.5e0 * 300000e0 / sqrt(3e0)) AS y
    FROM site_hex JOIN customer ON c_custkey = locality_id),
    nodes AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY species ORDER BY hex_name) AS INTEGER) AS id FROM cells),
    touch AS (SELECT a.species, a.id AS node1, b.id AS node2 FROM nodes a
      JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)) s(dq, dr) ON true
      JOIN nodes b ON b.species = a.species AND b.q = a.q + dq AND b.r = a.r + dr WHERE a.id < b.id)"""


def _with(needs, extra, body):
    return sql(needs, "@@").replace("\n@@", f",\n{extra}\n{body}")


def _nodes(spark, sf):
    """Occupied cells per species with integer ids, rings and centres."""
    owner = T.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("locality_id"), F.col("c_mktsegment").alias("species"))
    used = T.site_cells(spark, sf).join(owner, "locality_id").select("species", "hex_name", "q", "r").distinct()
    grid = spatial.hex_grid(used, T.HEX_WIDTH).drop("q", "r")
    codes = coverage.dense_codes(used, ["species"], "hex_name", "id")
    return codes.join(grid, "hex_name")


@query(_with("site_hex", _CELLS, """SELECT DISTINCT hex_name, round(x, 3) AS x, round(y, 3) AS y,
    round(1.5e0 * sqrt(3e0) * (300000e0 / sqrt(3e0)) ** 2 / 1e6, 3) AS area_km2 FROM cells"""))
def hex_centroids(spark, sf):
    grid = spatial.hex_grid(T.site_cells(spark, sf), T.HEX_WIDTH).select("hex_name", "ring")
    out = spatial.polygon_measures(grid)
    return out.select("hex_name", F.round("cx", 3).alias("x"), F.round("cy", 3).alias("y"),
                      F.round(F.col("area") / 1e6, 3).alias("area_km2"))


@query(_with("site_hex", _CELLS, """SELECT species, round(avg(x), 3) AS x, round(avg(y), 3) AS y,
    round(min(x) - 150000e0, 3) AS xmin, round(max(x) + 150000e0, 3) AS xmax FROM cells GROUP BY 1"""))
def merged_centroids(spark, sf):
    out = spatial.merged_centroids(_nodes(spark, sf).select("species", "ring"), "species")
    return _mm(out.select("species", "x", "y", "xmin", "xmax"), "x", "y", "xmin", "xmax")


_EQ = """eq AS (SELECT locality_id, 6378137e0 * radians(longitude) AS x,
    6378137e0 * radians(latitude) AS y FROM sites)"""


def _plane(spark, sf):
    x, y = G.equidistant(F.col("longitude"), F.col("latitude"))
    return T.sites(spark, sf).select("locality_id", x.alias("x"), y.alias("y"))


@query(_with("sites", _EQ, """SELECT a.locality_id, count(*) AS n_near,
      string_agg(CAST(b.locality_id AS VARCHAR), '-' ORDER BY b.locality_id) AS near_ids
    FROM eq a JOIN eq b ON abs(a.x - b.x) < 150000 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 150000
    GROUP BY 1"""))
def near_sites(spark, sf):
    out = spatial.near_sites(_plane(spark, sf), 150_000.0)
    return out.select("locality_id", "n_near", "near_ids")


@query(_with("sites", _EQ + """,
    places AS (SELECT x, y, count(*) AS n_sites FROM eq GROUP BY 1, 2)""", """
    SELECT round(a.x, 3) AS x, round(a.y, 3) AS y, a.n_sites, round(b.x, 3) AS x2, round(b.y, 3) AS y2,
      b.n_sites AS n_sites2, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 3) AS distance
    FROM places a JOIN places b ON abs(a.x - b.x) < 150000
      AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 150000"""))
def near_places(spark, sf):
    return _mm(spatial.near_places(_plane(spark, sf), 150_000.0), "x", "y", "x2", "y2", "distance")


_HAVERSINE = """2 * 6371008.8e0 * asin(sqrt(least(1, sin(radians(b.latitude - a.latitude) / 2) ** 2
    + cos(radians(a.latitude)) * cos(radians(b.latitude)) * sin(radians(b.longitude - a.longitude) / 2) ** 2)))"""


@query(sql("sites", f"""SELECT a.locality_id, count(*) AS n_near,
      string_agg(CAST(b.locality_id AS VARCHAR), '-' ORDER BY b.locality_id) AS near_ids
    FROM sites a JOIN sites b ON {_HAVERSINE} < 120000e0 GROUP BY 1"""))
def near_sites_great_circle(spark, sf):
    out = spatial.near_sites(T.sites(spark, sf), 120_000.0, great_circle=True)
    return out.select("locality_id", "n_near", "near_ids")


@query(_with("sites", _EQ, """SELECT a.locality_id, count(*) AS n_near,
      string_agg('site ' || CAST(b.locality_id AS VARCHAR), '-' ORDER BY b.locality_id) AS near_names
    FROM eq a JOIN eq b ON abs(a.x - b.x) < 150000 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 150000
    GROUP BY 1"""))
def near_site_names(spark, sf):
    named = _plane(spark, sf).withColumn("locality", F.concat(F.lit("site "), "locality_id"))
    return spatial.near_sites(named, 150_000.0, name="locality").select("locality_id", "n_near", "near_names")


_REGIONS_SQL = "regs(poly_id, x0, y0, x1, y1) AS (VALUES " + ", ".join(
    f"('{n}', {a}, {b}, {c}, {d})" for n, (a, b, c, d) in T.REGIONS.items()) + ")"


@query(_with("site_xy", _REGIONS_SQL, """SELECT locality_id, poly_id, round(distance, 3) AS distance FROM (
      SELECT locality_id, poly_id, distance,
             row_number() OVER (PARTITION BY locality_id ORDER BY distance, poly_id) AS rn
      FROM (SELECT locality_id, poly_id, sqrt(greatest(x0 - x, 0e0, x - x1) ** 2
              + greatest(y0 - y, 0e0, y - y1) ** 2) AS distance FROM site_xy CROSS JOIN regs)) WHERE rn = 1"""))
def nearest_polygon(spark, sf):
    sites = spatial.project_laea(T.sites(spark, sf))
    out = spatial.nearest_polygon(sites, T.regions(spark))
    return _mm(out.select("locality_id", "poly_id", "distance"), "distance")


@query(_with("site_xy", _REGIONS_SQL, """SELECT locality_id, poly_id FROM site_xy JOIN regs
    ON x > x0 AND x < x1 AND y > y0 AND y < y1"""))
def contains_join(spark, sf):
    sites = spatial.project_laea(T.sites(spark, sf))
    return spatial.contains_join(sites, T.regions(spark)).select("locality_id", "poly_id")


# area of hexagon and rectangle: the common width is linear in y between the breakpoints
_OVERLAP = _CELLS + ", " + _REGIONS_SQL + """,
    hx AS (SELECT DISTINCT hex_name, x AS cx, y AS cy, 300000e0 / sqrt(3e0) AS s FROM cells),
    pr AS (SELECT *, greatest(cy - s, y0) AS lo, least(cy + s, y1) AS hi FROM hx CROSS JOIN regs
      WHERE cy - s < y1 AND cy + s > y0 AND cx - 150000e0 < x1 AND cx + 150000e0 > x0),
    cuts AS (SELECT *, unnest([lo, hi, cy - s / 2, cy + s / 2,
        cy + (s - (x1 - cx) / sqrt(3e0)), cy - (s - (x1 - cx) / sqrt(3e0)),
        cy + (s - (x0 - cx) / sqrt(3e0)), cy - (s - (x0 - cx) / sqrt(3e0)),
        cy + (s + (x1 - cx) / sqrt(3e0)), cy - (s + (x1 - cx) / sqrt(3e0)),
        cy + (s + (x0 - cx) / sqrt(3e0)), cy - (s + (x0 - cx) / sqrt(3e0))]) AS brk FROM pr),
    wide AS (SELECT hex_name, poly_id, yy, greatest(0, least(cx + w, x1) - greatest(cx - w, x0)) AS len
      FROM (SELECT *, least(150000e0, (s - abs(yy - cy)) * sqrt(3e0)) AS w
            FROM (SELECT *, least(greatest(brk, lo), hi) AS yy FROM cuts))),
    area AS (SELECT hex_name, poly_id, sum(piece) AS a FROM (
        SELECT hex_name, poly_id, (yy - lag(yy) OVER v) * (len + lag(len) OVER v) / 2 AS piece
        FROM wide WINDOW v AS (PARTITION BY hex_name, poly_id ORDER BY yy)) GROUP BY 1, 2)"""


@query(_with("site_hex", _OVERLAP, """SELECT hx.hex_name AS cell_id, poly_id, round(a / 1e6, 3) AS area_km2
    FROM hx LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY hex_name ORDER BY round(a, 3) DESC, poly_id) AS rn
                       FROM area WHERE round(a, 3) > 0) t ON t.hex_name = hx.hex_name AND rn = 1"""))
def largest_overlap(spark, sf):
    grid = spatial.hex_grid(T.site_cells(spark, sf), T.HEX_WIDTH)
    cells = grid.select(F.col("hex_name").alias("cell_id"), "ring")
    return spatial.largest_overlap(cells, T.regions(spark)).select(
        "cell_id", "poly_id", F.round(F.col("area") / 1e6, 3).alias("area_km2"))


@query(_with("site_hex", _CELLS, "SELECT species, node1, node2 FROM touch"))
def contiguity(spark, sf):
    return neighbours.contiguity(_nodes(spark, sf))


@query(_with("site_hex", _CELLS, "SELECT species, node1, node2 FROM touch"))
def car_edges(spark, sf):
    pairs = neighbours.contiguity(_nodes(spark, sf))
    both = pairs.unionByName(pairs.select("species", F.col("node2").alias("node1"),
                                          F.col("node1").alias("node2")))
    return neighbours.car_edges(both)


@query(_with("site_hex", _CELLS, """SELECT t.species, CAST("from" AS INTEGER) AS "from", CAST("to" AS INTEGER) AS "to",
      round(a.x, 3) AS x_from, round(a.y, 3) AS y_from, round(b.x, 3) AS x_to, round(b.y, 3) AS y_to
    FROM (SELECT species, node1 AS "from", node2 AS "to" FROM touch
          UNION ALL SELECT species, node2, node1 FROM touch) t
    JOIN nodes a ON a.species = t.species AND a.id = "from" JOIN nodes b ON b.species = t.species AND b.id = "to" """))
def neighbour_segments(spark, sf):
    nodes = _nodes(spark, sf)
    out = neighbours.neighbour_segments(nodes, neighbours.contiguity(nodes))
    return _mm(out.select("species", "from", "to", "x_from", "y_from", "x_to", "y_to"),
               "x_from", "y_from", "x_to", "y_to")


@query(_with("site_hex", _CELLS, """SELECT species, node1, node2 FROM touch UNION
    SELECT species, least(id, id2), greatest(id, id2) FROM (
      SELECT a.species, a.id, b.id AS id2, row_number() OVER (PARTITION BY a.species, a.id
          ORDER BY round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 3), b.id) AS rn
      FROM nodes a JOIN nodes b ON b.species = a.species AND b.id <> a.id
      WHERE NOT EXISTS (SELECT 1 FROM touch t WHERE t.species = a.species AND a.id IN (t.node1, t.node2)))
    WHERE rn <= 2"""))
def knn_fill(spark, sf):
    nodes = _nodes(spark, sf)
    return neighbours.knn_fill(nodes, neighbours.contiguity(nodes))


@query()
def link_components(spark, sf):
    """Rows only; the tests compare with a plain loop on small graphs."""
    nodes = _nodes(spark, sf)
    return neighbours.link_components(nodes, neighbours.contiguity(nodes))


# borders of all cells, and corners at their ends, each at the least of the nodes around it
_BORDERS = """
    near AS (SELECT a.species, a.id AS i, b.id AS j, a.x AS xi, a.y AS yi, b.x - a.x AS dx, b.y - a.y AS dy,
        sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS d FROM nodes a JOIN nodes b ON b.species = a.species AND b.id <> a.id),
    bound AS (SELECT * FROM (SELECT p.species, i, j, any_value(xi) AS xi, any_value(yi) AS yi, any_value(dx) AS dx, any_value(dy) AS dy,
        any_value(d) AS d, coalesce(min(CASE WHEN c > 0 THEN e / c END), 'inf'::DOUBLE) AS hi,
        coalesce(max(CASE WHEN c < 0 THEN e / c END), '-inf'::DOUBLE) AS lo, coalesce(bool_or(c = 0 AND e < 0), false) AS shut
      FROM (SELECT near.*, 2 * (dx * (n.y - yi) - dy * (n.x - xi)) / d AS c,
              (n.x - xi) ** 2 + (n.y - yi) ** 2 - (dx * (n.x - xi) + dy * (n.y - yi)) AS e
            FROM near LEFT JOIN nodes n ON n.species = near.species AND n.id <> i AND n.id <> j) p GROUP BY 1, 2, 3)
      WHERE NOT shut AND hi - lo > 1e-3)"""
_VORONOI = _BORDERS + """,
    ends AS (SELECT species, i, xi + dx / 2 - hi * dy / d AS x, yi + dy / 2 + hi * dx / d AS y, sqrt(d * d / 4 + hi * hi) AS r
      FROM bound WHERE isfinite(hi)),
    corners AS (SELECT species, r FROM ends WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.species = ends.species AND n.id < ends.i
      AND abs(sqrt((n.x - ends.x) ** 2 + (n.y - ends.y) ** 2) - ends.r) <= 2e-3)),
    edges AS (SELECT species, i, j, d, lo, hi, sqrt(d * d / 4 + greatest(lo, -hi, 0) ** 2) AS r FROM bound WHERE i < j),
    steps AS (SELECT unnest(range(0, 80)) AS k),
    links AS (SELECT species, i AS a, j AS b, r FROM edges UNION ALL SELECT species, j, i, r FROM edges),
    reach AS (SELECT species, k, min(id) AS id FROM nodes CROSS JOIN steps GROUP BY 1, 2
      UNION SELECT q.species, q.k, b FROM reach q JOIN links l
        ON l.species = q.species AND l.a = q.id AND l.r <= 10000e0 * 1.1e0 ** q.k),
    radius AS (SELECT species, 10000e0 * 1.1e0 ** min(k) AS b FROM (
        SELECT species, k, count(*) AS c FROM reach GROUP BY 1, 2)
      JOIN (SELECT species, count(*) AS c FROM nodes GROUP BY 1) n USING (species, c)
      WHERE c - (SELECT count(*) FROM edges e WHERE e.species = n.species AND e.r <= 10000e0 * 1.1e0 ** k)
              + (SELECT count(*) FROM corners o WHERE o.species = n.species AND o.r <= 10000e0 * 1.1e0 ** k) = 1 GROUP BY 1)"""


@query(_with("site_hex", _CELLS + "," + _VORONOI, """SELECT species, i AS node1, j AS node2 FROM (
      SELECT edges.*, sqrt(greatest(b * b - d * d / 4, 0)) AS h FROM edges JOIN radius USING (species))
    WHERE least(h, hi) - greatest(-h, lo) > 1e-3""").replace("WITH ", "WITH RECURSIVE ", 1))
def voronoi_neighbours(spark, sf):
    """The SQL tests every node against every pair; the operator only the near ones."""
    return voronoi.voronoi_neighbours(_nodes(spark, sf))


# where a bisector runs within 200 km of the nodes' convex hull: the hull, and all points so near one of its sides or corners
_HULL = _BORDERS + """,
    sides AS (SELECT a.species, a.x AS ax, a.y AS ay, (b.x - a.x) / l AS wx, (b.y - a.y) / l AS wy, l
      FROM (SELECT a.species, a.id AS i, b.id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS l
            FROM nodes a JOIN nodes b ON a.species = b.species AND a.id <> b.id) p
      JOIN nodes a ON a.species = p.species AND a.id = i JOIN nodes b ON b.species = p.species AND b.id = j
      WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.species = p.species
        AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) / l < -1e-3)),
    met AS (SELECT b.species, i, j, lo, hi, l, (px * wx + py * wy) AS s0, ux * wx + uy * wy AS s1, px * wy - py * wx AS q0,
        ux * wy - uy * wx AS q1, px * ux + py * uy AS b, px * px + py * py AS c
      FROM (SELECT b.*, s.*, xi + dx / 2 - ax AS px, yi + dy / 2 - ay AS py, -dy / d AS ux, dx / d AS uy
            FROM bound b JOIN sides s ON s.species = b.species WHERE i < j) b)"""


def _linear(p, v, low, high):
    """SQL of from and to of the t with low <= p + t v <= high."""
    flat = f"{p} >= {low} AND {p} <= {high}"
    return (f"CASE WHEN {v} <> 0 THEN least(({low} - {p}) / {v}, ({high} - {p}) / {v}) WHEN {flat} THEN '-inf'::DOUBLE ELSE 'inf'::DOUBLE END",
            f"CASE WHEN {v} <> 0 THEN greatest(({low} - {p}) / {v}, ({high} - {p}) / {v}) WHEN {flat} THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END")


_IN, _UP, _ALONG = (_linear("q0", "q1", "'-inf'::DOUBLE", "0"), _linear("q0", "q1", "0", "200000e0"), _linear("s0", "s1", "0", "l"))
_HULL += f""",
    part AS (SELECT species, i, j, lo, hi, {_IN[0]} AS in0, {_IN[1]} AS in1, greatest({_UP[0]}, {_ALONG[0]}) AS a0,
        least({_UP[1]}, {_ALONG[1]}) AS a1, b, b * b - c + 200000e0 ** 2 AS root FROM met),
    clipped AS (SELECT species, i, j, lo, hi,
        least(CASE WHEN max(in0) <= min(in1) THEN max(in0) END, min(a0) FILTER (a0 <= a1), min(-b - sqrt(root)) FILTER (root >= 0)) AS t0,
        greatest(CASE WHEN max(in0) <= min(in1) THEN min(in1) END, max(a1) FILTER (a0 <= a1), max(-b + sqrt(root)) FILTER (root >= 0)) AS t1
      FROM part GROUP BY 1, 2, 3, 4, 5)"""


@query(_with("site_hex", _CELLS + "," + _HULL, """SELECT species, i AS node1, j AS node2, round(greatest(lo, t0), 2) AS from_m,
    round(least(hi, t1), 2) AS to_m FROM clipped WHERE least(hi, t1) - greatest(lo, t0) > 1e-3"""))
def voronoi_hull_borders(spark, sf):
    """Borders of cells clipped to the buffered convex hull, as places along their bisectors."""
    nodes = _nodes(spark, sf)
    cut = voronoi.within_hull(nodes, voronoi.voronoi_cells(nodes)[0], 200_000.0).filter("hi - lo > 1e-3")
    return cut.select("species", "node1", "node2", F.round("lo", 2).alias("from_m"), F.round("hi", 2).alias("to_m"))


@query(_with("site_hex", _CELLS + "," + _HULL, """SELECT species, i AS node1, j AS node2 FROM clipped
    WHERE least(hi, t1) - greatest(lo, t0) > 1e-3"""))
def voronoi_hull_neighbours(spark, sf):
    return voronoi.voronoi_neighbours(_nodes(spark, sf), 200_000.0, clip="hull")


@query(_with("site_xy", """pts AS (SELECT c_nationkey AS species, x, y FROM site_xy
      JOIN customer ON c_custkey = locality_id)""", """
    SELECT species, round(a.x, 3) AS x, round(a.y, 3) AS y FROM pts a JOIN pts b USING (species)
    WHERE (a.x <> b.x OR a.y <> b.y) AND NOT EXISTS (
      SELECT 1 FROM pts c WHERE c.species = a.species
        AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < -1e-3) GROUP BY ALL"""))
def convex_hull(spark, sf):
    owner = T.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("locality_id"), F.col("c_nationkey").alias("species"))
    pts = spatial.project_laea(T.sites(spark, sf)).join(owner, "locality_id")
    return _mm(spatial.convex_hull(pts, ["species"]).drop("seq"), "x", "y")
