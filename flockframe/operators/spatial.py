"""Sites, cells and polygons. Coordinates are planar metres unless named lon/lat."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as G
from ..session import checkpoint, join_on


def project_laea(sites: DataFrame, lon: str = "longitude", lat: str = "latitude", **options) -> DataFrame:
    x, y = G.laea(F.col(lon), F.col(lat), **options)
    return sites.withColumns({"x": x, "y": y})


def hex_assign(sites: DataFrame, width: float) -> DataFrame:
    """Add the hexagon cell (q, r) and its name to sites with planar x, y."""
    q, r = G.hex_cell(F.col("x"), F.col("y"), width)
    return (sites.withColumns({"q": q, "r": r})
            .withColumn("hex_name", F.concat_ws("_", F.col("q").cast("string"), F.col("r").cast("string"))))


def hex_grid(cells: DataFrame, width: float) -> DataFrame:
    """Rings and centres of the distinct cells (q, r, hex_name) of a table."""
    cx, cy = G.hex_centre(F.col("q"), F.col("r"), width)
    return (cells.select("hex_name", "q", "r").distinct()
            .withColumns({"ring": G.hex_ring(F.col("q"), F.col("r"), width), "x": cx, "y": cy}))


def polygon_measures(polygons: DataFrame) -> DataFrame:
    """Add area, centroid and bounding box to polygons with a ``ring`` column."""
    cx, cy = G.centroid(F.col("ring"))
    return polygons.withColumns({"area": F.abs(G.signed_area(F.col("ring"))), "cx": cx, "cy": cy,
                                 **G.bbox(F.col("ring"))})


def merged_centroids(polygons: DataFrame, label: str) -> DataFrame:
    """Area-weighted centroid, area and bounding box of cells united by a label."""
    return polygon_measures(polygons).groupBy(label).agg(
        F.sum("area").alias("area"),
        F.try_divide(F.sum(F.col("cx") * F.col("area")), F.sum("area")).alias("x"),
        F.try_divide(F.sum(F.col("cy") * F.col("area")), F.sum("area")).alias("y"),
        F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"),
        F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"))


# --- distance joins -----------------------------------------------------------


def _cell(c, size):
    return F.floor(F.col(c) / size)


def _straight(gaps):
    return F.hypot(*gaps) if len(gaps) == 2 else F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))


def near_pairs(left: DataFrame, right: DataFrame, radius, keys: list[str] = (), hot: int = 2000,
               axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Pairs (id, id2, distance) with distance <= radius; ids and coordinates from
    ``left(id, x, y)`` and ``right(id2, x2, y2)``, both with the ``keys`` columns.

    ``radius`` is a number or the name of a column constant within ``keys``. Points
    are put in square cells of that size and a point meets only its own cell and
    those around it. Cells with more than ``hot`` right-hand points are split in
    slices that go to different tasks; the left points of such cells are repeated
    once per slice. Only pairs within the radius come out. ``axes`` may name three
    coordinates.
    """
    r = F.lit(float(radius)) if not isinstance(radius, str) else F.col(radius)
    keys, cells = list(keys), [f"__c{a}" for a in axes]
    here = right.withColumns({c: _cell(a + "2", r) for c, a in zip(cells, axes)})
    if isinstance(radius, str):
        here = here.drop(radius)
    at = [*keys, *cells]
    load = (here.groupBy(*at).agg(F.count(F.lit(1)).alias("__load"))
            .select(*at, F.ceil(F.col("__load") / F.lit(float(hot))).cast("int").alias("__slices")))
    here = (here.join(load, at)
            .withColumn("__slice", F.pmod(F.xxhash64("id2"), F.col("__slices")).cast("int"))
            .drop("__slices"))
    there, around = left.withColumn("__r", r), F.array(F.lit(-1), F.lit(0), F.lit(1))
    for c, a in zip(cells, axes):
        there = there.withColumn(c, F.explode(F.transform(around, lambda d: _cell(a, F.col("__r")) + d)))
    there = (there.join(load, at)
             .withColumn("__slice", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1)))
             .drop("__slices"))
    d = _straight([F.col(a) - F.col(a + "2") for a in axes])
    return (there.join(here, [*at, "__slice"]).withColumn("distance", d)
            .filter(F.col("distance") <= F.col("__r"))
            .drop(*cells, "__slice", "__r"))


def _place(great_circle):
    return ["longitude", "latitude"] if great_circle else ["x", "y"]


def _space(threshold: float, great_circle: bool):
    """Axes, reach along them, coordinates by axis from a place, and the distance from the straight one."""
    if not great_circle:
        return ("x", "y"), threshold, {}, lambda d: d
    size = 2 * G.MEAN_RADIUS
    on = dict(zip(("x", "y", "z"), G.on_sphere(F.col("longitude"), F.col("latitude"))))
    return tuple(on), size * math.sin(min(threshold / size, math.pi / 2)), on, lambda d: F.asin(F.least(d / size, F.lit(1.0))) * size


def near_places(sites: DataFrame, threshold: float = 160.0, great_circle: bool = False) -> DataFrame:
    """Pairs of distinct places closer than ``threshold``, each with its number of sites.

    place, n_sites, place2, n_sites2, distance; every place also pairs with itself.
    A place is planar x, y, or with ``great_circle`` longitude and latitude: then
    points are cut into cells in space, so poles and the date line need no care.
    Sites at one and the same spot form one place, so a much used spot is
    compared once and its sites are never paired with each other.
    """
    at = _place(great_circle)
    axes, reach, on, distance = _space(threshold, great_circle)
    places = sites.groupBy(*at).agg(F.count(F.lit(1)).alias("n_sites")).withColumn("id", F.struct(*at)).withColumns(on)
    right = places.select(*[F.col(c).alias(c + "2") for c in places.columns])
    return (near_pairs(places, right, reach, axes=axes).withColumn("distance", distance(F.col("distance")))
            .filter(F.col("distance") < threshold)
            .select(*at, "n_sites", *[c + "2" for c in at], "n_sites2", "distance"))


def near_members(sites: DataFrame, threshold: float = 160.0, site: str = "locality_id",
                 great_circle: bool = False, name: str | None = None) -> DataFrame:
    """Place, id2 [, name2]: every site closer to a place than ``threshold``, one row each.

    The long form of ``near_sites``: places and not sites stand on the left, so a
    much used spot does not multiply its neighbours.
    """
    at = _place(great_circle)
    pairs = near_places(sites, threshold, great_circle).select(*at, *[c + "2" for c in at])
    extra = [F.col(name).alias("name2")] if name else []
    members = sites.select(*[F.col(c).alias(c + "2") for c in at], F.col(site).alias("id2"), *extra)
    return pairs.join(members, [c + "2" for c in at]).drop(*[c + "2" for c in at])


def near_sites(sites: DataFrame, threshold: float = 160.0, site: str = "locality_id",
               great_circle: bool = False, name: str | None = None, hot: int = 2000) -> DataFrame:
    """Per site the number and joined ids of the sites closer than ``threshold`` (itself included).

    ``sites``: site id and equidistant x, y, or longitude, latitude with ``great_circle``. With a
    ``name`` column ``near_names`` joins the names in the order of the ids. The texts are those of
    ``near_members`` and hold all members; a place has one, whatever its number of sites.

    Each place stands in one cell, with its sites, and meets the places of the cells around it, each with the list of
    its members; so neither members nor texts are shuffled. Cells with more than ``hot`` places are split in slices
    that go to different tasks, and the places around are repeated once per slice.
    """
    at = _place(great_circle)
    axes, reach, on, distance = _space(threshold, great_circle)
    places = sites.groupBy(*at).agg(F.collect_list(F.struct(*sites.columns)).alias("__own")).withColumns(on)
    cells, around = [f"__c{a}" for a in axes], F.array(F.lit(-1), F.lit(0), F.lit(1))
    places = places.withColumns({c: _cell(a, F.lit(float(reach))) for c, a in zip(cells, axes)})
    load = places.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(hot))).cast("int").alias("__slices"))
    here = (places.join(load, cells).withColumn("__slice", F.pmod(F.xxhash64(*at), F.col("__slices")).cast("int"))
            .select(*cells, "__slice", *axes, "__own"))
    members = F.transform("__own", lambda s: F.struct(s[site].alias("id2"), *([s[name].alias("name2")] if name else [])))
    goals = load.withColumn("__goal", F.struct(*cells, "__slices"))
    for c in cells:
        goals = goals.withColumn(c, F.explode(F.transform(around, lambda d: F.col(c) + d)))
    goals = goals.groupBy(*cells).agg(F.collect_list("__goal").alias("__goals"))
    there = (places.select(*cells, F.struct(*axes, members.alias("m")).alias("__p")).join(goals, cells)
             .select("__p", F.inline("__goals")).withColumn("__slice", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1)))
             .groupBy(*cells, "__slice").agg(F.collect_list("__p").alias("__around")))

    def near(p):
        d = _straight([F.col(a) - p[a] for a in axes])
        return (d <= reach) & (distance(d) < threshold)

    listed = F.sort_array(F.flatten(F.transform(F.filter("__around", near), lambda p: p.m)))
    joined = {"near_ids": F.array_join(F.col("__cells.id2").cast("array<string>"), "-")}
    if name:
        joined["near_names"] = F.array_join(F.col("__cells.name2").cast("array<string>"), "-", "NA")
    met = here.join(there, [*cells, "__slice"]).select("__own", listed.alias("__cells")).withColumn("n_near", F.size("__cells").cast("long"))
    return (met.filter("n_near > 0").select("__own", "n_near", *[c.alias(k) for k, c in joined.items()])
            .select(F.inline("__own"), "n_near", *joined))


#: Cell sides of a pyramid: from an eighth of the mean spacing, doubling.
FINEST = 1 / 8


def _pyramid(low, high, n: int) -> list[float]:
    """Sides of the cells of each level; a block of 3 x 3 cells of the last one covers the box ``low`` to ``high``."""
    extent = max(math.hypot(high[0] - low[0], high[1] - low[1]), 1e-6)
    finest = extent / max(n, 1) ** 0.5 * FINEST
    return [finest * 2.0 ** i for i in range(max(1, math.ceil(math.log2(extent / finest))) + 1)]


def _at_levels(sides: list[float], x, y):
    """Array of a point's cell at each level."""
    return F.array(*[F.struct(F.lit(i).alias("__level"), F.floor(F.col(x) / s).alias("__px"), F.floor(F.col(y) / s).alias("__py"))
                     for i, s in enumerate(sides)])


def sure_levels(left: DataFrame, right: DataFrame, keys: list[str], sides: list[float], k: int = 1,
                apart: str | None = None) -> DataFrame:
    """Left points with ``__level``: the finest one at which the 3 x 3 cells around the point hold ``k`` right points (the
    last one where none does).

    All of these lie within 2 sqrt(2) sides, so a search with that radius is sure to find the ``k`` closest. The counts of all levels
    are made in one aggregation. With ``apart`` right points of the same ``apart`` value do not count.
    """
    cell, around = [*keys, "__level", "__px", "__py"], F.array(F.lit(-1), F.lit(0), F.lit(1))
    label = [apart + "2"] if apart else []
    counts = (right.select(*keys, *label, F.explode(_at_levels(sides, "x2", "y2")).alias("__c")).select(*keys, *label, "__c.*")
              .groupBy(*cell, *label).agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__px", F.explode(F.transform(around, lambda d: F.col("__px") + d)))
              .withColumn("__py", F.explode(F.transform(around, lambda d: F.col("__py") + d))))
    blocks = counts.groupBy(*cell).agg(F.sum("__n").alias("__n"))
    if apart:
        own = counts.groupBy(*cell, *label).agg(F.sum("__n").alias("__own"))
    at = left.withColumn("__row", F.monotonically_increasing_id())
    at = checkpoint(at)
    told = (at.select("__row", *keys, *([apart] if apart else []), F.explode(_at_levels(sides, "x", "y")).alias("__c"))
            .select("__row", *keys, *([apart] if apart else []), "__c.*").join(blocks, cell))
    if apart:
        told = told.join(own.withColumnRenamed(apart + "2", apart), [*cell, apart], "left").withColumn(
            "__n", F.col("__n") - F.coalesce("__own", F.lit(0)))
    found = told.filter(F.col("__n") >= k).groupBy("__row").agg(F.min("__level").alias("__level"))
    return at.join(found, "__row", "left").drop("__row").fillna(len(sides) - 1, "__level")


def closest(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], *, k: int = 1,
            apart: str | None = None) -> DataFrame:
    """For each ``by`` group of left points its ``k`` closest right points (exact).

    Each point searches once, with a radius that is sure to hold its ``k`` closest (``sure_levels``), among the points of its level.
    Left: keys, by, id, x, y; right: keys, id2, x2, y2. With ``apart`` only pairs differing in that column (``apart`` left,
    ``apart``2 right) count.
    """
    left, right = checkpoint(left), checkpoint(right)
    spread = right.agg(F.min("x2"), F.max("x2"), F.min("y2"), F.max("y2"), F.count(F.lit(1))).first()
    other = left.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    out_cols = list(dict.fromkeys([*keys, *by, "id", "id2", "distance"]))
    if spread[4] == 0 or other[0] is None:
        empty = left.limit(0)
        return (empty.join(right.limit(0), keys) if keys else empty.withColumn(
            "id2", F.lit(None))).withColumn("distance", F.lit(0.0)).select(*out_cols)
    sides = _pyramid((min(spread[0], other[0]), min(spread[2], other[2])), (max(spread[1], other[1]), max(spread[3], other[3])), spread[4])
    radius = F.element_at(F.array(*[F.lit(2.0 ** 1.5 * s * (1 + 1e-9)) for s in sides]), F.col("__level") + 1)
    left = checkpoint(sure_levels(left, right, keys, sides, k, apart).withColumn("__radius", radius))
    levels = left.select(*keys, "__level", "__radius").distinct()
    if keys:
        right = right.join(levels, keys)
    else:
        right = right.withColumn("__level", F.explode(F.array(*[F.lit(i) for i in range(len(sides))]))).join(levels, "__level")
    pairs = near_pairs(left, right, "__radius", [*keys, "__level"]).filter(
        F.lit(True) if apart is None else F.col(apart) != F.col(apart + "2"))
    group = list(dict.fromkeys([*keys, *by]))
    # equal to the millimetre counts as equal
    order = Window.partitionBy(*group).orderBy(F.round("distance", 3), "id", "id2")
    return pairs.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= k).select(*out_cols)


# --- points and polygons ------------------------------------------------------


def _extent(polygons):
    """Largest and mean box side, and the overall box, of a polygon table."""
    box = G.bbox(F.col("ring"))
    side = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])
    return polygons.agg(F.max(side).alias("largest"), F.avg(side).alias("mean"),
                        *[(F.min if n.endswith("min") else F.max)(c).alias(n) for n, c in box.items()]).first()


def _cell_size(extent):
    """Near the mean box side, but with no polygon over more than some 64 cells a side."""
    return max(extent.mean or 0.0, (extent.largest or 0.0) / 64, 1e-9)


def _candidates(points, boxes, radius, size, keys=()):
    """Points with the ids of the polygons whose box is within ``radius`` of them. ``radius`` and ``size`` of the cells may be
    columns that ``keys``, in both tables, determine."""
    radius, size = (F.lit(v) if isinstance(v, float) else v for v in (radius, size))

    def cells(lo, hi):
        return F.sequence(F.floor((F.col(lo) - radius) / size), F.floor((F.col(hi) + radius) / size))

    spread = (boxes.withColumn("__cx", F.explode(cells("xmin", "xmax")))
              .withColumn("__cy", F.explode(cells("ymin", "ymax"))))
    dx = F.greatest(F.col("xmin") - F.col("x"), F.col("x") - F.col("xmax"), F.lit(0.0))
    dy = F.greatest(F.col("ymin") - F.col("y"), F.col("y") - F.col("ymax"), F.lit(0.0))
    return (points.withColumns({"__cx": F.floor(F.col("x") / size), "__cy": F.floor(F.col("y") / size)})
            .join(spread, [*keys, "__cx", "__cy"]).filter(F.hypot(dx, dy) <= radius)
            .drop("__cx", "__cy", "xmin", "xmax", "ymin", "ymax"))


def _boxes(polygons):
    """Rings, and their boxes without the rings; computed once."""
    rings = checkpoint(polygons.select("poly_id", "ring"))
    return rings, checkpoint(rings.select("poly_id", *[
        c.alias(n) for n, c in G.bbox(F.col("ring")).items()]))


def contains_join(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points (x, y) with the polygons (poly_id, ring) that hold them."""
    rings, boxes = _boxes(polygons)
    return (_candidates(points, boxes, 0.0, _cell_size(_extent(rings))).join(rings, "poly_id")
            .filter(G.inside(F.col("x"), F.col("y"), F.col("ring"))).drop("ring"))


def nearest_polygon(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Add the nearest polygon (``poly_id``) and its distance, 0 inside; ties go to the lesser id.

    A polygon is no further than the nearest of its corners, so each distinct place searches once, with a radius that is sure to
    reach a corner (``sure_levels``), among the polygons whose box is that near.
    """
    rings, boxes = _boxes(polygons)
    extent = _extent(rings)
    if extent.largest is None:
        raise ValueError("no polygons")
    left = checkpoint(points.select("x", "y").distinct())
    spot = left.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if spot[0] is None:
        return points.withColumns({"poly_id": F.lit(None).cast(polygons.schema["poly_id"].dataType),
                                   "distance": F.lit(None).cast("double")})
    corners = checkpoint(rings.select(F.explode("ring").alias("c")).select(F.col("c.x").alias("x2"), F.col("c.y").alias("y2")))
    sides = _pyramid((min(extent.xmin, spot[0]), min(extent.ymin, spot[2])), (max(extent.xmax, spot[1]), max(extent.ymax, spot[3])),
                     corners.count())
    radius = F.element_at(F.array(*[F.lit(2.0 ** 1.5 * s * (1 + 1e-9)) for s in sides]), F.col("__level") + 1)
    left = checkpoint(sure_levels(left, corners, [], sides))
    level = F.explode(F.array(*[F.lit(i) for i in range(len(sides))]))
    used = boxes.withColumn("__level", level).join(left.select("__level").distinct(), "__level")
    near = _candidates(left, used, radius, F.greatest(radius, F.lit(_cell_size(extent))), ["__level"])
    distance = G.distance_to_ring(F.col("x"), F.col("y"), F.col("ring"))
    best = (near.join(rings, "poly_id").select("x", "y", "poly_id", distance.alias("distance"))
            .groupBy("x", "y").agg(F.min(F.struct("distance", "poly_id")).alias("__b")).select("x", "y", "__b.*"))
    return join_on(points, best, ["x", "y"], "left")


def overlaps(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Overlap area of convex cells (cell_id, ring) and simple regions (poly_id, ring).

    Boxes meet through square grid cells; a pair is taken in the one grid cell
    that holds the corner of the two boxes' common part.
    """
    # rings and boxes are long expressions of their sources: computed once, then plain columns
    a = checkpoint(cells.select("cell_id", F.col("ring").alias("cell_ring"), "ring", *[
        c.alias("a_" + n) for n, c in G.bbox(F.col("ring")).items()]))
    b = checkpoint(regions.select("poly_id", F.col("ring").alias("poly_ring"), "ring", *[
        c.alias("b_" + n) for n, c in G.bbox(F.col("ring")).items()]))
    size = F.lit(max(_cell_size(_extent(a)), _cell_size(_extent(b))))

    def spread(df, side):
        def cells(axis):
            return F.sequence(F.floor(F.col(f"{side}_{axis}min") / size), F.floor(F.col(f"{side}_{axis}max") / size))
        return (df.drop("ring", "cell_ring", "poly_ring").withColumn("__cx", F.explode(cells("x")))
                .withColumn("__cy", F.explode(cells("y"))))

    pairs = (spread(a, "a").join(spread(b, "b"), ["__cx", "__cy"])
             .filter((F.col("a_xmin") < F.col("b_xmax")) & (F.col("b_xmin") < F.col("a_xmax"))
                     & (F.col("a_ymin") < F.col("b_ymax")) & (F.col("b_ymin") < F.col("a_ymax")))
             .filter((F.floor(F.greatest("a_xmin", "b_xmin") / size) == F.col("__cx"))
                     & (F.floor(F.greatest("a_ymin", "b_ymin") / size) == F.col("__cy"))))
    # rings join after the pairs are known, so outlines are not repeated per grid cell
    pairs = (pairs.select("cell_id", "poly_id").join(a.select("cell_id", "cell_ring"), "cell_id")
             .join(b.select("poly_id", "poly_ring"), "poly_id"))
    common = G.clip_convex(F.col("poly_ring"), F.col("cell_ring"))
    return (pairs.select("cell_id", "poly_id", common.alias("__common"))
            .select("cell_id", "poly_id", F.when(F.size("__common") > 2, F.abs(
                G.signed_area(F.col("__common")))).otherwise(F.lit(0.0)).alias("area"))
            .filter(F.round("area", 3) > 0))


def largest_overlap(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Each cell with the region of greatest common area, ties to the lesser id; else null."""
    best = overlaps(cells, regions).groupBy("cell_id").agg(
        F.min_by(F.struct("poly_id", "area"), F.struct(-F.round("area", 3), F.col("poly_id")))
        .alias("__b")).select("cell_id", "__b.*")
    return cells.select("cell_id").join(best, "cell_id", "left")


def convex_hull(points: DataFrame, keys: list[str], slice_rows: int = 50_000) -> DataFrame:
    """Hull vertices per key: keys, seq, x, y, counter-clockwise from the lowest x.

    The hull of the union is the hull of the slices' hulls, so a group is first
    reduced in slices of about ``slice_rows`` points in separate tasks.
    """
    def hull_of(pdf):
        pts = sorted(set(zip(pdf["x"], pdf["y"])))

        def chain(seq):
            out = []
            for p in seq:
                while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                        - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        return pts if len(pts) < 3 else chain(pts) + chain(pts[::-1])

    def per_group(pdf):
        import pandas as pd

        ring = hull_of(pdf)
        out = pd.DataFrame({"seq": range(1, len(ring) + 1), "x": [p[0] for p in ring],
                            "y": [p[1] for p in ring]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    schema = points.select(*keys).schema.add("seq", "integer").add("x", "double").add("y", "double")
    distinct = points.select(*keys, "x", "y").distinct()
    size = distinct.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(float(slice_rows))).alias("__slices"))
    sliced = join_on(distinct, size, keys).withColumn(
        "__slice", F.pmod(F.xxhash64("x", "y"), F.col("__slices"))).drop("__slices")
    partial = sliced.groupBy(*keys, "__slice").applyInPandas(per_group, schema)
    return partial.groupBy(*keys).applyInPandas(per_group, schema)


def buffered_hull_area(hull: DataFrame, keys: list[str], distance: float) -> DataFrame:
    """Area of a hull grown by ``distance``: A + P d + pi d^2."""
    ring = F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))),
                       lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    out = hull.groupBy(*keys).agg(ring.alias("ring"))
    lengths = F.transform(G.ring_edges(F.col("ring")), lambda e: F.hypot(
        e["a"]["x"] - e["b"]["x"], e["a"]["y"] - e["b"]["y"]))
    perimeter = F.aggregate(lengths, F.lit(0.0), lambda s, v: s + v)
    return out.select(*keys, (F.abs(G.signed_area(F.col("ring"))) + perimeter * distance
                              + math.pi * distance ** 2).alias("buffered_area"))
