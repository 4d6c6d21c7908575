"""Planar geometry on doubles and ``array<struct<x,y>>`` rings (first vertex not repeated)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .columns import bind

# WGS84 ellipsoid (fixed values).
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
MEAN_RADIUS = 6371008.8


def _q(sin_phi: Column, e: float) -> Column:
    es = sin_phi * e
    return (1 - e * e) * (sin_phi / (1 - es * es) - (1 / (2 * e)) * F.log((1 - es) / (1 + es)))


def laea(lon: Column, lat: Column, lat0: float = 40.0, lon0: float = -95.0,
         sphere: float | None = None) -> tuple[Column, Column]:
    """Lambert azimuthal equal-area (x, y) in metres; ellipsoidal unless ``sphere`` is a radius."""
    dlon = F.radians(lon - lon0)
    phi1 = math.radians(lat0)
    if sphere:
        b1, rq, d = phi1, sphere, 1.0
        sin_b = F.sin(F.radians(lat))
    else:
        e = math.sqrt(FLATTENING * (2 - FLATTENING))

        def q(s):
            return (1 - e * e) * (s / (1 - (e * s) ** 2)
                                  - (1 / (2 * e)) * math.log((1 - e * s) / (1 + e * s)))
        qp = q(1.0)
        b1 = math.asin(q(math.sin(phi1)) / qp)
        rq = SEMI_MAJOR * math.sqrt(qp / 2)
        m1 = math.cos(phi1) / math.sqrt(1 - (e * math.sin(phi1)) ** 2)
        d = SEMI_MAJOR * m1 / (rq * math.cos(b1))
        sin_b = bind(F.sin(F.radians(lat)), lambda v: _q(v, e) / qp)
    s1, c1 = math.sin(b1), math.cos(b1)

    def project(p):
        sin_lat, along = p["s"], p["l"]
        cos_lat = F.sqrt(F.greatest(1 - sin_lat * sin_lat, F.lit(0.0)))
        scale = F.sqrt(2 / (1 + s1 * sin_lat + c1 * cos_lat * F.cos(along))) * rq
        return F.struct((scale * d * cos_lat * F.sin(along)).alias("x"),
                        ((scale / d) * (c1 * sin_lat - s1 * cos_lat * F.cos(along))).alias("y"))

    xy = bind(F.struct(sin_b.alias("s"), dlon.alias("l")), project)
    return xy["x"], xy["y"]


def equidistant(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Equidistant cylindrical (x, y) in metres."""
    return F.radians(lon) * SEMI_MAJOR, F.radians(lat) * SEMI_MAJOR


def on_sphere(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Point on the mean sphere as (x, y, z) in metres."""
    out = F.cos(F.radians(lat)) * MEAN_RADIUS
    return out * F.cos(F.radians(lon)), out * F.sin(F.radians(lon)), F.sin(F.radians(lat)) * MEAN_RADIUS


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0))
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * MEAN_RADIUS)


def hex_cell(x: Column, y: Column, width: float) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top hexagon holding a point; ``width`` is edge to edge."""
    s = width / math.sqrt(3)

    def axial(p):
        q = (p["x"] * (math.sqrt(3) / 3) - p["y"] / 3) / s
        r = p["y"] * (2 / 3) / s
        return F.struct(q.alias("q"), r.alias("r"), (-q - r).alias("t"))

    def nearest(f):
        near = {k: F.floor(f[k] + 0.5) for k in "qrt"}
        return F.struct(*[near[k].alias(k) for k in "qrt"],
                        *[F.abs(near[k] - f[k]).alias("d" + k) for k in "qrt"])

    def settle(n):
        q_worst = (n["dq"] > n["dr"]) & (n["dq"] > n["dt"])
        return F.struct(F.when(q_worst, -n["r"] - n["t"]).otherwise(n["q"]).alias("q"),
                        F.when(~q_worst & (n["dr"] > n["dt"]), -n["q"] - n["t"]).otherwise(n["r"]).alias("r"))

    cell = bind(bind(bind(F.struct(x.alias("x"), y.alias("y")), axial), nearest), settle)
    return cell["q"], cell["r"]


def hex_centre(q: Column, r: Column, width: float) -> tuple[Column, Column]:
    return (q + r / 2.0) * width, r * (1.5 * width / math.sqrt(3))


def hex_ring(q: Column, r: Column, width: float) -> Column:
    """The six corners of a cell, counter-clockwise."""
    cx, cy = hex_centre(q, r, width)
    s = width / math.sqrt(3)
    corners = F.array(*[
        F.struct(F.lit(s * math.cos(math.radians(a))).alias("x"),
                 F.lit(s * math.sin(math.radians(a))).alias("y"))
        for a in (30, 90, 150, 210, 270, 330)])
    return F.transform(corners, lambda o: F.struct((cx + o["x"]).alias("x"), (cy + o["y"]).alias("y")))


RING_TYPE = "array<struct<x:double,y:double>>"


def ring_edges(ring: Column) -> Column:
    """Array of {a, b} edges, closing edge included."""
    turned = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column) -> Column:
    return _total(F.transform(ring_edges(ring), _cross)) / 2


def centroid(ring: Column) -> tuple[Column, Column]:
    edges, area6 = ring_edges(ring), signed_area(ring) * 6

    def along(axis):
        return F.try_divide(_total(F.transform(
            edges, lambda e: (e["a"][axis] + e["b"][axis]) * _cross(e))), area6)
    return along("x"), along("y")


def bbox(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "xmax": F.array_max(xs),
            "ymin": F.array_min(ys), "ymax": F.array_max(ys)}


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Crossing-parity test."""
    def crosses(e):
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return F.when(spans & (x < at), 1).otherwise(0)
    hits = F.aggregate(F.transform(ring_edges(ring), crosses), F.lit(0), lambda s, v: s + v)
    return hits % 2 == 1


def distance_to_ring(x: Column, y: Column, ring: Column) -> Column:
    """Distance from a point to a polygon, 0 inside."""
    def segment(e):
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.hypot(a["x"] + t * dx - x, a["y"] + t * dy - y)
    return F.when(inside(x, y, ring), F.lit(0.0)).otherwise(
        F.array_min(F.transform(ring_edges(ring), segment)))


def clip_convex(subject: Column, convex: Column) -> Column:
    """Part of ``subject`` inside a counter-clockwise convex ring, one half-plane at a time."""
    def clip(ring, edge):
        a, b = edge["a"], edge["b"]

        def side(p):
            return ((b["x"] - a["x"]) * (p["y"] - a["y"])
                    - (b["y"] - a["y"]) * (p["x"] - a["x"]))

        def step(e):
            p, q = e["a"], e["b"]
            sp, sq = side(p), side(q)
            t = F.coalesce(F.try_divide(sp, sp - sq), F.lit(0.0))
            cut = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"),
                           (p["y"] + t * (q["y"] - p["y"])).alias("y"))
            return (F.when((sp >= 0) & (sq >= 0), F.array(q))
                    .when(sp >= 0, F.array(cut))
                    .when(sq >= 0, F.array(cut, q))
                    .otherwise(F.array().cast(RING_TYPE)))
        return F.flatten(F.transform(ring_edges(ring), step)).cast(RING_TYPE)
    return F.aggregate(ring_edges(convex), subject.cast(RING_TYPE), clip)
