import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from flockframe.functions import columns as C, geometry as G


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()[0]


@pytest.mark.parametrize("text, hours", [
    ("08:30:00", 8.5), ("8H 30M 0S", 8.5), ("30M 36S", 0.51), ("23:59:60", 24.0),
    ("08:30", None), ("morning", None), (None, None)])
def test_decimal_hours(spark, text, hours):
    got = one(spark, C.decimal_hours(F.lit(text).cast("string")))
    assert got == (None if hours is None else pytest.approx(hours))


@pytest.mark.parametrize("text, n", [("12", 12), ("2.7", 2), ("-3", -3), ("X", None), ("", None), (None, None)])
def test_tolerant_int(spark, text, n):
    assert one(spark, C.tolerant_int(F.lit(text).cast("string"))) == n


@pytest.mark.parametrize("x, want", [(1234.5, 1230.0), (0.0012345, 0.00123), (-9.996, -10.0), (0.0, 0.0), (5.0, 5.0)])
def test_signif(spark, x, want):
    assert one(spark, C.signif(F.lit(x))) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("x, label", [
    (-7.0, "< -7 %"), (-6.99, "-7:-4 %"), (-0.5, "-1:-0.5 %"), (0.0, "-0.5:0.5 %"), (7.0, "4:7 %"), (7.01, "> 7 %")])
def test_trend_bin_is_closed_on_the_right(spark, x, label):
    assert one(spark, C.trend_bin(F.lit(x))) == label
    assert C.bin_labels()[one(spark, C.bin_ordinal(F.lit(x))) - 1] == label


@pytest.mark.parametrize("d, m, y, want", [(1, 8, 2010, dt.date(2010, 8, 1)), (31, 2, 2010, None), (None, 2, 2010, None)])
def test_date_from_parts(spark, d, m, y, want):
    parts = [F.lit(v).cast("int") for v in (d, m, y)]
    assert one(spark, C.date_from_parts(*parts)) == want


def test_season_window_may_wrap(spark):
    day = F.lit("2020-12-30").cast("date")
    assert one(spark, C.in_season(day, (11, 1), (2, 28)))
    assert not one(spark, C.in_season(day, (7, 1), (11, 30)))


@pytest.mark.parametrize("start, end, want", [(1.0, 2.0, 2.0), (0.0, 2.0, None), (2.0, 0.0, 0.0), (-1.0, 1.0, None)])
def test_ratio_guards(spark, start, end, want):
    assert one(spark, C.ratio(F.lit(start), F.lit(end))) == want


def test_rate_of_doubling(spark):
    assert one(spark, C.annual_rate(F.lit(2.0), F.lit(10))) == pytest.approx((2 ** 0.1 - 1) * 100)


@pytest.mark.parametrize("x", [0.01, 0.5, 1.0, 2.0, 7.3, 50.0, 1e4])
def test_lgamma(spark, x):
    assert one(spark, C.lgamma(F.lit(x))) == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-11)


def test_probability_class(spark):
    got = [one(spark, C.probability_class(F.lit(p))) for p in (0.9, 0.5, 0.1)]
    assert got == ["> 85% probability negative", "< 85% probability of change", "> 85% probability positive"]


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = C.poisson_one(C.unit_hash(F.lit(7), F.col("id")))
    m, v = spark.range(200_000).select(w.alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert m == pytest.approx(1, abs=0.01) and v == pytest.approx(1, abs=0.02)


def test_annotation(spark):
    got = one(spark, C.trend_annotation(F.lit(-12.34), F.lit(1980), F.lit(2024), F.lit(-20.0), F.lit(1.0)))
    assert got == "-12.3 %  1980 : 2024 [ -20  :  1 ]"


def test_slug_and_key(spark):
    assert one(spark, C.name_slug(F.lit("Baird's Sandpiper"))) == "Bairds_Sandpiper"
    assert one(spark, C.composite_key(F.lit("a"), F.lit(None).cast("int"), F.lit(3))) == "a_NA_3"


def test_laea_centre_and_area(spark):
    x, y = G.laea(F.lit(-95.0), F.lit(40.0))
    assert abs(one(spark, x)) < 1e-6 and abs(one(spark, y)) < 1e-6
    # a small square keeps its area: side lengths from the ellipsoid's radii at 50 N
    d = 1e-3

    def at(lon, lat):
        return [one(spark, c) for c in G.laea(F.lit(lon), F.lit(lat))]
    a, b, c = at(-120.0, 50.0), at(-120.0 + d, 50.0), at(-120.0, 50.0 + d)
    area = abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    e2 = G.FLATTENING * (2 - G.FLATTENING)
    phi, r = math.radians(50.0), math.radians(d)
    w = 1 - e2 * math.sin(phi) ** 2
    want = (G.SEMI_MAJOR * math.cos(phi) / math.sqrt(w) * r) * (G.SEMI_MAJOR * (1 - e2) / w ** 1.5 * r)
    assert area == pytest.approx(want, rel=1e-4)


def test_sphere_option(spark):
    x, _ = G.laea(F.lit(-94.0), F.lit(40.0), sphere=6371007.0)
    assert one(spark, x) == pytest.approx(6371007.0 * math.radians(1) * math.cos(math.radians(40)), rel=1e-4)


def test_hex_cells_hold_their_points(spark):
    pts = spark.range(2000).select((F.rand(1) * 4e6 - 2e6).alias("x"), (F.rand(2) * 4e6 - 2e6).alias("y"))
    q, r = G.hex_cell(F.col("x"), F.col("y"), 3e5)
    pts = pts.withColumns({"q": q, "r": r})
    ring = G.hex_ring(F.col("q"), F.col("r"), 3e5)
    near = G.distance_to_ring(F.col("x"), F.col("y"), ring)
    assert pts.filter(near > 1e-6).isEmpty()


def test_haversine(spark):
    quarter = one(spark, G.haversine(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0)))
    assert quarter == pytest.approx(6371008.8 * math.pi / 2)


@pytest.mark.parametrize("p", [1e-12, 1e-4, 0.02, 0.3, 0.5, 0.9, 0.99999])
def test_normal_quantile(spark, p):
    from statistics import NormalDist

    assert one(spark, C.normal_quantile(F.lit(p))) == pytest.approx(NormalDist().inv_cdf(p), rel=1e-12, abs=1e-14)
    assert one(spark, C.normal_quantile(F.lit(0.0))) is None


@pytest.mark.parametrize("text, value", [("5d", None), ("5f", None), (" 7 ", 7), ("3.9", 3), ("1e2", 100), ("X", None), (".5", 0), ("-2", -2)])
def test_only_plain_numbers_count(spark, text, value):
    assert one(spark, C.tolerant_int(F.lit(text))) == value


@pytest.mark.parametrize("text", ["25:61:99", "08:75:00", "08:00:99"])
def test_impossible_clock_times(spark, text):
    assert one(spark, C.decimal_hours(F.lit(text))) is None
