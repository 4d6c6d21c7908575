import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from flockframe.operators import indices, model


@pytest.fixture(scope="module")
def world(spark):
    """Counts with known site, stratum-year and day effects."""
    r = np.random.default_rng(1)
    site = np.exp(r.normal(size=12) * 0.7)
    year = np.exp(r.normal(size=(2, 6)) * 0.5)
    day = np.exp(r.normal(size=5) * 0.5)
    data = [("s", int(j % 2) + 1, int(j) + 1, y + 1, d + 1, int(r.poisson(20 * site[j] * year[j % 2, y] * day[d])))
            for j in range(12) for y in range(6) for d in range(5) for _ in range(4)]
    data += [("empty", 1, 1, y, 1, 0) for y in (1, 2)]
    df = spark.createDataFrame(data, "species string, strat int, site int, yr int, date int, count int")
    return df, site, year, day


def test_count_model_recovers_effects(world):
    df, site, year, day = world
    fit = model.fit_count_model(df)
    cells = fit["cells"]
    for level in (["site"], ["strat", "yr"], ["date"]):
        for r in cells.groupBy("species", *level).agg(F.sum("fitted").alias("f"), F.sum("total").alias("t")).collect():
            assert r.f == pytest.approx(r.t, rel=1e-3, abs=1e-9)
    got = {r.date: r.day_effect for r in fit["day"].filter("species = 's'").collect()}
    est = np.array([got[i + 1] for i in range(5)])
    assert np.allclose(est / est.mean(), day / day.mean(), rtol=0.1)
    got = {r.site: r.site_effect for r in fit["site"].filter("species = 's'").collect()}
    for half in (0, 1):  # site effects are known up to one factor per stratum
        est, true = (np.array([f(j) for j in range(half, 12, 2)]) for f in (lambda j: got[j + 1], lambda j: site[j]))
        assert np.allclose(est / est.mean(), true / true.mean(), rtol=0.1)
    assert {r.site_effect for r in fit["site"].filter("species = 'empty'").collect()} == {0.0}


def test_model_index_follows_the_years(world):
    df, site, year, day = world
    fit = model.fit_count_model(df)
    idx = {(r.strat, r.yr): r.value for r in model.model_index(
        fit, df.select("species", "strat", "site").distinct()).filter("species = 's'").collect()}
    for s in (0, 1):
        est = np.array([idx[s + 1, y + 1] for y in range(6)])
        assert np.allclose(est / est.mean(), year[s] / year[s].mean(), rtol=0.1)
        want = 20 * site[s::2].mean() * day.mean() * year[s]
        assert np.allclose(est, want, rtol=0.15)


def test_dispersion_is_large_for_poisson_counts(world):
    df = world[0]
    d = model.dispersion(model.fit_count_model(df)["cells"]).filter("species = 's'").first()
    assert d.phi is None or d.phi > 50
    assert d.deviance > 0


def test_bootstrap_mean_is_near_the_estimate(world):
    df = world[0].filter("species = 's'")
    draws = model.bootstrap_index(df, 400, seed=1)
    boot = {(r.strat, r.yr): (r.m, r.sd) for r in draws.groupBy("strat", "yr").agg(
        F.avg("value").alias("m"), F.stddev("value").alias("sd")).collect()}
    for r in df.groupBy("strat", "yr").agg(F.avg("count").alias("m")).collect():
        m, sd = boot[r.strat, r.yr]
        assert m == pytest.approx(r.m, rel=0.15) and sd > 0
    again = model.bootstrap_index(df.repartition(5), 400, seed=1)
    # a replicate that draws none of a stratum's sites has no value
    a, b = ([(*r[:4], round(r[4], 9)) for r in rows(d.dropna())] for d in (draws, again))
    assert a == b and 0.95 * draws.count() < len(a)


def test_stratum_index_against_the_site_mean(spark):
    def frame(data, schema):
        return spark.createDataFrame(data, "species string, draw int, " + schema)
    yp = spark.createDataFrame([("s", 1, 1, 1, 0.3)], "species string, strat int, draw int, yr int, value double")
    eff = frame([("s", 1, 1, 0.1)], "yr int, value double")
    alpha = frame([("s", 1, 1, 0.5), ("s", 1, 2, -0.5)], "site int, value double")
    where = spark.createDataFrame([("s", 1, 1), ("s", 1, 2)], "species string, strat int, site int")
    scal = frame([("s", 1, 0.2, 0.4, 0.6, 1.0)], "seas double, sdyear double, sdnoise double, ALPHA1 double")
    r = model.stratum_index_from_params(yp, eff, alpha, where, scal).first()
    mean = (math.exp(0.5) + math.exp(-0.5)) / 2
    assert r.n == pytest.approx(math.exp(0.6) * mean)
    assert r.nsmooth == pytest.approx(math.exp(0.5 + 0.08) * mean)
    r = model.stratum_index_from_params(yp, eff, alpha, where, scal, simple=True).first()
    assert r.nsmooth == pytest.approx(math.exp(1.0 + 0.5 + 0.18) * mean)


def test_stratum_index_with_two_seasons(spark):
    """Every stratum uses the season level of its own group."""
    def frame(data, schema):
        return spark.createDataFrame(data, "species string, draw int, " + schema)
    yp = spark.createDataFrame([("s", i, 1, 1, 0.0) for i in (1, 2)],
                               "species string, strat int, draw int, yr int, value double")
    eff, alpha = frame([("s", 1, 1, 0.0)], "yr int, value double"), frame(
        [("s", 1, 1, 0.0), ("s", 1, 2, 0.0)], "site int, value double")
    where = spark.createDataFrame([("s", 1, 1), ("s", 2, 2)], "species string, strat int, site int")
    season = frame([("s", 1, 1, 1, 0.4), ("s", 1, 2, 1, 2.0)], "seas_strat int, day int, value double")
    strata = spark.createDataFrame([("s", 1, 1), ("s", 2, 2)], "species string, strat int, seas_strat int")
    scal = (model.season_level(season, by=("seas_strat",)).join(strata, ["species", "seas_strat"])
            .withColumns({"sdyear": F.lit(0.0), "sdnoise": F.lit(0.0)}))
    got = {r.strat: r.n for r in model.stratum_index_from_params(yp, eff, alpha, where, scal).collect()}
    assert got == {1: pytest.approx(math.exp(0.2)), 2: pytest.approx(math.exp(1.0))}


def test_season_level_by_stratum(spark):
    """Two season groups: each stratum takes the level of its own group."""
    season = spark.createDataFrame([("s", 1, g, d, v) for g, d, v in ((1, 1, 0.2), (1, 2, 0.8), (2, 1, 2.0))],
                                   "species string, draw int, seas_strat int, day int, value double")
    got = rows(model.season_level(season, by=("seas_strat",)))
    assert got == [("s", 1, 1, 0.4), ("s", 1, 2, 1.0)]
    assert rows(model.season_level(season, "mean", ("seas_strat",)))[0][3] == 0.5


def test_basis_columns_are_centred(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9), ("b", 3)], "species string, yr int")
    basis = model.spline_basis(df, "yr", 4)
    assert basis.filter("species = 'a'").count() == 9 * 5
    for r in basis.groupBy("species", "knot").agg(F.sum("value").alias("s")).collect():
        assert abs(r.s) < 1e-12


def test_season_curve_keeps_groups_apart(spark):
    season = spark.createDataFrame([("s", 1, g, d, 0.0) for g in (1, 2) for d in (1, 2)],
                                   "species string, draw int, seas_strat int, day int, value double")
    offsets = spark.createDataFrame([("s", 1, 1, 2.0), ("s", 2, 2, 3.0)],
                                    "species string, strat int, seas_strat int, adjs double")
    shift = spark.createDataFrame([("s", 0.0)], "species string, shift double")
    got = rows(indices.season_curve(season, shift, offsets).select("strat", "seas_strat", "day", "mean"))
    assert got == [(1, 1, 1, 2.0), (1, 1, 2, 2.0), (2, 2, 1, 3.0), (2, 2, 2, 3.0)]


def test_smooth_index_is_penalised_least_squares(spark):
    r = np.random.default_rng(6)
    y = np.exp(0.05 * np.arange(12) + r.normal(size=12) * 0.3)
    y[4] = 0.0  # a year without birds is filled from the curve
    index = spark.createDataFrame([("s", 1, i + 1, float(v), float(i + 1)) for i, v in enumerate(y)]
                                  + [("s", 2, i + 1, 0.0, 1.0) for i in range(12)],
                                  "species string, strat int, yr int, value double, w double")
    basis = model.spline_basis(index, "yr", 4)
    got = model.smooth_index(index, basis, ["species", "strat"], penalty=0.5, weight="w").orderBy("yr").collect()
    assert {r.strat for r in got} == {1} and len(got) == 12
    u = np.arange(12) / 11
    x = np.column_stack([u] + [abs(u - k / 3) ** 3 for k in range(4)])
    x = np.column_stack([np.ones(12), x - x.mean(axis=0)])
    use, w = y > 0, np.arange(1, 13.0)
    pen = np.full(6, 0.5 * w[use].mean())
    pen[:2] = 1e-9
    beta = np.linalg.solve(x[use].T @ (x[use] * w[use, None]) + np.diag(pen), x[use].T @ (w[use] * np.log(y[use])))
    assert np.allclose([r.value for r in got], np.exp(x @ beta))


def test_season_groups_have_their_own_days(spark):
    """Two strata with opposite seasons: each group's day effects follow its own counts."""
    r = np.random.default_rng(7)
    day = {1: np.array([1.0, 2.0, 4.0]), 2: np.array([4.0, 2.0, 1.0])}
    data = [("s", g, g, 10 * g + j, y, d + 1, int(r.poisson(30 * day[g][d])))
            for g in (1, 2) for j in range(5) for y in (1, 2, 3) for d in range(3)]
    df = spark.createDataFrame(data, "species string, strat int, seas_strat int, site int, yr int, date int, count int")
    fit = model.fit_count_model(df)
    for g in (1, 2):
        est = [r.day_effect for r in fit["day"].filter(F.col("seas_strat") == g).orderBy("date").collect()]
        assert np.allclose(np.array(est) / est[1], day[g] / day[g][1], rtol=0.15)
    idx = model.model_index(fit, df.select("species", "strat", "seas_strat", "site").distinct())
    assert idx.count() == 6 and all(r.value == pytest.approx(70, rel=0.1) for r in idx.collect())
