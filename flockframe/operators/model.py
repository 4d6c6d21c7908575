"""Model-side tables: bases, predictors, indices from parameters, and a count model.

The count model is a multiplicative Poisson fit with bootstrap draws. It is a
different estimator from a Bayesian hierarchical model and does not give the
same posterior.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C
from ..session import checkpoint


def spline_basis(encoded: DataFrame, x: str, n_knots: int, keys: tuple[str, ...] = ("species",)
                 ) -> DataFrame:
    """Cubic radial basis on the integer grid of ``x``: species, x, knot, value.

    Knots stand at equal steps over the range of ``x`` per species; knot 0 is the
    linear term. Columns are centred over the grid, so that no constant is left.
    """
    span = encoded.groupBy(*keys).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    width = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1)).cast("double")
    grid = span.select(*keys, "__lo", width.alias("__w"),
                       F.explode(F.sequence("__lo", "__hi")).alias("x"))
    u = (F.col("x") - F.col("__lo")) / F.col("__w")
    columns = F.concat(
        F.array(F.struct(F.lit(0).alias("knot"), u.alias("raw"))),
        F.transform(F.sequence(F.lit(1), F.lit(n_knots)), lambda k: F.struct(
            k.alias("knot"),
            F.pow(F.abs(u - (k - 1) / float(max(n_knots - 1, 1))), F.lit(3.0)).alias("raw"))))
    long = grid.select(*keys, "x", F.explode(columns).alias("c")).select(*keys, "x", "c.*")
    centre = long.groupBy(*keys, "knot").agg(F.avg("raw").alias("__m"))
    return long.join(centre, [*keys, "knot"]).select(
        *keys, "x", "knot", (F.col("raw") - F.col("__m")).alias("value"))


def smooth_predict(basis: DataFrame, coefs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """basis x coefficients: one value per species, draw, x [, stratum].

    basis: species, x, knot, value; coefs: species, draw, knot, value [, stratum].
    """
    b = basis.withColumnRenamed("value", "__b")
    return (coefs.join(b, ["species", "knot"])
            .groupBy("species", *by, "draw", "x")
            .agg(F.sum(F.col("value") * F.col("__b")).alias("value")))


#: Slices of the draws, and blocks of the sites, of one species: each of their pairs is the work of one join key.
_SLICES, _BLOCKS = 32, 4


def _codes(params: DataFrame, keys: list[str], code: str) -> DataFrame:
    """Places 0, 1, ... of the keys that a species has parameters for, and their number ``__n``."""
    for k in keys:
        params = params.filter(F.col(k).isNotNull())
    listed = params.groupBy("species").agg(F.sort_array(F.collect_set(F.struct(*keys))).alias("__keys"))
    return listed.select("species", F.size("__keys").alias("__n"), F.posexplode("__keys").alias(code, "__key")).select(
        "species", "__n", code, "__key.*")


def _vectors(params: DataFrame, keys: list[str], codes: DataFrame, code: str, name: str) -> DataFrame:
    """species, draw and an array with, at the place of each key, the list of its values: none where the draw lacks the key."""
    at, n = F.struct(F.col(code).alias("i"), F.col("value").alias("v")), F.col("__n")
    own = params.join(codes, ["species", *keys]).groupBy("species", "draw").agg(
        F.max("__n").alias("__n"), F.sort_array(F.collect_list(at)).alias("__own"))
    places = F.sequence(F.lit(0), n - 1)
    full = F.transform("__own", lambda x: F.array(x.v))
    gaps = F.transform(places, lambda i: F.transform(F.filter("__own", lambda x: x.i == i), lambda x: x.v))
    return own.select("species", "draw", F.when(F.col("__own.i") == places, full).otherwise(gaps).alias(name))


def _dispersion_terms(counts: DataFrame, scalars: DataFrame) -> DataFrame:
    """species, draw, phi = 1 / sqrt(sdnoise) and log_rising: lgamma(count + phi) - lgamma(phi) by the place of the count.

    These terms depend on the count and the draw alone, so they are computed once for each pair.
    """
    own = scalars.join(counts, "species").select("species", "draw", "__counts", F.try_divide(F.lit(1.0), F.sqrt("sdnoise")).alias("phi"))
    return own.withColumn("__base", C.lgamma(F.col("phi"))).select("species", "draw", "phi", F.transform(
        "__counts", lambda c: C.lgamma(c.cast("double") + F.col("phi")) - F.col("__base")).alias("log_rising"))


def linear_predictor(encoded: DataFrame, year_pred: DataFrame, alpha: DataFrame,
                     year_effect: DataFrame, season: DataFrame, scalars: DataFrame | None = None) -> DataFrame:
    """Log-scale expectation of every count under every draw.

    Rows of the same species, stratum, year, site and day have one expectation: they are predicted once, with
    their number ``n_rows`` and the list ``counts`` of their different counts: count, n_rows, log_factorial. With
    ``scalars`` (species, draw, sdnoise) the terms of a negative binomial go along with each draw, and a count has its
    place among those of the species.

    The parameters of a draw are laid out as arrays by place, so that a row meets a draw and looks its values up. Only
    the rows, once a slice of the draws, and the draws, once a block of the sites, are shuffled, never their product. As in
    joins, a row without a value under a draw is not predicted under it, and one with several values as often.
    """
    group = [c for c in ("seas_strat",) if c in season.columns]
    cell = ["species", "strat", "yr", "site", "date", *[c for c in group if c != "strat"]]
    rows = encoded.groupBy(*cell, "count").agg(F.count(F.lit(1)).alias("n_rows"))
    listed = ["count", "n_rows", "log_factorial"]
    if scalars is not None:
        counts = rows.groupBy("species").agg(F.sort_array(F.collect_set("count")).alias("__counts"))
        rows = rows.join(counts.select("species", F.posexplode("__counts").alias("place", "count")), ["species", "count"], "left")
        listed.append("place")
    rows = rows.withColumn("log_factorial", C.lgamma(F.col("count").cast("double") + 1.0)).groupBy(*cell).agg(
        F.sum("n_rows").alias("n_rows"), F.collect_list(F.struct(*listed)).alias("counts"))
    years = year_pred.join(year_effect.withColumnRenamed("value", "__e"), ["species", "draw", "yr"]).withColumn(
        "value", F.col("value") + F.col("__e"))
    draws = None
    for params, keys, code in ((years, ["strat", "yr"], "__yi"), (alpha, ["site"], "__ai"), (season, [*group, "date"], "__si")):
        codes = _codes(params, keys, code)
        rows = rows.join(codes.drop("__n"), ["species", *keys])
        own = _vectors(params, keys, codes, code, code + "v")
        draws = own if draws is None else draws.join(own, ["species", "draw"])
    if scalars is not None:
        draws = draws.join(_dispersion_terms(counts, scalars), ["species", "draw"])

    def several(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    draws = draws.withColumn("__slice", F.pmod(F.xxhash64("draw"), F.lit(_SLICES)).cast("int")).withColumn("__block", several(_BLOCKS))
    rows = rows.withColumn("__block", F.pmod(F.xxhash64("site"), F.lit(_BLOCKS)).cast("int")).withColumn("__slice", several(_SLICES))
    met, found = draws.join(rows, ["species", "__slice", "__block"]), []
    for code in ("__yi", "__ai", "__si"):
        met = met.withColumn(code + "x", F.explode(F.get(code + "v", F.col(code))))
        found.append(F.col(code + "x"))
    others = ["phi", "log_rising"] if scalars is not None else []
    return met.select(*cell, "draw", "n_rows", "counts", *others, (found[0] + found[1] + found[2]).alias("log_mean"))


def pointwise_loglik(predicted: DataFrame) -> DataFrame:
    """Log likelihood per count and draw: Poisson, or negative binomial where ``linear_predictor`` was given the scalars.

    ``predicted`` is a table of ``linear_predictor``. Its lists of counts are unfolded: one row for each different count
    of a cell under a draw, ``n_rows`` being the number of equal counts.
    """
    mean, rest = F.exp("log_mean"), [c for c in predicted.columns if c not in ("n_rows", "counts", "phi", "log_rising")]
    count = F.col("__c.count").cast("double")
    if "phi" in predicted.columns:
        phi, total = F.col("phi"), F.log(mean + F.col("phi"))
        each = {"__slope": F.col("log_mean") - total, "__level": phi * (F.log(phi) - total)}
        value = F.get("log_rising", F.col("__c.place")) + (count * F.col("__slope") + F.col("__level"))
    else:
        each, value = {"__level": mean}, count * F.col("log_mean") - F.col("__level")
    points = predicted.withColumns(each).withColumn("__c", F.explode("counts"))
    return points.select(*rest, "__c.count", "__c.n_rows", (value - F.col("__c.log_factorial")).alias("log_lik"))


def season_level(season: DataFrame, how: str = "half_max", by: tuple[str, ...] = ()) -> DataFrame:
    """Reference season level per draw: half the maximum, or the mean (older variant)."""
    level = F.max("value") / 2 if how == "half_max" else F.avg("value")
    return season.groupBy("species", "draw", *by).agg(level.alias("seas"))


def _variance_terms(half_sd: dict[str, bool]):
    terms = F.lit(0.0)
    for column, used in half_sd.items():
        if used:
            terms = terms + 0.5 * F.col(column) * F.col(column)
    return terms


def stratum_index_from_params(year_pred: DataFrame, year_effect: DataFrame, alpha: DataFrame,
                              site_strata: DataFrame, scalars: DataFrame, *, noise: bool = False,
                              simple: bool = False) -> DataFrame:
    """Stratum indices n and nsmooth per species, draw, stratum and year code.

    The mean over sites of exp(a + b) with only b depending on the site is
    exp(a) * mean(exp(b)); so site effects are averaged per draw and stratum
    before they meet the years.

    ``scalars``: species, draw, seas [, strat: season level of the stratum's season group],
    sdyear, sdnoise [, ALPHA1]. ``noise`` adds half the noise variance (over-dispersed
    Poisson); ``simple`` is the older variant: intercept apart, noise in, no year variance.
    """
    keys = ["species", "draw"]
    scalar_keys = [*keys, *[c for c in ("strat",) if c in scalars.columns]]
    sites = (alpha.join(site_strata.select("species", "strat", "site"), ["species", "site"])
             .groupBy(*keys, "strat").agg(F.avg(F.exp("value")).alias("__size")))
    level = F.col("__y") + F.col("seas") + (F.col("ALPHA1") if simple else F.lit(0.0))
    level = level + _variance_terms({"sdnoise": noise or simple})
    smooth = level + _variance_terms({"sdyear": not simple})
    return (year_pred.withColumnRenamed("value", "__y")
            .join(sites, [*keys, "strat"])
            .join(scalars, scalar_keys)
            .join(year_effect.withColumnRenamed("value", "__e"), [*keys, "yr"])
            .select("species", "draw", "strat", "yr",
                    (F.exp(level + F.col("__e")) * F.col("__size")).alias("n"),
                    (F.exp(smooth) * F.col("__size")).alias("nsmooth")))


def survey_index_from_params(y_pred: DataFrame, year_effect: DataFrame, scalars: DataFrame, *,
                             noise: bool = False, simple: bool = False) -> DataFrame:
    """Survey-wide N, NSmooth and (unless ``simple``) the _alt forms with site variance."""
    keys = ["species", "draw"]
    level = F.col("ALPHA1") + F.col("__y") + F.col("seas")
    level = level + _variance_terms({"sdnoise": noise or simple})
    smooth = level + _variance_terms({"sdyear": not simple})
    full = level + F.col("__e")
    site = 0.5 * F.col("sdalpha") * F.col("sdalpha")
    out = {"N": F.exp(full), "NSmooth": F.exp(smooth)}
    if not simple:
        out |= {"N_alt": F.exp(full + site), "NSmooth_alt": F.exp(smooth + site)}
    return (y_pred.withColumnRenamed("value", "__y")
            .join(year_effect.withColumnRenamed("value", "__e"), [*keys, "yr"])
            .join(scalars, keys)
            .select("species", "draw", "yr", *[c.alias(n) for n, c in out.items()]))


def icar_energy(edges: DataFrame, coefs: DataFrame) -> DataFrame:
    """-1/2 sum over edges of squared coefficient differences, per species, draw and knot."""
    a = coefs.select("species", "draw", "knot", F.col("strat").alias("node1"),
                     F.col("value").alias("__a"))
    b = coefs.select("species", "draw", "knot", F.col("strat").alias("node2"),
                     F.col("value").alias("__b"))
    diff = F.col("__a") - F.col("__b")
    return (edges.select("species", "node1", "node2")
            .join(a, ["species", "node1"]).join(b, ["species", "draw", "knot", "node2"])
            .groupBy("species", "draw", "knot").agg((F.sum(diff * diff) * -0.5).alias("energy")))


# --- count model --------------------------------------------------------------


def _season_keys(encoded: DataFrame) -> list[str]:
    return ["species", *[c for c in ("seas_strat",) if c in encoded.columns]]


def count_model_cells(encoded: DataFrame) -> DataFrame:
    """Sufficient sums of the count model: one row per strat, site, yr, date [, season group]."""
    return encoded.groupBy(*_season_keys(encoded), "strat", "site", "yr", "date").agg(
        F.sum("count").cast("double").alias("total"), F.count(F.lit(1)).cast("double").alias("n"))


def fit_count_model(encoded: DataFrame, tolerance: float = 1e-8, most_rounds: int = 200) -> dict[str, DataFrame]:
    """Poisson log-link model site x (stratum, year) x day for all species together.

    Each factor's likelihood equation is ``effect = sum(count) / sum(n * other
    effects)``; the three are solved in turn until no effect changes by more than
    ``tolerance`` of itself in a round; an error is raised where ``most_rounds`` do not
    get there. Every round is one aggregation per factor over the sums of
    ``count_model_cells``, with a checkpoint of the small effect tables. With a ``seas_strat`` column every season group has its own days.
    Levels without any bird get effect 0. Returns the effect tables (species, level
    columns, effect) and the fitted cells.
    """
    factors = {"site": ["species", "site"], "year": ["species", "strat", "yr"],
               "day": [*_season_keys(encoded), "date"]}
    cells = checkpoint(count_model_cells(encoded))
    effects = {f: checkpoint(cells.select(*k).distinct().withColumn(f"{f}_effect", F.lit(1.0)))
               for f, k in factors.items()}
    totals = {f: checkpoint(cells.groupBy(*k).agg(F.sum("total").alias("__t")))
              for f, k in factors.items()}

    def with_effects(skip=None):
        out = cells
        for f, k in factors.items():
            if f != skip:
                out = out.join(effects[f], k)
        return out

    for _ in range(most_rounds):
        change = None
        for f, k in factors.items():
            others = [F.col(f"{o}_effect") for o in factors if o != f]
            expected = with_effects(skip=f).groupBy(*k).agg(
                F.sum(F.col("n") * others[0] * others[1]).alias("__e"))
            new, old = F.coalesce(F.try_divide("__t", "__e"), F.lit(0.0)), F.col(f"{f}_effect")
            solved = checkpoint(totals[f].join(expected, k).join(effects[f], k).select(
                *k, new.alias(f"{f}_effect"), F.abs(new - old).alias("__by"), F.abs(new).alias("__of")))
            effects[f] = solved.drop("__by", "__of")
            moved = solved.select("__by", "__of")
            change = moved if change is None else change.union(moved)
        if change.filter(F.col("__by") > F.col("__of") * tolerance).isEmpty():
            break
    else:
        raise RuntimeError(f"the count model did not settle in {most_rounds} rounds")
    fitted = with_effects().withColumn(
        "fitted", F.col("n") * F.col("site_effect") * F.col("year_effect") * F.col("day_effect"))
    return {**effects, "cells": fitted}


def dispersion(cells: DataFrame) -> DataFrame:
    """Negative-binomial size per species by moments: sum mu^2 / sum((y - mu)^2 - mu)."""
    mu, y = F.col("fitted"), F.col("total")
    extra = F.sum((y - mu) * (y - mu) - mu)
    return cells.groupBy("species").agg(
        F.sum(mu * mu).alias("__m2"), extra.alias("__x"),
        F.sum(F.when(mu > 0, F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y - mu))
              .otherwise(0.0)).alias("__d")).select(
        "species", F.when(F.col("__x") > 0, F.col("__m2") / F.col("__x")).alias("phi"),
        (2 * F.col("__d")).alias("deviance"))


def model_index(effects: dict[str, DataFrame], site_strata: DataFrame) -> DataFrame:
    """Index per species, stratum and year: year effect x mean site effect x mean day effect.

    ``site_strata``: species, strat, site [, seas_strat]; with the season group a
    stratum takes the mean of its own group's days.
    """
    group = _season_keys(site_strata)
    size = (site_strata.join(effects["site"], ["species", "site"])
            .groupBy(*group, "strat").agg(F.avg("site_effect").alias("__s")))
    day = effects["day"].groupBy(*group).agg(F.avg("day_effect").alias("__d"))
    return (effects["year"].join(size, ["species", "strat"]).join(day, group)
            .select("species", "strat", "yr",
                    (F.col("year_effect") * F.col("__s") * F.col("__d")).alias("value")))


def smooth_index(index: DataFrame, basis: DataFrame, keys: list[str], *, penalty: float = 0.1,
                 weight: str | None = None) -> DataFrame:
    """Smooth year course of an index: log(value) on a spline basis, per ``keys``.

    index: keys (species among them), yr, value [, weight]; basis: species, x, knot,
    value. The radial columns are shrunk by ``penalty``, level and straight line are
    not. Years without a positive value are filled from the smooth; a series
    without any is left out. One group is one series, so a task sees at most its years.
    """
    rows = basis.groupBy("species", F.col("x").alias("yr")).agg(
        F.sort_array(F.collect_list(F.struct("knot", "value"))).alias("__b")).select(
        "species", "yr", F.transform("__b", lambda c: c["value"]).alias("__b"))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    known = index.select(*keys, "yr", F.when(F.col("value") > 0, F.log("value")).alias("__y"), w.alias("__w"))
    series = known.filter("__y is not null").select(*keys).distinct().join(rows, "species").join(
        known, [*keys, "yr"], "left")
    schema = index.select(*keys, "yr").schema.add("value", "double")

    def fit(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("yr")
        x = np.column_stack([np.ones(len(pdf)), np.stack(pdf["__b"].to_numpy())])
        y, w = pdf["__y"].to_numpy(dtype=float), pdf["__w"].to_numpy(dtype=float)
        use = ~np.isnan(y)
        xw = x[use] * w[use, None]
        shrink = np.full(x.shape[1], penalty * w[use].mean())
        shrink[:2] = 1e-9
        beta = np.linalg.solve(x[use].T @ xw + np.diag(shrink), xw.T @ y[use])
        out = {k: [pdf[k].iloc[0]] * len(pdf) for k in keys}
        return pd.DataFrame({**out, "yr": pdf["yr"], "value": np.exp(x @ beta)})

    return series.groupBy(*keys).applyInPandas(fit, schema)


def bootstrap_index(surveys: DataFrame, replicates: int = 100, seed: int = 0,
                    site: str = "site", stratum: str = "strat", year: str = "yr") -> DataFrame:
    """Bootstrap draws of the mean count per species, stratum and year.

    Sites are resampled with Poisson(1) weights made from digests of (seed, species, site, replicate), so
    a replicate needs no shuffle of its own and reruns give the same draws. Counts
    are summed per site before the replicates unfold, and the unfolded rows are
    combined on the map side.
    """
    keys = ["species", stratum, year]
    sums = surveys.groupBy(*keys, site).agg(F.sum("count").cast("double").alias("__t"),
                                            F.count(F.lit(1)).cast("double").alias("__n"))
    weight = C.poisson_one(C.unit_hash(F.lit(seed), F.col("species"), F.col(site), F.col("draw")))
    return (sums.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
            .withColumn("__w", weight)
            .groupBy(*keys, "draw")
            .agg(F.try_divide(F.sum(F.col("__w") * F.col("__t")),
                              F.nullif(F.sum(F.col("__w") * F.col("__n")), F.lit(0.0))).alias("value")))
