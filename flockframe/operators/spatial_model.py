"""Penalised count model with shrunk site effects, smooth season and neighbouring strata that lean on each other.

For a species, log mean = level(stratum, year) + site effect + season(day). Counts are negative binomial, or Poisson. Site effects
are shrunk towards none, levels towards those of the neighbouring strata and years, season coefficients towards none;
each penalty is the log density of a normal distribution, so the fit is the mode of what a sampler would draw from.

The fit is by Newton steps. Site effects depend on one site's counts alone: each pass finds them inside the tasks, one row a site, and
takes them out of the equations. What is left (levels and season) is added up by stratum in Spark and solved by
conjugate gradients, a species at a time; its size is set by strata and years, not by the surveys.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from ..session import checkpoint
from .model import spline_basis


@dataclass(frozen=True)
class Penalties:
    """Precisions of the normal distributions. ``level`` holds a level loosely to its species' mean; ``phi`` is the
    negative-binomial size, none for Poisson counts."""
    site: float = 1.0
    space: float = 1.0
    time: float = 1.0
    season: float = 0.1
    level: float = 0.01
    phi: float | None = None


def _site_rows(encoded: DataFrame, n_knots: int) -> DataFrame:
    """One row for each species, stratum and site: years from the species' first, totals, numbers, season columns."""
    basis = spline_basis(encoded, "date", n_knots).groupBy("species", F.col("x").alias("date")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("knot", "value"))), lambda c: c["value"]).alias("b"))
    first = encoded.groupBy("species").agg(F.min("yr").alias("__yr"))
    cells = encoded.groupBy("species", "strat", "site", "yr", "date").agg(
        F.sum("count").cast("double").alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    cell = F.struct((F.col("yr") - F.col("__yr")).cast("int").alias("t"), "total", "n", "b")
    rows = cells.join(basis, ["species", "date"]).join(first, "species").groupBy("species", "strat", "site").agg(
        F.sort_array(F.collect_list(cell)).alias("c"))
    return rows.select("species", "strat", "site", F.col("c.t").alias("t"), F.col("c.total").alias("total"),
                       F.col("c.n").alias("n"), F.flatten("c.b").alias("b"))


def _start(encoded: DataFrame, edges: DataFrame, columns: int) -> DataFrame:
    """One row for each stratum: neighbours, season group, the species' mean and first year, levels y and season coefficients c."""
    group = F.min("seas_strat") if "seas_strat" in encoded.columns else F.lit(1)
    strata = encoded.groupBy("species", "strat").agg(group.cast("int").alias("seas"))
    means = encoded.groupBy("species").agg(
        F.log((F.sum("count") + 0.5) / (F.count(F.lit(1)) + 1)).alias("mean"), F.min("yr").alias("first"),
        (F.max("yr") - F.min("yr") + 1).cast("int").alias("years"))
    both = edges.select("species", "node1", "node2").union(edges.select("species", "node2", "node1")).toDF("species", "strat", "other")
    near = both.join(strata.select("species", F.col("strat").alias("other")), ["species", "other"], "left_semi")
    near = near.groupBy("species", "strat").agg(F.sort_array(F.collect_set("other")).alias("near"))
    kind = encoded.schema["strat"].dataType.simpleString()
    return strata.join(means, "species").join(near, ["species", "strat"], "left").select(
        "species", "strat", "seas", "mean", "first", F.coalesce("near", F.array().cast(f"array<{kind}>")).alias("near"),
        F.array_repeat("mean", F.col("years")).alias("y"), F.array_repeat(F.lit(0.0), columns).alias("c"))


def _site_effect(base, total, n, p: Penalties):
    """Mode of a site's effect given the rest of its cells' log means; the working weights and residuals there."""
    a = 0.0
    for _ in range(200):
        mean = np.exp(np.clip(base + a, -30, 30))
        over = 1.0 if p.phi is None else 1 + mean / p.phi
        w, r = n * mean / over, (total - n * mean) / over
        step = (r.sum() - p.site * a) / (w.sum() + p.site)
        if abs(step) < 1e-12:
            break
        a += min(max(step, -1.0), 1.0)
    return a, w, r


def _equations(p: Penalties):
    """Score and information of levels and season without the sites, by stratum: rows come sorted by it."""
    schema = pa.schema([("row", pa.int64()), ("v", pa.list_(pa.float64()))])

    def run(batches):
        key, score, info = None, None, None
        for rows in batches:
            done = []
            for row, y, c, t, total, n, b in zip(*(rows.column(x).to_pylist() for x in ("row", "y", "c", "t", "total", "n", "b"))):
                if row != key:
                    if key is not None:
                        done.append((key, np.concatenate((score, info.ravel()))))
                    key, score, info = row, np.zeros(len(y) + len(c)), np.zeros((len(y) + len(c),) * 2)
                t, total, n, b = np.array(t), np.array(total), np.array(n), np.reshape(b, (len(t), -1))
                x = np.zeros((len(t), len(score)))
                x[np.arange(len(t)), t] = 1
                x[:, len(y):] = b
                _, w, r = _site_effect(x @ np.array(y + c), total, n, p)
                own = x.T @ w
                score += x.T @ r
                info += (x * w[:, None]).T @ x - np.outer(own, own) / (w.sum() + p.site)
            yield pa.record_batch([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], schema[1].type)], schema=schema)
        if key is not None:
            yield pa.record_batch([pa.array([key], pa.int64()), pa.array([np.concatenate((score, info.ravel()))], schema[1].type)], schema=schema)
    return run


def _descend(multiply, target: np.ndarray, precondition, tolerance: float = 1e-12) -> np.ndarray:
    """Conjugate gradients."""
    x = np.zeros_like(target)
    r = target.copy()
    z = precondition(r)
    d, rz = z.copy(), r @ z
    for _ in range(10 * len(target)):
        if rz <= tolerance ** 2 * max(target @ precondition(target), 1e-300):
            break
        q = multiply(d)
        step = rz / (d @ q)
        x, r = x + step * d, r - step * q
        z = precondition(r)
        rz, before = r @ z, rz
        d = z + rz / before * d
    return x


def _step(p: Penalties):
    """Newton step of one species: state and summed equations of its strata in, new state out."""
    def run(state: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        state = state.sort_values("strat").reset_index(drop=True)
        y, c0 = np.stack(state["y"]), np.stack(state["c"])
        k, years, columns = len(state), y.shape[1], c0.shape[1]
        groups, group = np.unique(state["seas"], return_inverse=True)
        c = np.stack([c0[np.flatnonzero(group == g)[0]] for g in range(len(groups))])
        at = {row: i for i, row in enumerate(state["row"])}
        size = years + columns
        flat = np.zeros((k, size + size * size))
        sums = sums[sums["row"].isin(list(at))]
        flat[[at[r] for r in sums["row"]], sums["pos"]] = sums["v"]
        score, info = flat[:, :size], flat[:, size:].reshape(k, size, size)
        place = {s: i for i, s in enumerate(state["strat"])}
        near = np.zeros((k, k))
        for i, others in enumerate(state["near"]):
            near[i, [place[o] for o in others if o != state["strat"][i]]] = 1
        space = np.diag(near.sum(1)) - near
        steps = np.diff(np.eye(years), axis=0)
        time = steps.T @ steps
        # of the penalties, whose minus gradient joins the score
        pull = p.space * space @ y + p.time * y @ time + p.level * (y - state["mean"].to_numpy()[:, None])

        def multiply(v):
            vy, vc = v[:k * years].reshape(k, years), v[k * years:].reshape(-1, columns)
            out = np.einsum("kij,kj->ki", info, np.concatenate((vy, vc[group]), 1))
            oy = out[:, :years] + p.space * space @ vy + p.time * vy @ time + p.level * vy
            oc = p.season * vc
            np.add.at(oc, group, out[:, years:])
            return np.concatenate((oy.ravel(), oc.ravel()))

        own = info[:, :years, :years] + p.time * time + (p.level + p.space * near.sum(1))[:, None, None] * np.eye(years)
        own = np.linalg.inv(own)
        season = np.zeros((len(groups), columns, columns)) + p.season * np.eye(columns)
        np.add.at(season, group, info[:, years:, years:])
        season = np.linalg.inv(season)

        def precondition(v):
            vy, vc = v[:k * years].reshape(k, years), v[k * years:].reshape(-1, columns)
            return np.concatenate((np.einsum("kij,kj->ki", own, vy).ravel(), np.einsum("gij,gj->gi", season, vc).ravel()))

        gc = -p.season * c
        np.add.at(gc, group, score[:, years:])
        by = _descend(multiply, np.concatenate(((score[:, :years] - pull).ravel(), gc.ravel())), precondition)
        moved = float(np.abs(by).max(initial=0.0))
        by *= min(1.0, 2 / max(moved, 1e-300))
        y, c = y + by[:k * years].reshape(k, years), c + by[k * years:].reshape(-1, columns)
        return state.assign(y=list(y), c=list(c[group]), moved=moved)
    return run


def _effects(p: Penalties):
    schema = pa.schema([("id", pa.int64()), ("effect", pa.float64())])

    def run(batches):
        for rows in batches:
            found = []
            for y, c, t, total, n, b in zip(*(rows.column(x).to_pylist() for x in ("y", "c", "t", "total", "n", "b"))):
                base = np.array(y)[t] + np.reshape(b, (len(t), -1)) @ np.array(c)
                found.append(_site_effect(base, np.array(total), np.array(n), p)[0])
            yield pa.record_batch([rows.column("id"), pa.array(found, pa.float64())], schema=schema)
    return run


def fit_spatial_model(encoded: DataFrame, edges: DataFrame, penalties: Penalties = Penalties(), *, n_knots: int = 4,
                      tolerance: float = 1e-8, most_rounds: int = 40) -> dict[str, DataFrame]:
    """Levels, site effects and season of all species together.

    encoded: species, strat, site, yr, date, count [, seas_strat: season group of the stratum]; edges: species, node1, node2 of
    strata. Returns ``level`` (species, strat, yr, value), ``site`` (species, strat, site, effect) and ``season`` (species, seas, date,
    value), all on the log scale. Years between a species' first and last have a level in each of its strata, with counts or
    without. A site counts once in each stratum. Rounds go on until nothing moves by more than ``tolerance``; an error is
    raised where ``most_rounds`` do not get there.
    """
    sites = checkpoint(_site_rows(encoded, n_knots).withColumn("id", F.monotonically_increasing_id()))
    keys = ["species", "strat"]
    state = checkpoint(_start(encoded, edges, n_knots + 1).withColumns(
        {"row": F.monotonically_increasing_id(), "moved": F.lit(math.inf)}))
    # each site row carries its stratum's number; sorted by it once, so that a task adds up a stratum after the other
    labels = sites.select("id", *keys, "site")
    sites = checkpoint(sites.join(state.select(*keys, "row"), keys).drop("species", "strat", "site")
                       .repartition("row", F.col("id") % 64).sortWithinPartitions("row"))
    for _ in range(most_rounds):
        seen = Observation()
        given = sites.join(state.select("row", "y", "c"), "row")
        sums = given.mapInArrow(_equations(penalties), "row long, v array<double>")
        sums = sums.select("row", F.posexplode("v").alias("pos", "v")).groupBy("row", "pos").agg(F.sum("v").alias("v"))
        sums = sums.join(state.select("row", F.col("species").alias("of")), "row")
        new = (state.groupBy("species").cogroup(sums.groupBy("of")).applyInPandas(_step(penalties), state.schema)
               .observe(seen, F.max("moved").alias("moved")))
        state = checkpoint(new)
        if (seen.get["moved"] or 0.0) <= tolerance:
            break
    else:
        raise RuntimeError(f"the model did not settle in {most_rounds} rounds")
    effects = sites.join(state.select("row", "y", "c"), "row").mapInArrow(_effects(penalties), "id long, effect double")
    basis = spline_basis(encoded, "date", n_knots).select("species", F.col("x").alias("date"), (F.col("knot") + 1).cast("int").alias("at"), "value")
    coefs = state.groupBy("species", "seas").agg(F.first("c").alias("c"))
    season = basis.join(coefs, "species").groupBy("species", "seas", "date").agg(F.sum(F.col("value") * F.element_at("c", F.col("at"))).alias("value"))
    level = state.select(*keys, "seas", "first", F.posexplode("y").alias("t", "value")).select(
        *keys, "seas", (F.col("first") + F.col("t")).cast(encoded.schema["yr"].dataType).alias("yr"), "value")
    return {"level": level, "site": labels.join(effects, "id").drop("id"), "season": season}


def spatial_index(fit: dict[str, DataFrame]) -> DataFrame:
    """Expected count of a survey at a mean site and mean day: species, strat, yr, value."""
    size = fit["site"].groupBy("species", "strat").agg(F.avg(F.exp("effect")).alias("__s"))
    day = fit["season"].groupBy("species", "seas").agg(F.avg(F.exp("value")).alias("__d"))
    return fit["level"].join(size, ["species", "strat"]).join(day, ["species", "seas"]).select(
        "species", "strat", "yr", (F.exp("value") * F.col("__s") * F.col("__d")).alias("value"))
