import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from flockframe.operators import spatial_model as S

EDGES = [("a", 1, 2), ("a", 2, 3), ("a", 3, 9), ("b", 1, 2)]
BASIS_DAYS = 7


def world(spark, grouped):
    """Counts of three species; stratum 4 of "a" has no neighbour, species "b" skips a year, "empty" has no bird."""
    r = np.random.default_rng(4)
    data = []
    for species, strata in (("a", (1, 2, 3, 4)), ("b", (1, 2))):
        for k in strata:
            for site in range(3 + k):
                size = r.normal() * 0.5
                for yr in (3, 4, 5, 6):
                    if species == "b" and yr == 5 or r.random() < 0.2:
                        continue
                    for date in r.choice(BASIS_DAYS, 3):
                        mu = np.exp(1 + 0.2 * k + size + 0.1 * yr - 0.05 * (date - 3) ** 2)
                        data.append((species, k, k * 100 + site, yr, int(date) + 1, int(r.negative_binomial(4, 4 / (4 + mu))), k % 2))
    data += [("empty", 1, 1, yr, 1, 0, 1) for yr in (1, 2)]
    schema = "species string, strat int, site int, yr int, date int, count int, seas_strat int"
    df = spark.createDataFrame(data, schema).repartition(4)
    return (df if grouped else df.drop("seas_strat")), [d if grouped else (*d[:6], 1) for d in data]


def dense(data, p, n_knots):
    """Mode of one species by Newton steps on all unknowns at once: {(strat, yr): level}, {(strat, site): effect}, {(group, date): season}."""
    first, last = min(d[3] for d in data), max(d[3] for d in data)
    lo, hi = min(d[4] for d in data), max(d[4] for d in data)
    grid = np.arange(lo, hi + 1)
    u = (grid - lo) / max(hi - lo, 1)
    basis = np.stack([u, *[np.abs(u - j / max(n_knots - 1, 1)) ** 3 for j in range(n_knots)]], 1)
    basis -= basis.mean(0)
    strata, groups = sorted({d[1] for d in data}), sorted({d[6] for d in data})
    unknown = [("y", k, t) for k in strata for t in range(first, last + 1)] + [
        ("c", g, j) for g in groups for j in range(n_knots + 1)] + [("a", k, s) for k, s in sorted({(d[1], d[2]) for d in data})]
    at = {x: i for i, x in enumerate(unknown)}
    x = np.zeros((len(data), len(unknown)))
    for i, (_, k, site, yr, date, _, g) in enumerate(data):
        x[i, at["y", k, yr]] = x[i, at["a", k, site]] = 1
        for j in range(n_knots + 1):
            x[i, at["c", g, j]] = basis[date - lo, j]
    total = np.array([d[5] for d in data], float)
    mean = np.log((total.sum() + 0.5) / (len(data) + 1))
    penalty, centre = np.zeros((len(unknown),) * 2), np.zeros(len(unknown))
    for (kind, k, t), i in at.items():
        penalty[i, i] += {"y": p.level, "c": p.season, "a": p.site}[kind]
        if kind == "y":
            centre[i] = mean
            near = [(o, p.space) for s, a, b in EDGES if s == data[0][0] for o in ((b,) if a == k else (a,) if b == k else ())]
            for j, w in [(at.get(("y", o, t)), w) for o, w in near] + [(at.get(("y", k, t + d)), p.time) for d in (-1, 1)]:
                if j is not None:
                    penalty[i, i] += w
                    penalty[i, j] -= w
    beta = centre.copy()
    for _ in range(300):
        mu = np.exp(x @ beta)
        over = 1 if p.phi is None else 1 + mu / p.phi
        by = np.linalg.solve((x * (mu / over)[:, None]).T @ x + penalty, x.T @ ((total - mu) / over) - penalty @ (beta - centre))
        beta += by * min(1, 1 / np.abs(by).max())
        if np.abs(by).max() < 1e-11:
            break
    value = {u: beta[i] for u, i in at.items()}
    season = {(g, int(d)): float(basis[i] @ [value["c", g, j] for j in range(n_knots + 1)]) for g in groups for i, d in enumerate(grid)}
    return ({(k, t): v for (kind, k, t), v in value.items() if kind == "y"},
            {(k, t): v for (kind, k, t), v in value.items() if kind == "a"}, season)


@pytest.mark.parametrize("grouped, penalties", [
    (False, S.Penalties()), (True, S.Penalties(site=2.0, space=3.0, time=0.5, phi=4.0))])
def test_fit_equals_a_dense_solve(spark, grouped, penalties):
    df, data = world(spark, grouped)
    edges = spark.createDataFrame(EDGES, "species string, node1 int, node2 int")
    fit = S.fit_spatial_model(df, edges, penalties, n_knots=3)
    got = {name: {tuple(r)[:-1]: tuple(r)[-1] for r in fit[name].select(*columns).collect()} for name, columns in (
        ("level", ["species", "strat", "yr", "value"]), ("site", ["species", "strat", "site", "effect"]),
        ("season", ["species", "seas", "date", "value"]))}
    count = {name: 0 for name in got}
    for species in ("a", "b", "empty"):
        for name, want in zip(got, dense([d for d in data if d[0] == species], penalties, 3)):
            count[name] += len(want)
            for key, v in want.items():
                assert got[name][(species, *key)] == pytest.approx(v, abs=1e-6), (name, species, key)
    assert count == {name: len(v) for name, v in got.items()}


def test_neighbours_share_what_they_know(spark):
    """A stratum with two counts follows its neighbours the more, the stronger the spatial term; so do sites their stratum."""
    data = [("a", k, k * 10 + s, yr, 1, 20 + yr) for k in (1, 3) for s in range(5) for yr in range(1, 6)]
    data += [("a", 2, 20, 1, 1, 2), ("a", 2, 20, 5, 1, 2)]
    df = spark.createDataFrame(data, "species string, strat int, site int, yr int, date int, count int")
    edges = spark.createDataFrame([("a", 1, 2), ("a", 2, 3)], "species string, node1 int, node2 int")
    found = []
    for p in (S.Penalties(space=0.01, site=50.0), S.Penalties(space=50.0, site=50.0), S.Penalties(space=50.0, site=0.01)):
        fit = S.fit_spatial_model(df, edges, p)
        level = {r["strat"]: r["v"] for r in fit["level"].groupBy("strat").agg(F.avg("value").alias("v")).collect()}
        effect = fit["site"].filter("strat = 2").first()["effect"]
        found.append((level[2] - level[1], effect))
    assert found[0][0] < found[1][0] - 0.5 and found[2][1] < found[1][1] < 0
    index = {(r["strat"], r["yr"]): r["value"] for r in S.spatial_index(fit).collect()}
    assert len(index) == 15 and index[1, 5] == pytest.approx(25, rel=0.1)
    assert rows(fit["season"].select("date")) == [(1,)]


def test_too_few_rounds_raise(spark):
    df, _ = world(spark, False)
    edges = spark.createDataFrame(EDGES, "species string, node1 int, node2 int")
    with pytest.raises(RuntimeError, match="settle"):
        S.fit_spatial_model(df, edges, most_rounds=1)
