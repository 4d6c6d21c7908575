"""Predictors and likelihoods of counts under draws: brute force, and no shuffle of rows x draws."""

import math
import random
from collections import Counter

import pytest

from flockframe.operators import model


def tables(spark, draws, gaps=False):
    r = random.Random(5)
    rows = [(s, site % 3 + 1, site, r.randint(1, 4), r.randint(1, 3), None if r.random() < 0.02 else r.randint(0, 6))
            for s in ("a", "b") for site in range(1, 8) for _ in range(25)]
    years = [(s, k, d, y, r.gauss(0, 1)) for s in ("a", "b") for k in (1, 2, 3) for d in range(draws) for y in range(1, 5)]
    alpha = [(s, d, k, r.gauss(0, 1)) for s in ("a", "b") for d in range(draws) for k in range(1, 8)]
    effect, season = ([(s, d, k, r.gauss(0, 1)) for s in ("a", "b") for d in range(draws) for k in range(1, n)] for n in (5, 4))
    scalars = [(s, d, r.random() + 0.1) for s in ("a", "b") for d in range(draws)]
    if gaps:  # a site without draws, one that a draw lacks, one drawn twice, an empty value, a species without draws
        alpha = [(s, d, k, None if (s, d, k) == ("b", 2, 4) else v) for s, d, k, v in alpha if k != 7 and (s, d, k) != ("a", 1, 2)]
        alpha += [("a", 0, 3, 0.25)]
        rows += [("c", 1, 1, 1, 1, 2), ("a", None, 1, 1, 1, 2)]
    frames = [spark.createDataFrame(x, schema) for x, schema in (
        (rows, "species string, strat int, site int, yr int, date int, count int"),
        (years, "species string, strat int, draw int, yr int, value double"),
        (alpha, "species string, draw int, site int, value double"), (effect, "species string, draw int, yr int, value double"),
        (season, "species string, draw int, date int, value double"), (scalars, "species string, draw int, sdnoise double"))]
    return frames, rows, years, alpha, effect, season, scalars


def brute(rows, years, alpha, effect, season):
    """(row, draw) -> means, as joins give them."""
    out = []
    for row in rows:
        s, strat, site, yr, date, _ = row
        for _, _, d, _, y in (p for p in years if (p[0], p[1], p[3]) == (s, strat, yr)):
            for v in (p[3] for p in alpha if p[:3] == (s, d, site)):
                e = next(p[3] for p in effect if p[:3] == (s, d, yr))
                out.append((row, d, None if v is None else y + v + e + next(p[3] for p in season if p[:3] == (s, d, date))))
    return out


@pytest.mark.parametrize("gaps", [False, True])
def test_points_as_brute_force(spark, gaps):
    (encoded, *params, scalars), rows, *rest, noise = tables(spark, 4, gaps)
    want = brute(rows, *rest)
    got = Counter()
    predicted = model.linear_predictor(encoded, *params).collect()
    for p in predicted:
        assert p.n_rows == sum(c.n_rows for c in p.counts)
        for c in p.counts:
            got[(p.species, p.strat, p.site, p.yr, p.date, c["count"]), p.draw, p.log_mean and round(p.log_mean, 9)] += c.n_rows
    assert got == Counter((row, d, m and round(m, 9)) for row, d, m in want)
    phi = {(s, d): 1 / math.sqrt(v) for s, d, v in noise}
    means = {(row[:5], d, m and round(m, 9)) for row, d, m in want}
    for negative in (False, True):
        points = model.pointwise_loglik(model.linear_predictor(encoded, *params, *([scalars] if negative else []))).collect()
        assert sum(p.n_rows for p in points) == len(want)
        for p in points:
            assert ((p.species, p.strat, p.site, p.yr, p.date), p.draw, p.log_mean and round(p.log_mean, 9)) in means
            n, m = p["count"], p.log_mean
            if n is None or m is None:
                assert p.log_lik is None
            elif negative:
                f = phi[p.species, p.draw]
                t = math.log(math.exp(m) + f)
                assert p.log_lik == pytest.approx(math.lgamma(n + f) - math.lgamma(f) - math.lgamma(n + 1) + n * (m - t) + f * (math.log(f) - t))
            else:
                assert p.log_lik == pytest.approx(n * m - math.exp(m) - math.lgamma(n + 1))


def shuffled(df, metric="shuffleRecordsWritten"):
    """Largest number of rows, or of bytes, that an exchange of the plan wrote."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    nodes, most = [run.executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Exchange":
            most = max(most, node.metrics().apply(metric).value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_rows_by_draws_are_never_shuffled(spark):
    (encoded, *params, scalars), rows, *_ = tables(spark, 300)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        n = len({r[:5] for r in rows}) * 300
        for more in ([], [scalars]):
            assert shuffled(model.pointwise_loglik(model.linear_predictor(encoded, *params, *more))) < n / 4
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
