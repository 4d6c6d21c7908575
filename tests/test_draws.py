import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from flockframe.functions.aggregates import ranked_quantiles
from flockframe.operators import coverage, diagnostics, draws, indices, trends
from flockframe.session import checkpoint


def test_ranked_quantiles_with_a_dominant_group(spark):
    """One group holds most rows; ties, heavy tails, constants and single rows are exact."""
    r = np.random.default_rng(1)
    data = {"big": np.exp(r.normal(size=3000) * 4), "ties": r.integers(0, 3, 200).astype(float),
            "same": np.full(50, 2.5), "one": np.array([7.0]), "neg": -np.exp(r.normal(size=101) * 3)}
    df = spark.createDataFrame([(k, float(v)) for k, a in data.items() for v in a], "g string, v double")
    probs = {"lo": 0.025, "q1": 0.25, "med": 0.5, "hi": 0.975, "max": 1.0}
    got = {x.g: x for x in ranked_quantiles(df, ["g"], "v", probs).collect()}
    for k, a in data.items():
        for n, p in probs.items():
            assert got[k][n] == pytest.approx(np.quantile(a, p), rel=1e-12)


def test_an_outlier_leaves_the_parts_alike(spark, monkeypatch):
    """With one 1e300 among the values, no part that is written holds over twice the median."""
    from flockframe.functions import aggregates
    written = []
    monkeypatch.setattr(aggregates, "checkpoint", lambda df: written.append(checkpoint(df)) or written[-1])
    df = spark.range(200_000).select(F.lit("a").alias("g"), F.when(F.col("id") == 7, 1e300).otherwise(F.exp(F.randn(3))).alias("v"))
    got = ranked_quantiles(df, ["g"], "v", {"m": 0.5, "max": 1.0}).first()
    values = [r.v for r in df.select("v").collect()]
    assert got.m == pytest.approx(np.median(values), rel=1e-12) and got["max"] == 1e300
    sizes = sorted(r["count"] for r in written[0].groupBy("__part").count().collect())
    assert len(sizes) == 1 or sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_ranked_quantiles_with_missing_keys_and_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("a", 2.0)], "g string, v double")
    assert sorted(map(str, ranked_quantiles(df, ["g"], "v", {"m": 0.5}).collect())) == [
        "Row(g='a', m=2.0)", "Row(g=None, m=2.0)"]


@pytest.mark.parametrize("keys", [["k"], []])
def test_summary_is_the_same_when_spread(spark, keys):
    df = spark.range(4000).select((F.col("id") % 3).alias("k"), F.randn(5).alias("value"))
    a, b = (rows(draws.summarise(df, keys, probs=(0.1,), spread=s)) for s in (True, False))
    assert np.allclose(a, b)


def test_a_group_without_values_keeps_its_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("b", None), (None, 2.0)], "k string, value double")
    a, b = (sorted(map(str, draws.summarise(df, ["k"], spread=s).collect())) for s in (True, False))
    assert a == b and len(a) == 3


def test_summary_takes_any_number_of_dimensions(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 2.0), (1, 1, 1, 1, 4.0)], "a int, b int, c int, d int, value double")
    r = draws.summarise(df, ["a", "b", "c", "d"]).first()
    assert (r["mean"], r["median"]) == (3.0, 3.0)


def test_wide_to_long(spark):
    wide = spark.createDataFrame([(1, 0.5, 1.5, 2.5, 9.0)], "draw int, `n[1,2]` double, `n[2,1]` double, "
                                                            "`nsmooth[1,1]` double, sd double")
    got = rows(draws.draws_long(wide, ["draw"], "n", ["s", "y"]))
    assert got == [(1, "n", 1, 2, 0.5), (1, "n", 2, 1, 1.5)]
    assert rows(draws.draws_long(wide, ["draw"], "sd")) == [(1, "sd", 9.0)]
    with pytest.raises(ValueError):
        draws.draws_long(wide, ["draw"], "absent")


def test_sampled_draws_are_whole_and_repeatable(spark):
    df = spark.range(600).select((F.col("id") % 30).alias("draw"), (F.col("id") / 30).cast("int").alias("year"),
                                 F.lit(1.0).alias("value"))
    a, b = (rows(draws.sample_draws(df, 7, seed=3)) for _ in range(2))
    assert a == b and len(a) == 7 * 20 and len({r[0] for r in a}) == 7


def chains(spark, x):
    return spark.createDataFrame([("p", c, i, float(v)) for c, row in enumerate(x) for i, v in enumerate(row)],
                                 "parameter string, chain int, iteration int, value double")


def test_effective_size(spark):
    r = np.random.default_rng(2)
    iid = r.normal(size=(4, 1000))
    ar = np.zeros((4, 1000))
    for t in range(1, 1000):
        ar[:, t] = 0.9 * ar[:, t - 1] + r.normal(size=4)
    got = [diagnostics.effective_size(chains(spark, x), ["parameter"]).first().ess for x in (iid, ar)]
    assert got[0] == pytest.approx(4000, rel=0.2)
    assert got[1] == pytest.approx(4000 * 0.1 / 1.9, rel=0.4)


def test_rhat_flags_a_shifted_chain(spark):
    x = np.random.default_rng(3).normal(size=(4, 500))
    for fn in (diagnostics.split_rhat, diagnostics.rank_rhat):
        assert fn(chains(spark, x), ["parameter"]).first().rhat == pytest.approx(1, abs=0.01)
        y = x.copy()
        y[0] += 3
        assert fn(chains(spark, y), ["parameter"]).first().rhat > 1.2


def test_trend_of_a_single_draw(spark):
    d = spark.createDataFrame([("s", 1, 2000, 4.0), ("s", 1, 2010, 2.0)],
                              "species string, draw int, year int, value double")
    p = spark.createDataFrame([("s", "t", 2000, 2010)], "species string, trend_type string, start_year int, end_year int")
    r = trends.trend_endpoint(d, p).first()
    assert r.percent_change == pytest.approx(((1 + r.trend / 100) ** 10 - 1) * 100) == pytest.approx(-50)
    assert (r.prob_decline, r.prob_decline_GT30, r.prob_decline_GT50, r.mean_abundance) == (1, 1, 0, 3.0)


def test_draws_that_start_at_zero_are_counted_not_hidden(spark):
    d = spark.createDataFrame([("s", i, y, v) for i, a, b in ((1, 0.0, 2.0), (2, 4.0, 2.0))
                               for y, v in ((2000, a), (2010, b))],
                              "species string, draw int, year int, value double")
    p = spark.createDataFrame([("s", "t", 2000, 2010)], "species string, trend_type string, start_year int, end_year int")
    r = trends.trend_endpoint(d, p).first()
    assert (r.n_draws_dropped, r.prob_decline, r.percent_change) == (1, 0.5, -50.0)


def test_standard_periods(spark):
    g = spark.createDataFrame([("Red Knot", 7.0), ("short", 2.0), ("long", 20.0)], "species string, gen_length double")
    p = {(r.species, r.trend_type): (r.start_year, r.end_year) for r in trends.standard_periods(g).collect()}
    assert p["Red Knot", "Recent-three-generation"] == (2003, 2024)
    assert p["Red Knot", "Previous-three-generation"] == (1982, 2003)
    assert p["short", "Recent-three-generation"] == (2014, 2024)
    assert p["long", "Previous-three-generation"] == (1980, 1964)
    assert p["short", "15-year"] == (2004, 2024)


def test_stage_labels(spark):
    g = spark.createDataFrame([("s", 2.0)], "species string, gen_length double")
    n = dict(indices.stage_labels(g, 1980, 2024).groupBy("stage").count().collect())
    assert n == {"recent": 11, "previous": 10, "earlier": 24}


def test_composite_is_the_sum_of_regions(spark):
    d = spark.createDataFrame([("s", 1, r, 2000, v) for r, v in (("a", 1.0), ("a", 2.0), ("b", 4.0))],
                              "species string, draw int, region string, year int, value double")
    got = {r.region: r.median for r in indices.composite_index(d).collect()}
    assert got == {"a": 3.0, "b": 4.0, "Composite": 7.0}


@pytest.mark.parametrize("share", [0.1, 0.5, 1.0])
def test_group_sample_is_exact_in_a_dominant_group(spark, share):
    df = spark.range(9000).select("id", F.when(F.col("id") < 6000, 1).otherwise(F.col("id") % 7).alias("g"))
    got = dict(coverage.group_sample(df, ["g"], ["id"], share).groupBy("g").count().collect())
    want = {g: int(n * share) for g, n in df.groupBy("g").count().collect()}
    assert got == want


def test_dense_codes(spark):
    df = spark.createDataFrame([("a", "z"), ("a", "b"), ("a", "z"), ("b", "m"), ("a", None)], "k string, v string")
    assert rows(coverage.dense_codes(df, ["k"], "v")) == [("a", "b", 1), ("a", "z", 2), ("b", "m", 1)]
    assert rows(coverage.dense_codes(df, [], "v")) == [("b", 1), ("m", 2), ("z", 3)]


def scores(x):
    from statistics import NormalDist

    flat = np.sort(x.ravel())
    rank = (np.searchsorted(flat, x, "left") + 1 + np.searchsorted(flat, x, "right")) / 2
    return np.vectorize(NormalDist().inv_cdf)((rank - 0.375) / (x.size + 0.25))


def plain_rhat(x):
    h = x.shape[1] // 2
    s = np.concatenate([x[:, :h], x[:, -h:]])
    w = s.var(axis=1, ddof=1).mean()
    return np.sqrt(((h - 1) / h * w + s.mean(axis=1).var(ddof=1)) / w)


def test_rank_rhat_against_its_formula(spark):
    r = np.random.default_rng(4)
    for x in (r.standard_cauchy((4, 101)), r.integers(0, 5, (3, 80)).astype(float), r.normal(size=(4, 90)) * [[1], [1], [1], [4]]):
        want = max(plain_rhat(scores(x)), plain_rhat(scores(np.abs(x - np.median(x)))))
        got = diagnostics.rank_rhat(chains(spark, x), ["parameter"]).first().rhat
        assert got == pytest.approx(want, rel=1e-9)


def test_bulk_ess_of_heavy_tails(spark):
    x = np.random.default_rng(5).standard_cauchy((4, 1000))
    r = diagnostics.convergence_summary(chains(spark, x), ["parameter"]).first()
    assert r.ess_bulk == pytest.approx(4000, rel=0.2) and r.rhat == pytest.approx(1, abs=0.01)
    assert r.ess_tail == pytest.approx(4000, rel=0.25)
    assert [r.median, r.q5, r.q95] == pytest.approx(np.quantile(x, [0.5, 0.05, 0.95]).tolist(), rel=1e-9)
    assert r.mad == pytest.approx(1.4826 * np.median(np.abs(x - np.median(x))), rel=1e-9)


def test_tail_ess_sees_what_the_middle_hides(spark):
    """Chains whose extremes come in runs have few effective draws in the tails and many in the middle."""
    r = np.random.default_rng(6)
    x = r.normal(size=(4, 1000))
    x = np.where((np.arange(1000) // 50 % 5 == 0), x * 6, x * 0.5)
    got = diagnostics.convergence_summary(chains(spark, x), ["parameter"]).first()
    assert got.ess_tail < 0.25 * got.ess_bulk


def test_effective_size_of_a_constant_is_undefined(spark):
    r = diagnostics.effective_size(chains(spark, np.ones((2, 10))), ["parameter"]).first()
    assert r.ess is None or np.isnan(r.ess)
