from pyspark.sql import functions as F

from flockframe.operators import clean
from flockframe.plans import flows, testdata as T


def _inputs(spark, sf):
    events = T.events_geo(spark, sf).join(T.sites(spark, sf).drop("locality"), "locality_id")
    return events, T.observations(spark, sf), T.species(spark, sf)


def test_surveys_to_model_tables(spark, sf):
    events, obs, species = _inputs(spark, sf)
    surveys = flows.prepare_surveys(events, obs, species, first_year=1995, last_year=2001,
                                    cell_width=T.HEX_WIDTH, regions=T.regions(spark))
    kept, _ = clean.drop_conflicting(events, clean.clean_counts(obs))
    assert surveys.count() == kept.count() * species.count()
    assert surveys.filter("hex_name is null or region is null or count is null").isEmpty()
    tables = flows.model_tables(surveys, first_year=1995, last_year=2001, min_span=2, stratum_share=0.3)
    r = tables.groupBy("species").agg(
        *[F.min(c).alias("min_" + c) for c in ("yr", "date", "site", "strat")],
        (F.max("site") == F.count_distinct("site_id")).alias("a"),
        (F.max("strat") == F.count_distinct("hex_name")).alias("b")).collect()
    assert r and all(x[1:] == (1, 1, 1, 1, True, True) for x in r)
    one_region = tables.groupBy("species", "hex_name").agg(F.count_distinct("region").alias("n"))
    assert one_region.filter("n <> 1").isEmpty()


def test_draws_to_trends(spark, sf):
    out = flows.trends_and_indices(T.survey_draws(spark, sf), T.draw_generations(spark, sf),
                                   T.draw_observed(spark, sf), first_year=1980, end_year=2024)
    n_draws = T.survey_draws(spark, sf).groupBy("species").agg(F.count_distinct("draw").alias("n")).first().n
    trends = out["trends"].collect()
    assert len(trends) == 10 and len(out["differences"].collect()) == 6
    for r in trends:  # shares are whole numbers of draws
        for c in ("prob_decline", "prob_decline_GT30", "prob_decline_GT50", "prob_decline_GT70"):
            assert abs(r[c] * n_draws - round(r[c] * n_draws)) < 1e-9
        assert r.lci <= r.trend <= r.uci
        assert r.prob_decline >= r.prob_decline_GT30 >= r.prob_decline_GT50 >= r.prob_decline_GT70
    assert out["indices"].filter("stage is null").select("year").distinct().count() == 19


def test_bootstrap_draws_feed_the_trends(spark, sf):
    from flockframe.operators import trends

    rows = T.model_rows(spark, sf)
    draws = flows.bootstrap_draws(rows, first_year=1995, replicates=10, knots=3)
    periods = rows.select("species").distinct().selectExpr(
        "species", "'all' trend_type", "1995 start_year", "2001 end_year")
    for variable in ("n", "nsmooth"):
        out = trends.trend_endpoint(draws.filter(F.col("variable") == variable), periods,
                                    rows.select("species", "strat", "year", "count"), region="strat")
        got = out.collect()
        assert {r.strat for r in got} == {"1", "2", "3", "4", "5", "Composite"} and len(got) == 12
        assert all(r.lci <= r.uci and r.mean_n_surveys > 0 for r in got if r.trend is not None)


def test_variables_have_indices_and_trends_of_their_own(spark, sf):
    """Each operator gives for two variables in one table what it gives for each alone."""
    from flockframe.operators import indices, trends

    part = T.stratum_draws(spark, sf).filter("draw < 4")
    other = part.withColumn("value", F.sqrt("value"))
    both = part.withColumn("variable", F.lit("n")).unionByName(other.withColumn("variable", F.lit("nsmooth")))
    periods = trends.standard_periods(T.draw_generations(spark, sf), 1980, 2024)
    pairs = trends.standard_comparisons(T.draw_generations(spark, sf), 1980, 2024)
    observed = T.draw_observed(spark, sf)
    one = both.filter("strat = 1")
    for fn, draws in ((lambda d: trends.trend_endpoint(d, periods, observed, region="region"), both),
                      (lambda d: trends.trend_centered(d, periods), both),
                      (lambda d: trends.trend_slope(d, periods, region="region"), both),
                      (lambda d: trends.trend_difference(d, pairs), one),
                      (lambda d: indices.composite_index(d), both)):
        got = fn(draws)
        for name in ("n", "nsmooth"):
            alone = fn(draws.filter(F.col("variable") == name).drop("variable"))
            mine = got.filter(F.col("variable") == name).select(alone.columns)
            digits = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in alone.dtypes]
            assert sorted(map(str, mine.select(digits).collect())) == sorted(map(str, alone.select(digits).collect()))


def test_bootstrap_draws_flow_into_all_tables(spark, sf):
    rows = T.model_rows(spark, sf)
    draws = flows.bootstrap_draws(rows, first_year=1995, replicates=6, knots=3)
    total = draws.groupBy("species", "variable", "draw", "year").agg(F.sum("value").alias("value"))
    generations = rows.select("species").distinct().withColumn("gen_length", F.lit(2.0))
    out = flows.trends_and_indices(total, generations, rows.select("species", "year", "count"), first_year=1995, end_year=2001)
    assert {r.variable for r in out["trends"].collect()} == {"n", "nsmooth"}
    assert {(r.parameter, r.region_type) for r in out["differences"].collect()} == {("Difference in trends", "survey-wide")}
    index = out["indices"].groupBy("species", "variable", "year").count()
    assert index.filter("count > 1").isEmpty() and index.count() == 2 * 2 * 7


def test_encoded_grid_is_the_unfolded_one_without_unfolding(spark, sf):
    names = ["checklist_id", "species", "site_id", "hex_name", "year", "doy", "count", "site", "strat", "yr", "yr_centred", "date"]
    years = {"first_year": T.FIRST_YEAR, "last_year": T.LAST_YEAR, "min_span": 2, "stratum_share": 0.3}
    got = flows.encoded_grid(T.hex_events(spark, sf), T.counts(spark, sf), T.species(spark, sf), **years).select(names)
    want = flows.model_tables(T.surveys_hex(spark, sf), **years).select(names)
    a, b = (sorted(map(tuple, (tuple(map(str, r)) for r in df.collect()))) for df in (got, want))
    assert a == b and a
