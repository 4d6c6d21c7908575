"""Registered queries: trends, differences, map and share tables, the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import spatial, trends, zero_fill
from . import testdata as T
from .q_draws import _with
from .registry import query, r6, rounded
from .testdata import sql

_NUM = ["trend", "lci", "uci", "percent_change", "p_ch_lci", "p_ch_uci", "prob_decline",
        "prob_decline_GT30", "prob_decline_GT50", "prob_decline_GT70"]
_MEANS = ["mean_abundance", "mean_observed", "mean_n_surveys"]

_RATES = """round(avg(t), 6) AS trend, round(quantile_cont(t, 0.025), 6) AS lci,
    round(quantile_cont(t, 0.975), 6) AS uci, round(quantile_cont(ch, 0.5), 6) AS percent_change,
    round(quantile_cont(ch, 0.025), 6) AS p_ch_lci, round(quantile_cont(ch, 0.975), 6) AS p_ch_uci,
    round(count(*) FILTER (ch < 0) / count(*), 6) AS prob_decline,
    round(count(*) FILTER (ch < -30) / count(*), 6) AS "prob_decline_GT30",
    round(count(*) FILTER (ch < -50) / count(*), 6) AS "prob_decline_GT50",
    round(count(*) FILTER (ch < -70) / count(*), 6) AS "prob_decline_GT70" """


def _trend_sql(draws, region):
    """CTEs ``rates``, ``mn`` and ``ob`` over rows already labelled by region."""
    return f"""
    ends AS (SELECT p.species, trend_type, start_year, end_year, draw, {region} AS region,
        sum(CASE WHEN year = start_year THEN value END) AS a, sum(CASE WHEN year = end_year THEN value END) AS b
      FROM {draws} d JOIN periods p ON p.species = d.species GROUP BY ALL),
    rates AS (SELECT species, trend_type, start_year, end_year, region, {_RATES}
      FROM (SELECT *, ((b / a) ** (1e0 / (end_year - start_year)) - 1) * 100 AS t, (b / a - 1) * 100 AS ch FROM ends)
      GROUP BY ALL),
    mn AS (SELECT p.species, trend_type, region, avg(ym) AS mean_abundance
      FROM (SELECT species, {region} AS region, year, avg(value) AS ym FROM {draws} GROUP BY ALL) d
      JOIN periods p ON p.species = d.species WHERE year BETWEEN start_year AND end_year GROUP BY ALL),
    ob AS (SELECT p.species, trend_type, region, avg(ym) AS mean_observed, avg(n) AS mean_n_surveys
      FROM (SELECT species, {region.replace('d.', '')} AS region, year, avg(count) AS ym, count(*) AS n FROM {{obs}} GROUP BY ALL) d
      JOIN periods p ON p.species = d.species WHERE year BETWEEN start_year AND end_year GROUP BY ALL)"""


_SELECT = """SELECT r.* EXCLUDE (region){region}, round(mean_abundance, 6) AS mean_abundance,
    round(mean_observed, 6) AS mean_observed, round(mean_n_surveys, 6) AS mean_n_surveys
    FROM rates r LEFT JOIN mn ON mn.species = r.species AND mn.trend_type = r.trend_type AND mn.region = r.region
    LEFT JOIN ob ON ob.species = r.species AND ob.trend_type = r.trend_type AND ob.region = r.region"""


def _periods(spark, sf):
    return trends.standard_periods(T.draw_generations(spark, sf), 1980, 2024)


@query(_with("dsv periods dobs", _trend_sql("dsv", "'all'").replace("{obs}", "dobs"), _SELECT.format(region="")))
def trend_endpoint(spark, sf):
    out = trends.trend_endpoint(T.survey_draws(spark, sf), _periods(spark, sf), T.draw_observed(spark, sf))
    return rounded(out.drop("n_draws_dropped"), *_NUM, *_MEANS)


def _regional_sql():
    """Every row under its region and under Composite, then the plain trend SQL."""
    both = """
    d2 AS (SELECT * EXCLUDE (region), region FROM dst UNION ALL SELECT * EXCLUDE (region), 'Composite' FROM dst),
    o2 AS (SELECT species, region, year, count FROM dobs
           UNION ALL SELECT species, 'Composite', year, count FROM dobs),"""
    return both + _trend_sql("d2", "region").replace("{obs}", "o2")


@query(_with("dst periods dobs", _regional_sql(), _SELECT.format(region=", r.region")))
def trend_regional(spark, sf):
    out = trends.trend_endpoint(T.stratum_draws(spark, sf), _periods(spark, sf),
                                T.draw_observed(spark, sf), region="region")
    return rounded(out.drop("n_draws_dropped"), *_NUM, *_MEANS)


@query(sql("dst periods", """
    SELECT species, trend_type, start_year, end_year, region, round(avg(td), 6) AS centered_log_trend,
           round(quantile_cont(td, 0.025), 6) AS centered_log_trend_lci,
           round(quantile_cont(td, 0.975), 6) AS centered_log_trend_uci
    FROM (SELECT *, (ln(b / a) - ln(sum(b) OVER w / sum(a) OVER w)) / (end_year - start_year) AS td
          FROM (SELECT p.species, trend_type, start_year, end_year, region, draw,
                  sum(CASE WHEN year = start_year THEN value END) AS a,
                  sum(CASE WHEN year = end_year THEN value END) AS b
                FROM dst d JOIN periods p ON p.species = d.species GROUP BY ALL)
          WINDOW w AS (PARTITION BY species, trend_type, draw)) GROUP BY ALL"""))
def trend_centered(spark, sf):
    out = trends.trend_centered(T.stratum_draws(spark, sf), _periods(spark, sf))
    return rounded(out, "centered_log_trend", "centered_log_trend_lci", "centered_log_trend_uci")


@query(sql("dst periods", """
    SELECT species, trend_type, start_year, end_year, region, round(avg(t), 6) AS trend,
           round(quantile_cont(t, 0.025), 6) AS lci, round(quantile_cont(t, 0.975), 6) AS uci
    FROM (SELECT p.species, trend_type, start_year, end_year, region, draw,
                 (exp(regr_slope(ln(value), year)) - 1) * 100 AS t
          FROM (SELECT species, draw, year, value, region FROM dst
                UNION ALL SELECT species, draw, year, sum(value), 'Composite' FROM dst GROUP BY ALL) d
          JOIN periods p ON p.species = d.species WHERE year BETWEEN start_year AND end_year GROUP BY ALL)
    GROUP BY ALL"""))
def trend_slope(spark, sf):
    out = trends.trend_slope(T.stratum_draws(spark, sf), _periods(spark, sf), region="region")
    return rounded(out, "trend", "lci", "uci")


_PAIRS = """pairs AS (
      SELECT species, 'Three Generation vs Long-term' AS trend_type, 1980 AS s1, 2024 AS e1, 2024 - g AS s2, 2024 AS e2 FROM g3
      UNION ALL SELECT species, 'Three Generation vs Earlier Three Generation', greatest(1980, 2024 - 2 * g), 2024 - g, 2024 - g, 2024 FROM g3
      UNION ALL SELECT species, 'Three Generation vs All Previous', 1980, 2024 - g, 2024 - g, 2024 FROM g3),
    dif AS (SELECT species, trend_type, s1, e1, s2, e2,
               ((b2 / a2) ** (1e0 / (e2 - s2)) - (b1 / a1) ** (1e0 / (e1 - s1))) * 100 AS d
      FROM (SELECT p.species, trend_type, s1, e1, s2, e2, draw,
              sum(CASE WHEN year = s1 THEN value END) AS a1, sum(CASE WHEN year = e1 THEN value END) AS b1,
              sum(CASE WHEN year = s2 THEN value END) AS a2, sum(CASE WHEN year = e2 THEN value END) AS b2
            FROM dsv d JOIN pairs p ON p.species = d.species GROUP BY ALL)),
    difs AS (SELECT species, trend_type, CAST(s1 AS INTEGER) AS start_year1, CAST(e1 AS INTEGER) AS end_year1,
               CAST(s2 AS INTEGER) AS start_year2, CAST(e2 AS INTEGER) AS end_year2,
               round(avg(d), 6) AS trend_dif, round(quantile_cont(d, 0.025), 6) AS lci,
               round(quantile_cont(d, 0.975), 6) AS uci,
               round(count(*) FILTER (d < 0) / count(*), 6) AS prob_neg FROM dif GROUP BY ALL)"""


def _differences(spark, sf):
    pairs = trends.standard_comparisons(T.draw_generations(spark, sf), 1980, 2024)
    return rounded(trends.trend_difference(T.survey_draws(spark, sf), pairs),
                   "trend_dif", "lci", "uci", "prob_neg")


@query(_with("dsv g3", _PAIRS, "SELECT * FROM difs"))
def trend_difference(spark, sf):
    return _differences(spark, sf)


@query(_with("dsv g3", _PAIRS, """SELECT species, trend_type, prob_neg,
    CASE WHEN prob_neg > 0.85e0 THEN '> 85% probability negative'
         WHEN prob_neg < 1 - 0.85e0 THEN '> 85% probability positive'
         ELSE '< 85% probability of change' END AS class FROM difs"""))
def trend_class(spark, sf):
    return _differences(spark, sf).select(
        "species", "trend_type", "prob_neg", C.probability_class(F.col("prob_neg"), 0.85).alias("class"))


_BRAND_PERIODS = """gens AS (SELECT DISTINCT p_brand AS species,
      CAST(greatest(10, ceil(CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) / 2e0 * 3)) AS INTEGER) AS g FROM part),
    periods AS (SELECT species, 'Long-term' AS trend_type, 1980 AS start_year, 2024 AS end_year FROM gens
        UNION ALL SELECT species, '15-year', 2004, 2024 FROM gens
        UNION ALL SELECT species, 'Previous-three-generation', greatest(1980, 2024 - 2 * g), 2024 - g FROM gens
        UNION ALL SELECT species, 'Recent-three-generation', 2024 - g, 2024 FROM gens)"""


@query(f"WITH {_BRAND_PERIODS} " + """SELECT *, CAST(list_position(['Long-term', 'First-15-year', '15-year',
      'Previous-three-generation', 'Recent-three-generation'], trend_type) AS INTEGER) AS type_order FROM periods""")
def trend_periods(spark, sf):
    p = trends.standard_periods(T.generations(spark, sf), 1980, 2024).drop("period_no")
    return trends.trend_subset(p, ["Long-term", "15-year", "Previous-three-generation",
                                   "Recent-three-generation"])


def _bins(breaks):
    names = C.bin_labels(breaks)
    rows = " ".join(f"WHEN trend <= {b}e0 THEN '{n}'" for b, n in zip(breaks, names))
    return f"CASE WHEN trend IS NULL THEN NULL {rows} ELSE '{names[-1]}' END"


@query(_with("dst periods dobs site_hex", _regional_sql() + f""",
    tr AS (SELECT species, trend_type, region, trend, mean_abundance FROM ({_SELECT.format(region=', r.region')})),
    cells AS (SELECT DISTINCT hex_name, 'R' || CAST((q + 2 * r) % 7 + 1 AS VARCHAR) AS cell_region,
                (q + r / 2e0) * 300000e0 AS x, r * (1.5e0 * 300000e0 / sqrt(3e0)) AS y FROM site_hex)""",
             f"""SELECT hex_name, round(x, 3) AS x, round(y, 3) AS y, species, trend_type, trend,
      {_bins(C.TREND_BREAKS)} AS trend_class, mean_abundance AS size_s
    FROM cells LEFT JOIN tr ON tr.region = cell_region"""))
def trend_map_table(spark, sf):
    out = trends.trend_endpoint(T.stratum_draws(spark, sf), _periods(spark, sf),
                                T.draw_observed(spark, sf), region="region")
    tr = rounded(out, "trend", "mean_abundance")
    cells = spatial.hex_grid(T.site_cells(spark, sf), T.HEX_WIDTH)
    centres = cells.select(F.concat(F.lit("R"), ((F.col("q") + 2 * F.col("r")) % 7 + 1).cast("string"))
                           .alias("hex_name"), F.col("hex_name").alias("cell"), "x", "y")
    return trends.trend_map_table(tr, centres).select(
        F.col("cell").alias("hex_name"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"),
        "species", "trend_type", "trend", "trend_class", "size_s")


def _signif(c):
    step = f"10e0 ** (floor(log10(abs({c}))) - 2)"
    return f"CASE WHEN {c} = 0 THEN 0e0 ELSE round(round({c} / ({step})) * ({step}), 10) END AS {c}"


@query(_with("dsv periods dobs", _trend_sql("dsv", "'all'").replace("{obs}", "dobs"),
             "SELECT species, trend_type, " + ", ".join(
                 _signif(c) for c in ("trend", "lci", "uci", "percent_change", "prob_decline", "mean_n_surveys"))
             + f" FROM ({_SELECT.format(region='')})"))
def share_tables(spark, sf):
    out = trends.trend_endpoint(T.survey_draws(spark, sf), _periods(spark, sf), T.draw_observed(spark, sf))
    out = rounded(out.drop("n_draws_dropped"), *_NUM, *_MEANS)
    out = trends.share_table(out, "trend", "mean_n_surveys")
    return out.select("species", "trend_type", "trend", "lci", "uci", "percent_change", "prob_decline",
                      "mean_n_surveys")


def _number_text(c):
    return f"regexp_replace(CAST({_signif(c).rsplit(' AS ', 1)[0]} AS VARCHAR), '\\.0$', '')"


@query(_with("dsv periods dobs", _trend_sql("dsv", "'all'").replace("{obs}", "dobs"),
             f"""SELECT species, trend_type, {_number_text('percent_change')} || ' %  ' || start_year || ' : '
      || end_year || ' [ ' || {_number_text('p_ch_lci')} || '  :  ' || {_number_text('p_ch_uci')} || ' ]' AS label
    FROM ({_SELECT.format(region='')})"""))
def trend_annotations(spark, sf):
    out = trends.trend_endpoint(T.survey_draws(spark, sf), _periods(spark, sf))
    t = rounded(out, *_NUM)
    return t.select("species", "trend_type", C.trend_annotation(*[F.col(c) for c in (
        "percent_change", "start_year", "end_year", "p_ch_lci", "p_ch_uci")]).alias("label"))


@query(sql("dsv", """SELECT species, 'N_alt' AS variable, year, 'Full' AS smooth_or_full_indices,
    """ + ", ".join(_signif(c).rsplit(" AS ", 1)[0] + f" AS {n}" for c, n in (
        ("median", "predicted_mean_abundance"), ("sd", "sd"), ("lci", "lower_95percent_CL"),
        ("uci", "upper_95percent_CL"))) + """
    FROM (SELECT species, year, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS sd,
            round(quantile_cont(value, 0.025), 6) AS lci, round(quantile_cont(value, 0.975), 6) AS uci
          FROM dsv GROUP BY 1, 2)"""))
def share_index_tables(spark, sf):
    from ..operators.indices import annual_index

    d = T.survey_draws(spark, sf).withColumn("variable", F.lit("N_alt"))
    return trends.share_indices(rounded(annual_index(d), "median", "sd", "lci", "uci"))


@query(sql("zf site_xy", """SELECT site_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
    count(DISTINCT year) AS n_years FROM zf JOIN site_xy ON site_id = locality_id GROUP BY ALL"""))
def site_years(spark, sf):
    kept = zero_fill.kept_events(T.events(spark, sf), T.counts(spark, sf))
    rows = kept.select(F.col("locality_id").alias("site_id"), "year").distinct().join(
        T.sites(spark, sf).withColumnRenamed("locality_id", "site_id"), "site_id")
    return rounded(trends.site_years(rows, ["site_id", "latitude", "longitude"]), "latitude", "longitude")


@query(_with("zf", """
    span AS (SELECT species, site_id FROM zf WHERE count > 0 GROUP BY 1, 2
             HAVING max(year) - min(year) >= 4 AND count(DISTINCT year) >= 2),
    yearly AS (SELECT zf.species, year, avg(count) AS mean_count, count(*) AS n FROM zf
               JOIN span ON span.species = zf.species AND span.site_id = zf.site_id GROUP BY 1, 2)""",
             """SELECT species, a.year AS start_year, b.year AS end_year, round(a.mean_count, 6) AS first_index,
      round(b.mean_count, 6) AS last_index, round((b.mean_count / a.mean_count - 1) * 100, 6) AS percent_change,
      round(((b.mean_count / a.mean_count) ** (1e0 / (b.year - a.year)) - 1) * 100, 6) AS trend,
      a.n + b.n AS n_surveys
    FROM yearly a JOIN yearly b USING (species) WHERE a.year = 1995 AND b.year = 2001 AND a.mean_count > 0"""))
def species_trends(spark, sf):
    """Flagship: annual means over the zero-filled grid at covered sites, and their end-point trend."""
    from ..operators.zero_fill import grid_parts

    first, last = T.FIRST_YEAR, T.LAST_YEAR
    events = T.events(spark, sf).select("checklist_id", F.col("locality_id").alias("site_id"), "year")
    totals, sizes = grid_parts(events, T.counts(spark, sf), T.species(spark, sf), ["site_id", "year"])
    seen = F.when(F.col("total") > 0, F.col("year"))

    def at(year, column):
        return F.sum(F.when(F.col("year") == year, F.col(column))).alias(f"{column}_{year}")

    # coverage and end-year totals from one pass over the reported species-site pairs
    pairs = totals.groupBy(F.col("common_name").alias("species"), "site_id").agg(
        (F.max(seen) - F.min(seen)).alias("span"), F.count(seen).alias("nyears"),
        *[at(y, "total") for y in (first, last)])
    covered = pairs.filter((F.col("span") >= 4) & (F.col("nyears") >= 2))
    effort = sizes.groupBy("site_id").agg(*[at(y, "n") for y in (first, last)])
    yearly = covered.join(effort, "site_id").groupBy("species").agg(
        *[F.sum(f"{c}_{y}").alias(f"{c}_{y}") for y in (first, last) for c in ("total", "n")])
    a, b = (F.try_divide(F.coalesce(f"total_{y}", F.lit(0)), F.col(f"n_{y}")) for y in (first, last))
    r = C.ratio(a, b)
    return yearly.filter(r.isNotNull()).select(
        "species", F.lit(first).alias("start_year"), F.lit(last).alias("end_year"),
        r6(a, "first_index"), r6(b, "last_index"), r6(C.percent_change(r), "percent_change"),
        r6(C.annual_rate(r, F.lit(last - first)), "trend"),
        (F.col(f"n_{first}") + F.col(f"n_{last}")).alias("n_surveys"))


# --- full and smooth index side by side ---------------------------------------

_TWO = """vars AS (SELECT unnest(['n', 'nsmooth']) AS variable),
    dv AS (SELECT d.* REPLACE (species || '/' || variable AS species,
             CASE WHEN variable = 'n' THEN value ELSE sqrt(value) END AS value) FROM {draws} d, vars),
    pv AS (SELECT p.* REPLACE (species || '/' || variable AS species) FROM {per_species} p, vars)"""
_APART = """SELECT * REPLACE (split_part(species, '/', 1) AS species), split_part(species, '/', 2) AS variable
    FROM ({inner})"""


def _two(draws):
    """Every draw under the full index and, with other numbers, under the smooth one."""
    return draws.withColumn("variable", F.explode(F.array(F.lit("n"), F.lit("nsmooth")))).withColumn(
        "value", F.when(F.col("variable") == "n", F.col("value")).otherwise(F.sqrt("value")))


@query(_with("dsv periods dobs", _TWO.format(draws="dsv", per_species="periods") + """,
    ov AS (SELECT o.* REPLACE (species || '/' || variable AS species) FROM dobs o, vars),"""
             + _trend_sql("dv", "'all'").replace("periods", "pv").replace("{obs}", "ov"),
             _APART.format(inner=_SELECT.format(region="") ) ))
def trend_endpoint_by_variable(spark, sf):
    out = trends.trend_endpoint(_two(T.survey_draws(spark, sf)), _periods(spark, sf), T.draw_observed(spark, sf))
    return rounded(out.drop("n_draws_dropped"), *_NUM, *_MEANS)


@query(_with("dsv g3", _TWO.format(draws="dsv", per_species="g3") + ", "
             + _PAIRS.replace("FROM g3", "FROM pv").replace("dsv d", "dv d"),
             _APART.format(inner="""SELECT *, 'Difference in trends' AS parameter, 'survey-wide' AS region_type FROM difs""")))
def trend_difference_by_variable(spark, sf):
    pairs = trends.standard_comparisons(T.draw_generations(spark, sf), 1980, 2024)
    out = trends.labelled(trends.trend_difference(_two(T.survey_draws(spark, sf)), pairs), "Difference in trends")
    return rounded(out, "trend_dif", "lci", "uci", "prob_neg")


@query(_with("dst periods", """
    ends AS (SELECT p.species, trend_type, region, draw, end_year - start_year AS n,
        sum(CASE WHEN year = end_year THEN value END) / sum(CASE WHEN year = start_year THEN value END) AS r
      FROM dst d JOIN periods p ON p.species = d.species GROUP BY ALL),
    tr AS (SELECT species, trend_type, region, round(avg((r ** (1e0 / n) - 1) * 100), 6) AS trend FROM ends GROUP BY ALL)""",
             f"SELECT species, trend_type, region, trend, {_bins(C.TREND_BREAKS_FINE)} AS trend_class FROM tr"))
def trend_classes_fine(spark, sf):
    """The finer legend, over regional trends."""
    out = trends.trend_endpoint(T.stratum_draws(spark, sf), _periods(spark, sf), region="region")
    tr = rounded(out.filter("region <> 'Composite'"), "trend").select("species", "trend_type", "region", "trend")
    return tr.withColumn("trend_class", C.trend_bin(F.col("trend"), C.TREND_BREAKS_FINE))
