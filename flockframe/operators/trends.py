"""Trends from annual draws, for all species and periods at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import columns as C
from ..functions.aggregates import interval, log_slope, quantiles, share_below
from ..session import join_on
from .indices import COMPOSITE, with_composite

DECLINES = {"prob_decline": 0, "prob_decline_GT30": -30,
            "prob_decline_GT50": -50, "prob_decline_GT70": -70}


def standard_periods(generations: DataFrame, first_year: int = 1980, end_year: int = 2024,
                     recent_start: int = 2004, early_end: int = 1995) -> DataFrame:
    """species, trend_type, start_year, end_year for the five standard periods.

    The "15-year" period keeps its fixed start, whatever the end year is.
    """
    three = C.three_generations(F.col("gen_length"))
    y3g = F.lit(end_year) - three
    before = F.greatest(F.lit(first_year), y3g - three)

    def period(i, name, start, end):
        return F.struct(F.lit(i).alias("period_no"), F.lit(name).alias("trend_type"),
                        start.cast("int").alias("start_year"), end.cast("int").alias("end_year"))

    first, last = F.lit(first_year), F.lit(end_year)
    return generations.select("species", F.explode(F.array(
        period(1, "Long-term", first, last),
        period(2, "First-15-year", first, F.lit(early_end)),
        period(3, "15-year", F.lit(recent_start), last),
        period(4, "Previous-three-generation", before, y3g),
        period(5, "Recent-three-generation", y3g, last))).alias("p")).select("species", "p.*")


def standard_comparisons(generations: DataFrame, first_year: int = 1980, end_year: int = 2024
                         ) -> DataFrame:
    """Period pairs of the three standard trend differences."""
    three = C.three_generations(F.col("gen_length"))
    y3g = F.lit(end_year) - three
    before = F.greatest(F.lit(first_year), y3g - three)
    first, last = F.lit(first_year), F.lit(end_year)

    def pair(name, *years):
        names = ("start_year1", "end_year1", "start_year2", "end_year2")
        return F.struct(F.lit(name).alias("trend_type"),
                        *[y.cast("int").alias(n) for y, n in zip(years, names)])

    return generations.select("species", F.explode(F.array(
        pair("Three Generation vs Long-term", first, last, y3g, last),
        pair("Three Generation vs Earlier Three Generation", before, y3g, y3g, last),
        pair("Three Generation vs All Previous", first, y3g, y3g, last))).alias("p")
    ).select("species", "p.*")


def of_index(draws: DataFrame) -> list[str]:
    """Keys that tell one index from another: species, and the variable where the draws have one."""
    return ["species", *[c for c in ("variable",) if c in draws.columns]]


def _end_points(draws, periods, by):
    """Start and end value per period and draw: only the two end years enter the shuffle."""
    at_end = (F.col("year") == F.col("start_year")) | (F.col("year") == F.col("end_year"))
    return (draws.join(periods, "species").filter(at_end)
            .groupBy(*of_index(draws), "trend_type", "start_year", "end_year", "draw", *by)
            .agg(F.sum(F.when(F.col("year") == F.col("start_year"), F.col("value"))).alias("start"),
                 F.sum(F.when(F.col("year") == F.col("end_year"), F.col("value"))).alias("end")))


def _trend_table(ends, keys, ci):
    lo, hi = interval(ci)
    r = C.ratio(F.col("start"), F.col("end"))
    rows = ends.select(*keys, C.annual_rate(r, F.col("end_year") - F.col("start_year")).alias("t"),
                       C.percent_change(r).alias("ch"))
    out = rows.groupBy(*keys).agg(
        F.avg("t").alias("trend"), quantiles(F.col("t"), [lo, hi]).alias("__t"),
        quantiles(F.col("ch"), [0.5, lo, hi]).alias("__c"),
        *[share_below(F.col("ch"), th).alias(n) for n, th in DECLINES.items()],
        F.count_if(F.col("t").isNull()).alias("n_draws_dropped"))
    return out.select(
        *keys, "trend", F.col("__t")[0].alias("lci"), F.col("__t")[1].alias("uci"),
        F.col("__c")[0].alias("percent_change"), F.col("__c")[1].alias("p_ch_lci"),
        F.col("__c")[2].alias("p_ch_uci"), *DECLINES, "n_draws_dropped")


def _mean_of_years(yearly, periods, keys, columns):
    """Mean over the years of a period of per-year numbers."""
    return (yearly.join(periods, "species")
            .filter(F.col("year").between(F.col("start_year"), F.col("end_year")))
            .groupBy(*keys).agg(*[F.avg(c).alias(n) for c, n in columns.items()]))


def _yearly(df, value, by, composite):
    """Per-year mean and number, by region and (if asked) over all rows."""
    part = df.groupBy(*of_index(df), "year", *by).agg(F.sum(value).cast("double").alias("__s"),
                                                  F.count(value).alias("__k"),
                                                  F.count(F.lit(1)).alias("__r"))
    if composite:
        part = (with_composite(part, by[0]).groupBy(*of_index(part), "year", *by)
                .agg(*[F.sum(c).alias(c) for c in ("__s", "__k", "__r")]))
    return part.select(*of_index(part), "year", *by, F.try_divide("__s", "__k").alias("ym"),
                       F.col("__r").cast("double").alias("n_c"))


def trend_endpoint(draws: DataFrame, periods: DataFrame, observed: DataFrame | None = None,
                   *, region: str | None = None, ci: float = 0.95) -> DataFrame:
    """End-point trend of every species and period, by region plus the overall sum if asked.

    draws: species[, variable], draw, year, value[, region]; observed: species, year, count[, region].
    Every variable has trends of its own beside the same observed means.
    """
    by = [region] if region else []
    periods = periods.select("species", "trend_type", "start_year", "end_year")
    seen = ["species", "trend_type", "start_year", "end_year", *by]
    keys = [*of_index(draws), *seen[1:]]
    ends = _end_points(draws, periods, by)
    if region:
        ends = (with_composite(ends, region).groupBy(*keys, "draw")
                .agg(F.sum("start").alias("start"), F.sum("end").alias("end")))
    out = _trend_table(ends, keys, ci)
    mean = _mean_of_years(_yearly(draws, "value", by, bool(region)), periods, keys,
                          {"ym": "mean_abundance"})
    out = join_on(out, mean, keys, "left")
    if observed is not None:
        obs = _mean_of_years(_yearly(observed.drop("variable"), "count", by, bool(region)), periods, seen,
                             {"ym": "mean_observed", "n_c": "mean_n_surveys"})
        out = join_on(out, obs, seen, "left")
    return out


def trend_centered(draws: DataFrame, periods: DataFrame, region: str = "region", ci: float = 0.95
                   ) -> DataFrame:
    """Regional log trend less the overall log trend per draw, per year of the period; by variable, if any."""
    periods = periods.select("species", "trend_type", "start_year", "end_year")
    keys = [*of_index(draws), "trend_type", "start_year", "end_year"]
    draws = draws.withColumn(region, F.col(region).cast("string"))
    draw = Window.partitionBy(*keys, "draw")  # one row per region
    ends = (_end_points(draws, periods, [region])
            .withColumn("__start", F.sum("start").over(draw))
            .withColumn("__end", F.sum("end").over(draw)))

    def log_ratio(a, b):
        r = C.ratio(F.col(a), F.col(b))
        return F.when(r > 0, F.log(r))

    lo, hi = interval(ci)
    td = F.try_divide(log_ratio("start", "end") - log_ratio("__start", "__end"),
                      F.col("end_year") - F.col("start_year"))
    out = ends.groupBy(*keys, region).agg(F.avg(td).alias("centered_log_trend"),
                                          quantiles(td, [lo, hi]).alias("__q"))
    return (out.withColumn("centered_log_trend_lci", F.col("__q")[0])
            .withColumn("centered_log_trend_uci", F.col("__q")[1]).drop("__q"))


def trend_slope(draws: DataFrame, periods: DataFrame, *, region: str | None = None,
                ci: float = 0.95) -> DataFrame:
    """Log-scale least-squares trend per draw, summarised; the overall form uses yearly sums; by variable, if any."""
    periods = periods.select("species", "trend_type", "start_year", "end_year")
    keys = [*of_index(draws), "trend_type", "start_year", "end_year"]

    def slopes(rows, by):
        inside = rows.join(periods, "species").filter(
            F.col("year").between(F.col("start_year"), F.col("end_year")))
        return inside.groupBy(*keys, *by, "draw").agg(
            C.slope_percent(log_slope(F.col("value"), F.col("year"))).alias("t"))

    if region:
        draws = draws.withColumn(region, F.col(region).cast("string"))
        totals = draws.groupBy(*of_index(draws), "draw", "year").agg(F.sum("value").alias("value"))
        per_draw = slopes(draws, [region]).unionByName(
            slopes(totals, []).withColumn(region, F.lit(COMPOSITE)))
        keys = [*keys, region]
    else:
        per_draw = slopes(draws, [])
    lo, hi = interval(ci)
    out = per_draw.groupBy(*keys).agg(F.avg("t").alias("trend"),
                                      quantiles(F.col("t"), [lo, hi]).alias("__q"))
    return out.withColumn("lci", F.col("__q")[0]).withColumn("uci", F.col("__q")[1]).drop("__q")


def trend_difference(draws: DataFrame, comparisons: DataFrame, ci: float = 0.95) -> DataFrame:
    """Per draw second trend minus first, its mean, interval and chance of being negative; by variable, if any."""
    years = ["start_year1", "end_year1", "start_year2", "end_year2"]
    keys = [*of_index(draws), "trend_type", *years]
    wanted = F.array_contains(F.array(*years), F.col("year"))
    ends = (draws.join(comparisons.select("species", "trend_type", *years), "species").filter(wanted)
            .groupBy(*keys, "draw")
            .agg(*[F.sum(F.when(F.col("year") == F.col(y), F.col("value"))).alias("v_" + y)
                   for y in years]))

    def rate(i):
        return C.annual_rate(C.ratio(F.col(f"v_start_year{i}"), F.col(f"v_end_year{i}")),
                             F.col(f"end_year{i}") - F.col(f"start_year{i}"))

    lo, hi = interval(ci)
    rows = ends.select(*keys, (rate(2) - rate(1)).alias("d"))
    out = rows.groupBy(*keys).agg(F.avg("d").alias("trend_dif"),
                                  quantiles(F.col("d"), [lo, hi]).alias("__q"),
                                  share_below(F.col("d"), 0).alias("prob_neg"))
    return out.withColumn("lci", F.col("__q")[0]).withColumn("uci", F.col("__q")[1]).drop("__q")


def labelled(trends: DataFrame, parameter: str = "Trend", region: str | None = None) -> DataFrame:
    """Columns of the written tables: the parameter, and whether a row is one region or all of them."""
    out = trends.withColumn("parameter", F.lit(parameter))
    if region is None:
        return out.withColumn("region_type", F.lit("survey-wide"))
    return out.withColumn("region_type", F.when(F.col(region) == COMPOSITE, "survey-wide").otherwise(region))


def trend_subset(trends: DataFrame, types: list[str]) -> DataFrame:
    """Rows of the named trend types, with their order of presentation."""
    order = F.array_position(F.array(*[F.lit(t) for t in (
        "Long-term", "First-15-year", "15-year", "Previous-three-generation",
        "Recent-three-generation")]), F.col("trend_type")).cast("int")
    return trends.filter(F.col("trend_type").isin(*types)).withColumn("type_order", order)


def trend_map_table(trends: DataFrame, centres: DataFrame, size: str = "mean_abundance",
                    region: str = "region", breaks=C.TREND_BREAKS) -> DataFrame:
    """Cell centre, trend class and symbol size for a trend map; cells without trend stay."""
    return (centres.join(trends, centres["hex_name"] == trends[region], "left")
            .withColumn("trend_class", C.trend_bin(F.col("trend"), breaks))
            .withColumn("class_no", C.bin_ordinal(F.col("trend"), breaks))
            .withColumn("size_s", F.col(size)))


def site_years(surveys: DataFrame, site_columns: list[str]) -> DataFrame:
    """Number of years with surveys per site."""
    return (surveys.select(*site_columns, "year").distinct()
            .groupBy(*site_columns).agg(F.count(F.lit(1)).alias("n_years")))


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Column names from ``first`` to ``last`` as they stand in the table."""
    return df.columns[df.columns.index(first):df.columns.index(last) + 1]


def share_table(df: DataFrame, first: str, last: str, digits: int = 3) -> DataFrame:
    """Round the column range ``first:last`` to significant digits."""
    return df.withColumns({c: C.signif(F.col(c).cast("double"), digits)
                           for c in column_range(df, first, last)})


def share_indices(indices: DataFrame, full_variable: str = "N_alt") -> DataFrame:
    """Public index table: Full / Smooth label, renamed limits, three digits."""
    rounded = share_table(indices.select("species", "variable", "year", "median", "sd", "lci", "uci"),
                          "median", "uci")
    return rounded.withColumn(
        "smooth_or_full_indices", F.when(F.col("variable") == full_variable, "Full").otherwise("Smooth")
    ).withColumnsRenamed({"median": "predicted_mean_abundance", "lci": "lower_95percent_CL",
                          "uci": "upper_95percent_CL"})
