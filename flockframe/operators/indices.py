"""Annual indices, observed means beside them, and count adjustments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as C
from ..functions.aggregates import interval, quantile, quantiles
from ..session import join_on
from .draws import summarise

COMPOSITE = "Composite"


def with_composite(regional: DataFrame, region: str = "region") -> DataFrame:
    """Every row once under its region and once under the overall label.

    Meant for rows already summed per region, so that only these few are doubled.
    The region comes out as text.
    """
    return regional.withColumn(region, F.explode(F.array(
        F.col(region).cast("string"), F.lit(COMPOSITE))))


def composite_index(draws: DataFrame, region: str = "region", ci: float = 0.95) -> DataFrame:
    """Per draw sums by region and year, and over all regions, then their summary; by variable, if any."""
    of = ["species", *[c for c in ("variable",) if c in draws.columns]]
    sums = (draws.groupBy(*of, "draw", region, "year").agg(F.sum("value").alias("value")))
    both = (with_composite(sums, region)
            .groupBy(*of, "draw", region, "year").agg(F.sum("value").alias("value")))
    lo, hi = interval(ci)
    out = both.groupBy(*of, region, "year").agg(
        quantiles(F.col("value"), [0.5, lo, hi]).alias("__q"), F.avg("value").alias("mean"))
    return out.select(*of, region, "year", F.col("__q")[0].alias("median"), "mean",
                      F.col("__q")[1].alias("lci"), F.col("__q")[2].alias("uci"))


def annual_index(draws: DataFrame, stages: DataFrame | None = None,
                 keys: tuple[str, ...] = ("species", "variable", "year")) -> DataFrame:
    """Index table per species, variable and year, with the stage of the year if given."""
    table = summarise(draws, list(keys))
    return table if stages is None else table.join(stages, ["species", "year"], "left")


def stage_labels(generations: DataFrame, first_year: int, end_year: int) -> DataFrame:
    """species x year -> recent / previous / earlier."""
    years = F.sequence(F.lit(first_year), F.lit(end_year))
    return (generations.withColumn("year", F.explode(years))
            .withColumn("three_gen", C.three_generations(F.col("gen_length")))
            .select("species", "year",
                    C.stage_label(F.col("year"), F.lit(end_year), F.col("three_gen")).alias("stage")))


def observed_summary(surveys: DataFrame, keys: list[str], value: Column | str = "count",
                     distinct_of: str | None = None, offset: str | None = None) -> DataFrame:
    """Observed mean, 5 % / 95 % quantile, median, survey number per key.

    ``distinct_of`` counts strata or sites (``n_<name>``); ``offset`` adds the
    mean of an adjustment column over the rows of the key.

    Rows are reduced to distinct values with frequencies before the shuffle, so
    the quantiles see one entry per distinct value.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    freq = (surveys.select(*keys, v.alias("__v")).groupBy(*keys, "__v")
            .agg(F.count(F.lit(1)).alias("__n")))
    q = F.percentile("__v", F.array(F.lit(0.05), F.lit(0.95), F.lit(0.5)), F.col("__n"))
    total = F.sum(F.when(F.col("__v").isNotNull(), F.col("__n")))
    out = freq.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("__v") * F.col("__n")), total).alias("obsmean"), q.alias("__q"),
        F.sum("__n").alias("nsurveys"))
    out = (out.withColumns({"obslci": F.col("__q")[0], "obsuci": F.col("__q")[1],
                            "obsmed": F.col("__q")[2], "sqrt_n": F.sqrt("nsurveys")}).drop("__q"))
    if distinct_of:
        n = (surveys.select(*keys, distinct_of).distinct().groupBy(*keys)
             .agg(F.count(F.lit(1)).alias(f"n_{distinct_of}")))
        out = join_on(out, n, keys)
    if offset:
        out = join_on(out, surveys.groupBy(*keys).agg(F.avg(offset).alias("mean_counts_incl")), keys)
    return out


def index_with_observed(index: DataFrame, observed: DataFrame, keys: list[str],
                        correction: DataFrame | None = None) -> DataFrame:
    """Index table beside observed means; ``correction(species, year, p_alpha)`` rescales them."""
    out = index.join(observed, keys, "left")
    if correction is not None:
        out = (out.join(correction, ["species", "year"], "left")
               .withColumn("obsmean", F.col("obsmean") * F.col("p_alpha"))
               .withColumn("obsmed", F.col("obsmed") * F.col("p_alpha")))
    return out


def _weighted(value: str, weight: str | None, probs) -> tuple[Column, Column, Column]:
    """Number, mean and quantiles of values, each counted ``weight`` times (once without)."""
    w = F.lit(1) if weight is None else F.col(weight)
    known = F.sum(F.when(F.col(value).isNotNull(), w))
    q = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(p) for p in probs]), w)
    return F.sum(w), F.try_divide(F.sum(F.col(value) * w), known), q


def observed_quartiles(surveys: DataFrame, keys: list[str], value: str = "count",
                       weight: str | None = None) -> DataFrame:
    """n, mean and quartiles of the counts per key; ``weight``: surveys behind a row, if rows are values."""
    n, mean, q = _weighted(value, weight, [0.25, 0.75])
    return (surveys.groupBy(*keys)
            .agg(n.alias("n_counts"), mean.alias("mean_counts"), q.alias("__q"))
            .withColumns({"lqrt_counts": F.col("__q")[0], "uqrt_counts": F.col("__q")[1]})
            .drop("__q"))


def season_scale(season_draws: DataFrame, keys: list[str]) -> DataFrame:
    """Scale factor 1 / exp(mean season effect) per day [and season group]."""
    return season_draws.groupBy(*keys).agg(F.exp(-F.avg("value")).alias("seas_sc"))


def season_scaled_counts(surveys: DataFrame, scale: DataFrame, keys: list[str]) -> DataFrame:
    """Add count_scale = count * scale of the day."""
    return (surveys.join(scale, keys, "left")
            .withColumn("count_scale", F.col("count") * F.col("seas_sc")))


def site_effects(alpha_draws: DataFrame, *, transform: bool = True, shift: Column | None = None,
                 keys: tuple[str, ...] = ("species", "site")) -> DataFrame:
    """Mean and 95 % interval of exp(alpha [+ shift]) (or alpha itself) per site."""
    v = F.col("value") if shift is None else F.col("value") + shift
    v = F.exp(v) if transform else v
    out = alpha_draws.groupBy(*keys).agg(F.avg(v).alias("mean"),
                                         quantiles(v, [0.025, 0.975]).alias("__q"))
    return out.withColumns({"lci": F.col("__q")[0], "uci": F.col("__q")[1]}).drop("__q")


def site_correction(surveys: DataFrame, alpha: DataFrame) -> DataFrame:
    """Per species and year 1 / (share of all site sizes among the sites visited).

    ``alpha``: species, site, mean (log scale).
    """
    total = alpha.groupBy("species").agg(F.sum(F.exp("mean")).alias("__total"))
    size = alpha.join(total, "species").select(
        "species", "site", F.try_divide(F.exp("mean"), F.col("__total")).alias("__share"))
    visited = surveys.select("species", "year", "site").distinct()
    return (visited.join(size, ["species", "site"])
            .groupBy("species", "year")
            .agg(F.try_divide(F.lit(1.0), F.sum("__share")).alias("p_alpha")))


def site_effect_drift(surveys: DataFrame, alpha: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean effect of the sites visited in a year, each site once."""
    visited = surveys.select("species", "year", "site", *by).distinct()
    return (visited.join(alpha.select("species", "site", "mean"), ["species", "site"], "left")
            .groupBy("species", "year", *by).agg(F.avg("mean").alias("mean_alpha")))


def stratum_offsets(alphas: DataFrame, site_strata: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and median site effect per stratum or season group."""
    return (alphas.join(site_strata, ["species", "site"])
            .groupBy(*keys)
            .agg(F.avg("mean").alias("adjs"), quantile(F.col("mean"), 0.5).alias("adjs2")))


def season_curve(season_draws: DataFrame, shift: DataFrame, offsets: DataFrame) -> DataFrame:
    """Season curve on the count scale for every stratum.

    ``season_draws``: species, day[, seas_strat], draw, value; ``shift``: species, shift;
    ``offsets``: species, strat[, seas_strat], adjs. Strata meet days through the
    species (and season group), so nothing is paired across species.
    """
    group = [c for c in ("species", "seas_strat")
             if c in season_draws.columns and c in offsets.columns]
    keys = [c for c in ("species", "seas_strat", "day") if c in season_draws.columns]
    effect = site_effects(season_draws.join(shift, "species"), shift=F.col("shift"), keys=tuple(keys))
    return (effect.join(offsets, group)
            .withColumns({c: F.col(c) * F.col("adjs") for c in ("mean", "lci", "uci")}))


def season_profile(surveys: DataFrame, keys: list[str], value: str = "count",
                   weight: str | None = None) -> DataFrame:
    """Observed mean, median, 5 % and 95 % quantile by day [and season group]; ``weight`` as above."""
    _, mean, q = _weighted(value, weight, [0.5, 0.05, 0.95])
    return (surveys.groupBy(*keys).agg(mean.alias("mean"), q.alias("__q"))
            .withColumns({"median": F.col("__q")[0], "lqrt": F.col("__q")[1],
                          "uqrt": F.col("__q")[2]}).drop("__q"))
