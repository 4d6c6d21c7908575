"""The three end-to-end flows: surveys, model tables, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import clean, coverage, model, spatial, trends
from ..operators.indices import annual_index, stage_labels
from ..operators.zero_fill import kept_events, reported, zero_fill
from ..session import checkpoint


def prepare_surveys(events: DataFrame, obs: DataFrame, species: DataFrame, *,
                    first_year: int, last_year: int, cell_width: float,
                    regions: DataFrame | None = None) -> DataFrame:
    """Raw events and observations -> zero-filled surveys with cell and region.

    Cells and regions are found per site, not per survey, and joined back before
    the grid is unfolded.
    """
    events = clean.between_years(clean.add_event_columns(events), first_year, last_year)
    sites = spatial.hex_assign(spatial.project_laea(
        events.select("locality_id", "longitude", "latitude").distinct()), cell_width)
    if regions is not None:
        sites = spatial.nearest_polygon(sites, regions).withColumnRenamed("poly_id", "region")
    keep = [c for c in ("hex_name", "region") if c in sites.columns]
    # one cell per site: a site with several coordinates takes its least cell name
    placed = sites.groupBy("locality_id").agg(F.min(F.struct(*keep)).alias("__p")).select(
        "locality_id", "__p.*")
    events = events.drop(*keep).join(placed, "locality_id", "left").select(
        "checklist_id", F.col("locality_id").alias("site_id"), "year",
        F.col("day_of_year").alias("doy"), *keep)
    grid = zero_fill(events, clean.clean_counts(obs), species)
    return grid.withColumnsRenamed({"common_name": "species", "observation_count": "count"})


def model_tables(surveys: DataFrame, *, first_year: int, last_year: int, min_span: int = 10,
                 stratum_share: float = 0.67) -> DataFrame:
    """Coverage filters, one region per stratum, and integer codes, for all species at once.

    The surveys are read twice: their non-zero rows, reduced to site-year sums, decide
    coverage; then the covered rows are written out and coded from there.
    """
    place = [c for c in ("site_id", "hex_name") if c in surveys.columns]
    seen = checkpoint(surveys.filter(F.col("count") > 0).groupBy("species", *place, "year")
                      .agg(F.count(F.lit(1)).alias("n")))
    columns = {"count": "n", "weight": "n"}
    sites = checkpoint(coverage.site_coverage(seen, min_span, **columns).select("species", "site_id"))
    strata = coverage.stratum_coverage(coverage.keep_covered(seen, sites, ["species", "site_id"]),
                                       first_year, last_year, stratum_share, **columns)
    kept = checkpoint(coverage.keep_covered(coverage.keep_covered(surveys, sites, ["species", "site_id"]),
                                            strata, ["species", "hex_name"]))
    if "region" in kept.columns:
        region = coverage.group_category(kept, ["species", "hex_name"], "region")
        kept = kept.drop("region").join(region, ["species", "hex_name"], "left")
    return coverage.index_encode(kept)


def encoded_grid(events: DataFrame, obs: DataFrame, species: DataFrame, *, first_year: int, last_year: int,
                 min_span: int = 10, stratum_share: float = 0.67) -> DataFrame:
    """``model_tables`` from events (checklist_id, site_id, hex_name, year, doy) and clean observations.

    Coverage and codes come from the reported pairs. Each site then has one short list of the species
    that are covered there, with their codes; events meet the list of their site and unfold only that,
    so rows of the full grid that coverage drops are never made and nothing large is written.
    """
    key, place = "checklist_id", ["site_id", "hex_name"]
    seen = checkpoint(reported(events, obs, species).withColumnRenamed("common_name", "species")
                      .filter("observation_count > 0").groupBy("species", *place, "year")
                      .agg(F.count(F.lit(1)).alias("n")))
    columns = {"count": "n", "weight": "n"}
    sites = coverage.site_coverage(seen, min_span, **columns).select("species", "site_id")
    rows = checkpoint(coverage.keep_covered(seen, sites, ["species", "site_id"]))
    strata = coverage.stratum_coverage(rows, first_year, last_year, stratum_share, **columns)
    kept = kept_events(events, obs)
    # first and last year and day of all surveys at a place, reported or not
    spans = kept.groupBy(*place).agg(F.min("year").alias("year"), F.max("year").alias("__last"), F.min("doy").alias("doy"))
    placed = sites.join(spans, "site_id").join(strata.select("species", "hex_name"), ["species", "hex_name"], "left_semi")
    both = F.array(F.struct(F.col("year"), F.col("doy")), F.struct(F.col("__last").alias("year"), F.col("doy")))
    codes = coverage.code_table(placed.select("species", *place, F.explode(both).alias("b")).select("species", *place, "b.*"))
    lists = codes.groupBy(*place).agg(F.collect_list(F.struct(
        "species", "site", "strat", "__year0", "__day0", "__mid")).alias("__covered"))
    counts = (reported(events.select(key), obs, species).groupBy(key)
              .agg(F.map_from_entries(F.collect_list(F.struct("common_name", "observation_count"))).alias("__counts")))
    met = (kept.join(lists, place).join(counts, key, "left")
           .withColumn("__c", F.explode("__covered")).select("*", "__c.*").drop("__c", "__covered"))
    there = F.coalesce(F.map_contains_key("__counts", F.col("species")), F.lit(False))
    return (met.withColumn("count", F.when(there, F.element_at("__counts", F.col("species"))).otherwise(0))
            .withColumn("yr", (F.col("year") - F.col("__year0")).cast("int"))
            .withColumn("yr_centred", (F.col("yr") - F.col("__mid")).cast("int"))
            .withColumn("date", (F.col("doy") - F.col("__day0")).cast("int"))
            .drop("__year0", "__day0", "__mid", "__counts"))


def bootstrap_draws(encoded: DataFrame, *, first_year: int, replicates: int = 100, knots: int | None = None,
                    seed: int = 0) -> DataFrame:
    """Full and smooth stratum draws ready for the trend operators.

    species, variable (``n`` or ``nsmooth``), strat, draw, year, value. The number of
    knots is a quarter of the years unless given.
    """
    if knots is None:
        span = encoded.agg(F.max("yr")).first()[0] or 4
        knots = -(-span // 4)
    full = checkpoint(model.bootstrap_index(encoded, replicates, seed))
    basis = model.spline_basis(encoded, "yr", max(knots, 2))
    smooth = model.smooth_index(full, basis, ["species", "strat", "draw"])
    return (full.withColumn("variable", F.lit("n"))
            .unionByName(smooth.withColumn("variable", F.lit("nsmooth")))
            .withColumn("year", F.col("yr") + first_year - 1))


def trends_and_indices(draws: DataFrame, generations: DataFrame, observed: DataFrame, *,
                       first_year: int, end_year: int) -> dict[str, DataFrame]:
    """Index table, trends of the standard periods and their differences, in three lazy tables."""
    periods = trends.standard_periods(generations, first_year, end_year)
    pairs = trends.standard_comparisons(generations, first_year, end_year)
    stages = stage_labels(generations, first_year, end_year)
    of = tuple(trends.of_index(draws))
    return {"indices": annual_index(draws, stages, (*of, "year")),
            "trends": trends.labelled(trends.trend_endpoint(draws, periods, observed)),
            "differences": trends.labelled(trends.trend_difference(draws, pairs), "Difference in trends")}
