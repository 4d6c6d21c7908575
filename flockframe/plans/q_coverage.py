"""Registered queries: coverage filters, codes, effort, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, zero_fill
from . import flows, testdata as T
from .registry import query, r6
from .testdata import sql

_SPAN = """(SELECT species, {k}, count(*) AS nyears, max(year) - min(year) AS span_years, min(year) AS fyear,
       max(year) AS lyear, sum(n) AS nobs
     FROM (SELECT species, {k}, year, count(*) AS n FROM {t} WHERE count > 0 GROUP BY ALL) GROUP BY ALL)"""


@query(sql("zf", f"""SELECT species, site_id, nyears, CAST(span_years AS INTEGER) AS span_years, fyear, lyear,
    CAST(nobs AS BIGINT) AS nobs FROM {_SPAN.format(k='site_id', t='zf')} WHERE span_years >= 4 AND nyears >= 2"""))
def site_coverage(spark, sf):
    return coverage.site_coverage(T.reported(spark, sf), min_span=4)


@query(sql("zfh", f"""SELECT species, hex_name, nyears, CAST(span_years AS INTEGER) AS span_years, fyear, lyear,
    CAST(nobs AS BIGINT) AS nobs FROM {_SPAN.format(k='hex_name', t='zfh')} WHERE span_years >= 0.67e0 * 7"""))
def stratum_coverage(spark, sf):
    return coverage.stratum_coverage(T.reported_hex(spark, sf), T.FIRST_YEAR, T.LAST_YEAR)


_CAT = """SELECT species, hex_name, region FROM (
    SELECT species, hex_name, region, row_number() OVER (PARTITION BY species, hex_name ORDER BY n {o}, region) AS rn
    FROM (SELECT species, hex_name, region, count(*) AS n FROM zfh JOIN site_regions ON site_id = locality_id
          WHERE count > 0 GROUP BY ALL)) WHERE rn = 1"""


def _present(spark, sf):
    return T.reported_hex(spark, sf, ("region",)).filter("count > 0")


@query(sql("zfh site_regions", _CAT.format(o="")))
def group_category(spark, sf):
    return coverage.group_category(_present(spark, sf), ["species", "hex_name"], "region")


@query(sql("zfh site_regions", _CAT.format(o="DESC")))
def dominant_category(spark, sf):
    return coverage.group_category(_present(spark, sf), ["species", "hex_name"], "region", which="most")


@query(sql("cnt ev", """SELECT common_name, locality_id,
      CAST(dense_rank() OVER (PARTITION BY common_name ORDER BY locality_id) AS INTEGER) AS code
    FROM (SELECT DISTINCT common_name, locality_id FROM cnt JOIN ev USING (checklist_id))"""))
def dense_codes(spark, sf):
    seen = T.counts(spark, sf).join(T.events(spark, sf), "checklist_id")
    return coverage.dense_codes(seen, ["common_name"], "locality_id")


@query(sql("cnt ev", """SELECT common_name, locality_id,
      CAST(dense_rank() OVER (PARTITION BY common_name ORDER BY locality_id) AS INTEGER) AS code
    FROM (SELECT DISTINCT common_name, locality_id FROM cnt JOIN ev USING (checklist_id))"""))
def dense_codes_spread(spark, sf):
    """One numbering over all species, taken back to each species' first."""
    seen = T.counts(spark, sf).join(T.events(spark, sf), "checklist_id").select("common_name", "locality_id")
    pair = F.struct("common_name", "locality_id")
    codes = coverage.dense_codes(seen.select(pair.alias("pair")), [], "pair").select("pair.*", "code")
    first = codes.groupBy("common_name").agg(F.min("code").alias("first"))
    return codes.join(first, "common_name").select(
        "common_name", "locality_id", (F.col("code") - F.col("first") + 1).alias("code"))


def _covered(spark, sf):
    return flows.encoded_grid(T.hex_events(spark, sf), T.counts(spark, sf), T.species(spark, sf),
                              first_year=T.FIRST_YEAR, last_year=T.LAST_YEAR, min_span=4)


_KEPT = f"""k1 AS (SELECT zfh.* FROM zfh JOIN {_SPAN.format(k='site_id', t='zfh')} s
      ON s.species = zfh.species AND s.site_id = zfh.site_id WHERE span_years >= 4 AND nyears >= 2),
    k2 AS (SELECT k1.* FROM k1 JOIN {_SPAN.format(k='hex_name', t='k1')} s
      ON s.species = k1.species AND s.hex_name = k1.hex_name WHERE span_years >= 0.67e0 * 7),
    enc AS (SELECT checklist_id, species, site_id, hex_name, year, doy, count,
      CAST(dense_rank() OVER (PARTITION BY species ORDER BY site_id) AS INTEGER) AS site,
      CAST(dense_rank() OVER (PARTITION BY species ORDER BY hex_name) AS INTEGER) AS strat,
      CAST(year - min(year) OVER (PARTITION BY species) + 1 AS INTEGER) AS yr,
      CAST(doy - min(doy) OVER (PARTITION BY species) + 1 AS INTEGER) AS date,
      (max(year) OVER (PARTITION BY species) - min(year) OVER (PARTITION BY species) + 1) // 2 AS mid FROM k2)"""


def _kept_sql(body):
    return sql("zfh", "@@").replace("\n@@", f",\n{_KEPT}\n{body}")


@query(_kept_sql("""SELECT checklist_id, species, site, strat, yr, CAST(yr - mid AS INTEGER) AS yr_centred, date,
      CAST(count AS INTEGER) AS count FROM enc"""))
def index_encode(spark, sf):
    return _covered(spark, sf).select("checklist_id", "species", "site", "strat", "yr", "yr_centred", "date",
                                      "count")


@query(_kept_sql("""SELECT species, max(yr) AS nyears, max(strat) AS nstrata, max(site) AS nsites,
      count(*) AS ncounts, max(date) AS ndays, max(k) AS max_sites
    FROM (SELECT enc.*, k FROM enc JOIN (SELECT species, strat, count(DISTINCT site) AS k FROM enc GROUP BY 1, 2) s
          USING (species, strat)) GROUP BY 1"""))
def model_sizes(spark, sf):
    return coverage.model_sizes(_covered(spark, sf))


@query(_kept_sql("""SELECT species, strat, site,
      CAST(dense_rank() OVER (PARTITION BY species, strat ORDER BY site) AS INTEGER) AS slot,
      count(*) OVER (PARTITION BY species, strat) AS n_sites
    FROM (SELECT DISTINCT species, strat, site FROM enc)"""))
def sites_by_stratum(spark, sf):
    return coverage.sites_by_stratum(_covered(spark, sf)).select(
        "species", "strat", "site", "slot", "n_sites")


@query(sql("zf site_regions splist", """
    SELECT z.species, z.region, CASE WHEN two_seasons AND list_contains(
        string_split(coalesce(regions_w_alt_season, ''), ' - '), z.region) THEN 2 ELSE 1 END AS seas_strat
    FROM (SELECT DISTINCT species, region FROM zf JOIN site_regions ON site_id = locality_id) z
    JOIN splist ON splist.species = z.species"""))
def season_strata(spark, sf):
    # every listed species meets every region of a kept event: the grid over regions, not over events
    regions = zero_fill.kept_events(T.events_geo(spark, sf), T.counts(spark, sf)).select("region").distinct()
    none = spark.createDataFrame([], "region string, common_name string, observation_count int")
    strata = zero_fill.zero_fill(regions, none, T.species(spark, sf), key="region").select(
        F.col("common_name").alias("species"), "region")
    return coverage.season_strata(strata, T.species_list(spark, sf))


@query(sql("ev_geo", """SELECT region, count(*) AS n_sites, CAST(sum(n) AS BIGINT) AS n_surveys,
      round(quantile_cont(CAST(n AS DOUBLE), 0.95), 6) AS q95_surveys
    FROM (SELECT region, locality_id, count(DISTINCT checklist_id) AS n FROM ev_geo GROUP BY 1, 2) GROUP BY 1"""))
def survey_effort(spark, sf):
    return coverage.survey_effort(T.events_geo(spark, sf)).select(
        "region", "n_sites", "n_surveys", r6("q95_surveys"))


@query(sql("zf", """SELECT species, site_id, year, round(ln(avg(count) + 1), 6) AS log_mean
    FROM zf GROUP BY 1, 2, 3"""))
def site_year_means(spark, sf):
    return coverage.site_year_means(T.survey_values(spark, sf, ["site_id", "year"]), weight="n").select(
        "species", "site_id", "year", r6("log_mean"))


@query(sql("ev", """SELECT checklist_id, locality_id, year FROM (SELECT *, count(*) OVER (PARTITION BY year) AS n,
      row_number() OVER (PARTITION BY year ORDER BY CAST('0x' || substr(md5('1|' || checklist_id), 1, 13) AS BIGINT), checklist_id) AS rn
      FROM ev) WHERE rn <= floor(0.1e0 * n)"""))
def group_sample(spark, sf):
    return coverage.group_sample(T.events(spark, sf).select("checklist_id", "locality_id", "year"),
                                 ["year"], ["checklist_id"], 0.1, seed=1)


@query(sql("ev_geo", """SELECT region, year, CAST(floor(0.1e0 * count(*)) AS BIGINT) AS n
    FROM ev_geo GROUP BY 1, 2 HAVING floor(0.1e0 * count(*)) > 0"""))
def group_sample_sizes(spark, sf):
    ev = T.events_geo(spark, sf).select("checklist_id", "region", "year")
    return coverage.group_sample(ev, ["region", "year"], ["checklist_id"], 0.1).groupBy(
        "region", "year").agg(F.count(F.lit(1)).alias("n"))


@query(_kept_sql("""SELECT species, strat, site,
      CAST(dense_rank() OVER (PARTITION BY species, strat ORDER BY site) AS INTEGER) AS slot
    FROM (SELECT DISTINCT species, strat, site FROM enc)"""))
def unrolled_site_lists(spark, sf):
    """Zero-padded lists, as a model takes them, and back to one row per site."""
    sites = coverage.sites_by_stratum(_covered(spark, sf))
    lists = sites.groupBy("species", "strat").agg(F.sort_array(F.collect_list(F.struct("slot", "site"))).alias("l"))
    padded = lists.select("species", "strat", F.concat(F.col("l.site"), F.array(F.lit(0), F.lit(0))).alias("sites"))
    return coverage.unroll_sites(padded).select("species", "strat", "site", "slot")
