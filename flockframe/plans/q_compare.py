"""Registered queries: dataset and trend version comparisons, draws beside old results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, trends
from . import testdata as T
from .q_spatial import _with
from .q_trends import _NUM, _RATES, _periods
from .registry import query, rounded
from .testdata import sql


def _records(spark, sf):
    return (T.counts(spark, sf)
            .join(T.events_geo(spark, sf).select("checklist_id", "locality_id", "year", "doy", "region"),
                  "checklist_id")
            .join(T.sites(spark, sf).select("locality_id", "latitude", "longitude"), "locality_id")
            .select("checklist_id", "line", F.col("common_name").alias("species"), "year", "doy", "region",
                    F.round("latitude", 2).alias("lat"), F.round("longitude", 2).alias("lon"),
                    F.col("observation_count").alias("count")))


def _later(count):
    return count + F.when(F.col("checklist_id") % 11 == 0, 1).otherwise(0)


def _both(spark, sf):
    """Old version: all counts. New version: line 3 missing, some counts one higher. Stacked, from one reading of the records."""
    return compare.tag_versions(_records(spark, sf), {
        "v_old": (F.lit(True), F.col("count")), "v_new": (F.col("line") != 3, _later(F.col("count")))})


_V = """old AS (SELECT checklist_id, line, common_name AS species, year, doy, region, round(latitude, 2) AS lat,
      round(longitude, 2) AS lon, observation_count AS count
      FROM cnt JOIN ev_geo USING (checklist_id) JOIN sites USING (locality_id)),
    new AS (SELECT * REPLACE (count + CASE WHEN checklist_id % 11 = 0 THEN 1 ELSE 0 END AS count) FROM old WHERE line <> 3),
    both_v AS (SELECT *, 'v_old' AS version FROM old UNION ALL SELECT *, 'v_new' FROM new)"""
_NEED = "cnt ev_geo sites"


@query(_with(_NEED, _V, """SELECT version, year, reg AS region, species, count(*) AS n_counts,
      round(avg(count), 6) AS mean_count, max(count) AS max_count,
      round(quantile_cont(CAST(count AS DOUBLE), 0.95), 6) AS quantile_95_count
    FROM (SELECT *, CASE WHEN region IN ('ASIA', 'EUROPE') THEN region ELSE 'ISS' END AS reg FROM both_v)
    GROUP BY ALL"""))
def annual_counts(spark, sf):
    both = _both(spark, sf).withColumn(
        "region", compare.collapse_regions(F.col("region"), ["ASIA", "EUROPE"], "ISS"))
    return rounded(compare.annual_counts(both, ["version", "year", "region", "species"]),
                   "mean_count", "quantile_95_count")


@query(_with(_NEED, _V + """,
    o AS (SELECT year, lat, lon, doy, species, count AS count_old, count(*) AS n_old FROM old GROUP BY ALL),
    n AS (SELECT year, lat, lon, doy, species, count AS count_new, count(*) AS n_new FROM new GROUP BY ALL)""", """
    SELECT year, lat, lon, doy, species, count_old, n_old, count_new, n_new, count_new - count_old AS dif_count,
      CASE WHEN count_new - count_old IS NULL THEN 'missing' WHEN count_new <> count_old THEN 'changed'
           ELSE 'same' END AS status
    FROM o FULL JOIN n USING (year, lat, lon, doy, species)"""))
def version_diff(spark, sf):
    return compare.version_diff(_both(spark, sf), ["year", "lat", "lon", "doy", "species"])


@query(_with(_NEED, _V, """SELECT year, lat, lon, doy, species, count(DISTINCT version) AS n_vers,
      round(stddev_samp(count), 6) AS sd_count FROM both_v GROUP BY ALL HAVING count(DISTINCT version) > 1"""))
def cross_version_matches(spark, sf):
    return rounded(compare.cross_version_matches(_both(spark, sf), ["year", "lat", "lon", "doy", "species"]), "sd_count")


@query(_with(_NEED, _V, """SELECT a.checklist_id, a.line, a.species, a.count, b.count AS count_2024
    FROM old a JOIN new b ON a.checklist_id = b.checklist_id AND a.line = b.line AND a.species = b.species"""))
def old_with_new(spark, sf):
    old = _records(spark, sf)
    new = old.filter("line <> 3").withColumn("count", _later(F.col("count")))
    renamed = new.select(*[F.col(c).alias(c + "_2024") for c in ("checklist_id", "line", "species", "count")])
    return compare.old_with_new(old.select("checklist_id", "line", "species", "count"), renamed, {
        "checklist_id": "checklist_id_2024", "line": "line_2024", "species": "species_2024"})


@query(_with(_NEED, _V, """SELECT region, version, lat, lon, count(DISTINCT year) AS n_years FROM both_v
    GROUP BY ALL HAVING count(DISTINCT year) > 4"""))
def long_sites(spark, sf):
    old = _records(spark, sf)
    both = compare.stack_versions({"v_old": old, "v_new": old.filter("line <> 3")})
    return compare.long_sites(both, ["region", "version", "lat", "lon"], 4)


@query(_with("dsv periods", f"""
    ends AS (SELECT p.species, trend_type, start_year, end_year, draw,
        sum(CASE WHEN year = start_year THEN value END) AS a, sum(CASE WHEN year = end_year THEN value END) AS b
      FROM dsv d JOIN periods p ON p.species = d.species GROUP BY ALL),
    rates AS (SELECT species, trend_type, start_year, end_year, {_RATES}
      FROM (SELECT *, ((b / a) ** (1e0 / (end_year - start_year)) - 1) * 100 AS t, (b / a - 1) * 100 AS ch FROM ends)
      GROUP BY ALL)""", """
    SELECT species, start_year, end_year, trend, lci, uci, v.version, v.model, v.version || '-' || CAST(end_year AS VARCHAR) AS version_2
    FROM rates JOIN (VALUES ('published', 'Poisson'), ('published', 'negative-binomial'), ('updated', 'Poisson')) v(version, model)
      ON true WHERE trend_type = 'Long-term'"""))
def trend_versions(spark, sf):
    out = trends.trend_endpoint(T.survey_draws(spark, sf), _periods(spark, sf))
    t = rounded(out, *_NUM).select("species", "trend_type", "start_year", "end_year", "trend", "lci", "uci")
    return compare.trend_versions([(t, "published", "Poisson"), (t, "published", "negative-binomial"),
                                   (t, "updated", "Poisson")]).drop("trend_type")


@query(sql("ev_geo site_regions", """SELECT e.checklist_id, e.region, e.state, n_region
    FROM (SELECT checklist_id, region, state FROM ev_geo) e
    LEFT JOIN (SELECT region, state, count(*) AS n_region FROM ev_geo GROUP BY ALL) s
      ON s.region IS NOT DISTINCT FROM e.region AND s.state IS NOT DISTINCT FROM e.state"""))
def natural_join(spark, sf):
    """Shared columns are the keys; an unknown state matches an unknown state."""
    from ..operators.clean import natural_join as join

    ev = T.events_geo(spark, sf).select("checklist_id", "region", "state")
    return join(ev, ev.groupBy("region", "state").agg(F.count(F.lit(1)).alias("n_region")))
