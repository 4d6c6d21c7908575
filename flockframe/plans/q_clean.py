"""Registered queries: cleaning, joining, zero-filling, auditing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import clean, coverage, zero_fill as Z
from . import testdata as T
from .registry import query, r6
from .testdata import sql

DROPPED = ["NATION_3", "NATION_7", "NATION_11"]
_DROPPED_SQL = "('NATION_3', 'NATION_7', 'NATION_11')"


@query(sql("cnt", "SELECT checklist_id, common_name, line, observation_count FROM cnt"))
def clean_counts(spark, sf):
    return T.counts(spark, sf).select("checklist_id", "common_name", "line", "observation_count")


@query(sql("ev_geo", f"""SELECT checklist_id, locality_id, state FROM ev_geo
    WHERE state IS NULL OR state NOT IN {_DROPPED_SQL}"""))
def exclude_states(spark, sf):
    return clean.exclude_states(T.events_geo(spark, sf), DROPPED).select(
        "checklist_id", "locality_id", "state")


@query(sql("", """SELECT o_orderkey AS checklist_id, CAST(o_orderdate AS DATE) AS observation_date
    FROM orders WHERE month(o_orderdate) * 100 + day(o_orderdate) BETWEEN 501 AND 715"""))
def date_window(spark, sf):
    day = F.col("observation_date")
    return T.events(spark, sf).filter(C.in_season(day, (5, 1), (7, 15))).select("checklist_id", day)


@query(sql("ev", """SELECT checklist_id, round(CAST(split_part(time_observations_started, ':', 1) AS DOUBLE)
      + CAST(split_part(time_observations_started, ':', 2) AS DOUBLE) / 60
      + CAST(split_part(time_observations_started, ':', 3) AS DOUBLE) / 3600, 6) AS start_hour FROM ev"""))
def decimal_hours(spark, sf):
    return T.events(spark, sf).select(
        "checklist_id", r6(C.decimal_hours(F.col("time_observations_started")), "start_hour"))


@query(sql("ev_geo", """SELECT checklist_id, CAST(year AS INTEGER) AS year, doy AS day_of_year,
      round(CAST(split_part(time_observations_started, ':', 1) AS DOUBLE)
            + CAST(split_part(time_observations_started, ':', 2) AS DOUBLE) / 60, 6) AS start_hour,
      CASE WHEN state_code IN ('CA-NS', 'CA-PE', 'CA-NB', 'CA-NL') THEN 'ACSS'
           WHEN state_code = 'CA-ON' THEN 'OSS' WHEN country_code = 'US' THEN 'ISS'
           ELSE 'Canada_other' END AS program
    FROM ev_geo WHERE year BETWEEN 1996 AND 2000"""))
def classify_program(spark, sf):
    ev = clean.between_years(clean.add_event_columns(T.events_geo(spark, sf)), 1996, 2000)
    return ev.select("checklist_id", "year", "day_of_year", r6("start_hour"), "program")


_EFFORT = dict(protocols=["1-URGENT", "5-LOW"], season=((5, 1), (9, 30)), distance_km=(0.0, 0.5),
               minutes=(0.0, 60.0), complete=True)


@query(sql("ev obs", """SELECT obs.checklist_id, common_name, line, obs.observation_count FROM obs
    WHERE checklist_id IN (SELECT checklist_id FROM ev WHERE protocol_type IN ('1-URGENT', '5-LOW')
      AND month(observation_date) * 100 + day(observation_date) BETWEEN 501 AND 930
      AND coalesce(effort_distance_km, 0) BETWEEN 0 AND 0.5e0
      AND duration_minutes BETWEEN 0 AND 60 AND all_species_reported)"""))
def extract_checklists(spark, sf):
    _, obs = clean.extract_checklists(T.events(spark, sf), T.observations(spark, sf), **_EFFORT)
    return obs.select("checklist_id", "common_name", "line", "observation_count")


@query(sql("ev", """SELECT shared_id, checklist_id, locality_id FROM (
      SELECT *, row_number() OVER (PARTITION BY shared_id ORDER BY checklist_id) AS rn
      FROM (SELECT *, coalesce(group_id, CAST(checklist_id AS VARCHAR)) AS shared_id FROM ev)) WHERE rn = 1"""))
def collapse_shared(spark, sf):
    ev = T.events(spark, sf).select("checklist_id", "group_id", "locality_id")
    return clean.collapse_shared(ev).select("shared_id", "checklist_id", "locality_id")


@query(sql("ev cnt", """SELECT shared_id, common_name, checklist_id, observation_count FROM (
      SELECT *, row_number() OVER (PARTITION BY shared_id, common_name
                                   ORDER BY checklist_id, observation_count) AS rn
      FROM (SELECT coalesce(group_id, CAST(cnt.checklist_id AS VARCHAR)) AS shared_id, common_name,
                   cnt.checklist_id, observation_count
            FROM cnt JOIN ev USING (checklist_id))) WHERE rn = 1"""))
def collapse_shared_observations(spark, sf):
    obs = (T.counts(spark, sf).select("checklist_id", "common_name", "observation_count")
           .join(T.events(spark, sf).select("checklist_id", "group_id"), "checklist_id"))
    return clean.collapse_shared(obs, within=["common_name"]).select(
        "shared_id", "common_name", "checklist_id", "observation_count")


def _workbook(spark, sf):
    """Line items and orders in the layout of the second program's sheet."""
    k = F.col("o_orderkey")
    start = F.to_timestamp(F.concat_ws(" ", F.col("o_orderdate").cast("date").cast("string"), F.concat_ws(
        ":", F.lpad((k % 20).cast("string"), 2, "0"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("00"))))
    base = (T.table(spark, sf, "lineitem")
            .join(T.table(spark, sf, "orders"), F.col("l_orderkey") == k)
            .join(T.table(spark, sf, "part").select("p_partkey", "p_brand"),
                  F.col("l_partkey") == F.col("p_partkey"))
            .select(k.alias("survey_code"), F.col("o_custkey").alias("site_code"),
                    F.concat(F.lit("site "), F.col("o_custkey").cast("string")).alias("survey_site"),
                    F.col("p_brand").alias("species"),
                    F.when(F.col("l_linenumber") == 7, None).otherwise(
                        F.col("l_quantity").cast("string")).alias("ob_count"),
                    F.dayofmonth("o_orderdate").alias("day"), F.month("o_orderdate").alias("month"),
                    F.year("o_orderdate").alias("year"), start.alias("time_start"),
                    F.timestamp_add("MINUTE", (k % 90).cast("int"), start).alias("time_end"),
                    F.lit("NS").alias("province"),
                    F.concat(F.lit("surveyor "), F.col("l_suppkey").cast("string")).alias("surveyor"),
                    F.lit(45.0).alias("latitude"), F.lit(-63.0).alias("longitude")))
    codes = coverage.dense_codes(base, [], "surveyor", "observer_no")
    return base.join(codes, "surveyor", "left")


_HARMONISED_SQL = """
    SELECT CAST(o_orderkey AS VARCHAR) || '_' || CAST(o_custkey AS VARCHAR) || '_' || CAST(day(o_orderdate) AS VARCHAR)
             || '_' || CAST(month(o_orderdate) AS VARCHAR) || '_' || CAST(year(o_orderdate) AS VARCHAR)
             || '_' || CAST(o_orderkey % 20 AS VARCHAR) || '_' || CAST(o_orderkey % 60 AS VARCHAR)
             || '_OB_' || CAST(obs_no AS VARCHAR) AS checklist_id,
           o_custkey AS locality_id, CAST(o_orderdate AS DATE) AS observation_date, p_brand AS common_name,
           CAST(trunc(l_quantity) AS INTEGER) AS observation_count,
           CAST(o_orderkey % 20 AS VARCHAR) || 'H ' || CAST(o_orderkey % 60 AS VARCHAR) || 'M 0S' AS time_observations_started,
           'CA-NS' AS state_code, 'OB_' || CAST(obs_no AS VARCHAR) AS observer_id,
           CAST(o_orderkey % 90 AS DOUBLE) AS duration_minutes
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN (SELECT l_suppkey AS sk, dense_rank() OVER (ORDER BY 'surveyor ' || CAST(l_suppkey AS VARCHAR)) AS obs_no
          FROM (SELECT DISTINCT l_suppkey FROM lineitem)) ON l_suppkey = sk
    WHERE month(o_orderdate) BETWEEN 7 AND 11 AND l_linenumber <> 7"""


@query(_HARMONISED_SQL)
def harmonise_events(spark, sf):
    h = clean.harmonise_workbook(_workbook(spark, sf), country_code="CA", country="Canada",
                                 protocol="Area count")
    return h.select("checklist_id", "locality_id", "observation_date", "common_name", "observation_count",
                    "time_observations_started", "state_code", "observer_id", "duration_minutes")


@query(f"""SELECT checklist_id, locality_id, observation_date, observer_id, duration_minutes
    FROM ({_HARMONISED_SQL}) GROUP BY ALL""")
def split_event_rows(spark, sf):
    h = clean.harmonise_workbook(_workbook(spark, sf), country_code="CA", country="Canada",
                                 protocol="Area count")
    events, _ = clean.split_events(h, ["locality_id", "observation_date", "observer_id", "duration_minutes"])
    return events


@query(sql("ev_geo", f"""
    SELECT checklist_id, locality_id, state, region FROM ev_geo
    WHERE checklist_id % 2 = 0 AND (state IS NULL OR state NOT IN {_DROPPED_SQL})
    UNION ALL SELECT checklist_id, locality_id, NULL, region FROM ev_geo WHERE checklist_id % 2 = 1"""))
def union_programs(spark, sf):
    ev = T.events_geo(spark, sf).select("checklist_id", "locality_id", "state", "region")
    second = ev.filter(F.col("checklist_id") % 2 == 1).drop("state")
    return clean.replace_slice(ev.filter(F.col("checklist_id") % 2 == 0), second, DROPPED)


@query(sql("good", "SELECT checklist_id, common_name, observation_count FROM good"))
def drop_conflicting(spark, sf):
    obs = T.counts(spark, sf).select("checklist_id", "common_name", "observation_count")
    return clean.drop_conflicting(T.events(spark, sf), obs)[1]


@query(sql("zf", "SELECT checklist_id, site_id, year, doy, species, CAST(count AS INTEGER) AS count FROM zf"))
def zero_fill(spark, sf):
    return T.surveys(spark, sf)


@query(sql("ev cnt sp", """
    SELECT ev.checklist_id, sp.common_name, coalesce(d.observation_count, 0) AS observation_count
    FROM ev CROSS JOIN sp LEFT JOIN (SELECT DISTINCT checklist_id, common_name, observation_count FROM cnt) d
      ON d.checklist_id = ev.checklist_id AND d.common_name = sp.common_name"""))
def zero_fill_with_conflicts(spark, sf):
    return Z.zero_fill(T.events(spark, sf).select("checklist_id"), T.counts(spark, sf),
                       T.species(spark, sf), drop_conflicts=False)


@query(sql("zf", """SELECT site_id, year, species AS common_name, CAST(sum(count) AS BIGINT) AS total, count(*) AS n
    FROM zf GROUP BY ALL"""))
def grid_sums(spark, sf):
    """Sums over the zero-filled grid without building it."""
    ev = T.events(spark, sf).select("checklist_id", F.col("locality_id").alias("site_id"), "year")
    return Z.grid_sums(ev, T.counts(spark, sf), T.species(spark, sf), ["site_id", "year"])


@query(sql("site_regions sites", """
    SELECT o_orderkey AS checklist_id, o_custkey AS locality_id, s.locality AS locality,
           round(latitude, 6) AS latitude, round(longitude, 6) AS longitude
    FROM orders JOIN sites s ON s.locality_id = o_custkey
    JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0"""))
def canonical_site_join(spark, sf):
    ev = T.events(spark, sf).select("checklist_id", "locality_id", F.lit("as reported").alias("locality"))
    solvent = T.table(spark, sf, "customer").filter("c_acctbal >= 0").select(
        F.col("c_custkey").alias("locality_id"))
    listed = T.sites(spark, sf).join(solvent, "locality_id", "left_semi")
    return clean.canonical_sites(ev, listed).select(
        "checklist_id", "locality_id", "locality", r6("latitude"), r6("longitude"))


@query(sql("ev_geo", """
    SELECT locality_id, state, protocol_type FROM (
      SELECT *, row_number() OVER (PARTITION BY locality_id
                  ORDER BY observation_date DESC, checklist_id DESC) AS rn
      FROM ev_geo WHERE state IS NOT NULL AND protocol_type IS NOT NULL) WHERE rn = 1"""))
def latest_site_record(spark, sf):
    return clean.latest_complete(T.events_geo(spark, sf), ["locality_id"], "observation_date",
                                 ["state", "protocol_type"], tie_break=["checklist_id"])


@query(sql("ev_geo", """SELECT locality_id, count(*) - 1 AS n_duplicates
    FROM (SELECT DISTINCT locality_id, state, protocol_type FROM ev_geo) GROUP BY 1"""))
def duplicate_audit(spark, sf):
    return clean.duplicate_counts(T.events_geo(spark, sf), "locality_id", ["state", "protocol_type"])


@query(sql("cnt", "SELECT DISTINCT checklist_id, common_name, observation_count FROM cnt"))
def duplicate_combos(spark, sf):
    return clean.duplicate_combos(T.counts(spark, sf), "checklist_id",
                                  ["common_name", "observation_count"])


@query(sql("sp", """SELECT common_name FROM sp
    WHERE common_name NOT IN (SELECT DISTINCT CASE p_brand WHEN 'Brand#1' THEN 'Brand#2' ELSE p_brand END
                              FROM part WHERE p_size > 25 AND p_brand NOT IN ('Brand#2', 'Brand#3'))"""))
def unmatched_names(spark, sf):
    known = (T.table(spark, sf, "part")
             .filter((F.col("p_size") > 25) & ~F.col("p_brand").isin("Brand#2", "Brand#3"))
             .select(F.col("p_brand").alias("common_name")).distinct())
    fixes = spark.createDataFrame([("Brand#1", "Brand#2")], "from string, to string")
    return clean.unmatched_names(T.species(spark, sf), known, "common_name", fixes)


@query(sql("ev", """SELECT year, count(*) AS n,
    round(count(duration_minutes) / count(*), 6) AS share FROM ev GROUP BY 1"""))
def effort_share(spark, sf):
    df = clean.share_where(T.events(spark, sf), ["year"], F.col("duration_minutes").isNotNull())
    return df.select("year", "n", r6("share"))


@query(sql("ev cnt", """SELECT CAST(coalesce(t, 0) AS BIGINT) AS total_birds, count(*) AS n_checklists
    FROM ev LEFT JOIN (SELECT checklist_id, sum(observation_count) AS t FROM cnt GROUP BY 1) USING (checklist_id)
    GROUP BY 1"""))
def zero_bird_surveys(spark, sf):
    return coverage.zero_bird_surveys(T.events(spark, sf), T.counts(spark, sf))


@query(sql("ev_geo", """SELECT program, year, count(*) AS n FROM (
      SELECT year, CASE WHEN state_code IN ('CA-NS', 'CA-PE', 'CA-NB', 'CA-NL') THEN 'ACSS'
           WHEN state_code = 'CA-ON' THEN 'OSS' WHEN country_code = 'US' THEN 'ISS'
           ELSE 'Canada_other' END AS program FROM ev_geo) GROUP BY 1, 2"""))
def checklists_by_program(spark, sf):
    ev = clean.add_event_columns(T.events_geo(spark, sf))
    return ev.groupBy("program", "year").agg(F.count(F.lit(1)).alias("n"))


@query(sql("", """SELECT p_name, replace(replace(p_name, ' ', '_'), '''', '') AS slug,
      p_brand || '_' || coalesce(CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS VARCHAR) END, 'NA') AS key
    FROM part"""))
def name_keys(spark, sf):
    size = F.when(F.col("p_size") % 5 != 0, F.col("p_size"))
    return T.table(spark, sf, "part").select(
        "p_name", C.name_slug(F.col("p_name")).alias("slug"),
        C.composite_key(F.col("p_brand"), size).alias("key"))
