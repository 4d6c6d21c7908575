"""Registered queries: tables written in the formats of the inputs and read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import spatial
from ..session import ensure_checkpoint_dir
from ..sources import readers, schemas, writers
from . import testdata as T
from .registry import query
from .q_spatial import _CELLS, _with
from .testdata import sql


def _folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/scan-{uuid.uuid4().hex}"


def _as(df, schema):
    """All columns of a layout in its order; those ``df`` lacks are null."""
    names = [c.split()[0] for c in schema.split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast("string").alias(n) for n in names])


def _export(df, schema, path):
    _as(df, schema).write.option("header", True).option("sep", "\t").csv(path)
    return path


@query(sql("ev_geo", """SELECT CAST(checklist_id AS VARCHAR) AS checklist_id, group_id, state, observation_date,
      time_observations_started, protocol_type, round(duration_minutes, 6) AS duration_minutes,
      round(effort_distance_km, 6) AS effort_distance_km, all_species_reported FROM ev_geo"""))
def scan_events(spark, sf):
    """Tab-separated sampling-event export."""
    path = _export(T.events_geo(spark, sf), schemas.EVENTS, _folder(spark))
    ev = readers.read_events(spark, path)
    return ev.select("checklist_id", "group_id", "state", "observation_date", "time_observations_started",
                     "protocol_type", F.round("duration_minutes", 6).alias("duration_minutes"),
                     F.round("effort_distance_km", 6).alias("effort_distance_km"), "all_species_reported")


@query(sql("obs", """SELECT CAST(checklist_id AS VARCHAR) AS checklist_id, common_name, observation_count FROM obs"""))
def scan_observations(spark, sf):
    """Observation exports of two regions, appended."""
    obs, base = T.observations(spark, sf), _folder(spark)
    paths = [_export(obs.filter((F.col("checklist_id") % 2 == k)), schemas.OBSERVATIONS, f"{base}-{k}")
             for k in (0, 1)]
    both = readers.append_regions(*[readers.read_observations(spark, p) for p in paths])
    return both.select("checklist_id", "common_name", "observation_count")


@query(sql("cnt", """SELECT common_name AS species, checklist_id, line, observation_count AS count FROM cnt
    WHERE common_name IN (SELECT p_brand FROM part WHERE p_size = 7)"""))
def snapshot_by_species(spark, sf):
    """Table partitioned by species, one half replaced, then read for the available species only."""
    path = _folder(spark)
    df = T.counts(spark, sf).select(F.col("common_name").alias("species"), "checklist_id", "line",
                                    F.col("observation_count").alias("count"))
    even = T.brand_number("species") % 2 == 0
    writers.save_snapshot(df.withColumn("count", F.when(even, F.col("count")).otherwise(-1)), path)
    writers.save_snapshot(df.filter(~even), path)
    wanted = (T.table(spark, sf, "part").filter("p_size = 7")
              .select(F.col("p_brand").alias("species")).unionByName(
                  spark.createDataFrame([("no such species",)], "species string")))
    return readers.read_available(spark, path, wanted).select("species", "checklist_id", "line", "count")


@query(_with("site_hex", _CELLS, """SELECT DISTINCT hex_name AS poly_id, round(x, 3) AS x, round(y, 3) AS y
    FROM cells"""))
def scan_polygons(spark, sf):
    """Vertex table -> rings -> centroids."""
    grid, path = spatial.hex_grid(T.site_cells(spark, sf), T.HEX_WIDTH), _folder(spark)
    (grid.select(F.col("hex_name").alias("poly_id"), F.posexplode("ring").alias("seq", "p"))
     .select("poly_id", "seq", "p.x", "p.y").write.parquet(path))
    x, y = G.centroid(F.col("ring"))
    return readers.read_polygons(spark, path).select(
        "poly_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(sql("zf site_regions", """SELECT region, species, count(*) AS n, CAST(sum(count) AS BIGINT) AS total
    FROM zf JOIN site_regions ON site_id = locality_id GROUP BY 1, 2"""))
def split_sink(spark, sf):
    """Result table written as one CSV folder per region, read back whole."""
    path = _folder(spark)
    table = T.surveys(spark, sf, ("region",)).groupBy("region", "species").agg(
        F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"))
    writers.save_split(table, path, by="region")
    return readers.read_lookup(spark, path, "species string, n bigint, total bigint, region string").select(
        "region", "species", "n", "total")


@query("""SELECT p_brand AS species, max(CASE WHEN p_size % 5 <> 0 THEN p_size END) AS large_flocks,
      count(*) % 2 = 0 AS two_seasons, CASE WHEN count(*) % 3 <> 0 THEN 'A - B' END AS regions_w_alt_season
    FROM part GROUP BY 1""")
def scan_lookup(spark, sf):
    """Lookup table with NA for missing values."""
    path = _folder(spark)
    size = F.when(F.col("p_size") % 5 != 0, F.col("p_size"))
    n = F.count(F.lit(1))
    table = (T.table(spark, sf, "part").groupBy(F.col("p_brand").alias("species")).agg(
        F.max(size).alias("large_flocks"), F.lit(None).cast("int").alias("small_flocks"),
        (n % 2 == 0).alias("two_seasons"), F.when(n % 3 != 0, "A - B").alias("regions_w_alt_season")))
    writers.save_csv(table, path)
    return readers.read_lookup(spark, path, schemas.SPECIES).drop("small_flocks")
