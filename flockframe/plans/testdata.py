"""Survey-shaped views of the generic test tables, in Spark and as SQL fragments.

Orders stand for checklists, line items for species counts, customers for sites,
brands for species and embedding components for draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import clean, spatial
from ..operators import zero_fill as zf
from ..operators.zero_fill import zero_fill

HEX_WIDTH = 300_000.0
FIRST_YEAR, LAST_YEAR = 1995, 2001
DRAW_YEAR0 = 1960  # draws cover 1961-2024


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sites(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("locality_id"), F.col("c_name").alias("locality"),
        (F.lit(25.0) + ((F.col("c_custkey") * 37) % 3000) / F.lit(100.0)).alias("latitude"),
        (F.lit(-130.0) + ((F.col("c_custkey") * 53) % 7000) / F.lit(100.0)).alias("longitude"))


def site_regions(spark, sf):
    return (table(spark, sf, "customer")
            .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("c_custkey").alias("locality_id"), F.col("r_name").alias("region"),
                    F.col("n_name"), F.col("n_nationkey")))


def events(spark, sf):
    """Checklists without geography: orders alone."""
    k = F.col("o_orderkey")

    def two(c):
        return F.lpad(c.cast("string"), 2, "0")

    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        k.alias("checklist_id"), F.col("o_custkey").alias("locality_id"),
        F.when(k % 5 == 0, F.concat(F.lit("G"), F.floor(k / 10).cast("string"))).alias("group_id"),
        day.alias("observation_date"), F.col("o_orderpriority").alias("protocol_type"),
        F.when(k % 7 != 0, F.col("o_totalprice") % 120).alias("duration_minutes"),
        F.when(k % 3 != 0, (k % 11) / F.lit(10.0)).alias("effort_distance_km"),
        (k % 9 != 0).alias("all_species_reported"),
        F.concat_ws(":", two(k % 24), two(k % 60), F.lit("00")).alias("time_observations_started"),
        F.year(day).alias("year"), F.dayofyear(day).alias("doy"))


def events_geo(spark, sf):
    """Checklists with state, country and region of their site."""
    n = F.col("n_nationkey")
    codes = F.array(*[F.lit(c) for c in ("ON", "NS", "PE", "NB", "NL", "AB", "BC", "QC")])
    country = F.when(n % 3 == 0, "US").otherwise("CA")
    return (events(spark, sf).join(site_regions(spark, sf), "locality_id")
            .withColumn("state", F.when(F.col("checklist_id") % 17 != 0, F.col("n_name")))
            .withColumn("country_code", country)
            .withColumn("state_code", F.concat(country, F.lit("-"), F.get(codes, (n % 8).cast("int"))))
            .drop("n_name", "n_nationkey"))


def observations(spark, sf):
    """Species counts as text, some of them the non-numeric X."""
    odd = (F.col("l_orderkey") + F.col("l_linenumber")) % 13 == 0
    return (table(spark, sf, "lineitem")
            .join(table(spark, sf, "part").select("p_partkey", "p_brand"),
                  F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_orderkey").alias("checklist_id"), F.col("p_brand").alias("common_name"),
                    F.when(odd, "X").otherwise(F.col("l_quantity").cast("string")).alias("observation_count"),
                    F.col("l_linenumber").alias("line")))


def counts(spark, sf):
    return clean.clean_counts(observations(spark, sf))


def species(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("common_name")).distinct()


def brand_number(c="common_name"):
    return F.regexp_extract(c, "([0-9]+)", 1).cast("int")


def species_list(spark, sf):
    n = brand_number()
    return species(spark, sf).select(
        F.col("common_name").alias("species"), (n % 2 == 0).alias("two_seasons"),
        F.when(n % 4 == 0, "ASIA - EUROPE").when(n % 4 == 2, "AFRICA").alias("regions_w_alt_season"))


def generations(spark, sf):
    return species(spark, sf).select(F.col("common_name").alias("species"),
                                     (brand_number() / 2.0).alias("gen_length"))


def surveys(spark, sf, extra: tuple[str, ...] = ()):
    """Zero-filled grid: checklist_id, site_id, year, doy [, extra], species, count."""
    base = events_geo(spark, sf) if extra else events(spark, sf)
    ev = base.select("checklist_id", F.col("locality_id").alias("site_id"), "year", "doy", *extra)
    grid = zero_fill(ev, counts(spark, sf), species(spark, sf))
    return grid.withColumnsRenamed({"common_name": "species", "observation_count": "count"})


def _named(rows):
    return rows.withColumnsRenamed({"common_name": "species", "observation_count": "count"})


def reported(spark, sf, extra: tuple[str, ...] = ()):
    """The grid's reported rows: checklist_id, site_id, year, doy [, extra], species, count."""
    base = events_geo(spark, sf) if extra else events(spark, sf)
    ev = base.select("checklist_id", F.col("locality_id").alias("site_id"), "year", "doy", *extra)
    return _named(zf.reported(ev, counts(spark, sf), species(spark, sf)))


def reported_hex(spark, sf, extra: tuple[str, ...] = ()):
    """The same with the cell of the site."""
    cells = site_cells(spark, sf).select(F.col("locality_id").alias("site_id"), "hex_name")
    return reported(spark, sf, extra).join(cells, "site_id")


def survey_values(spark, sf, by: list[str]):
    """The grid as frequencies: by, species, count, n."""
    ev = events(spark, sf).withColumn("site_id", F.col("locality_id"))
    return _named(zf.grid_values(ev, counts(spark, sf), species(spark, sf), by))


def hex_events(spark, sf):
    """Events that the grid by cell is made of, not unfolded."""
    cells = site_cells(spark, sf).select("locality_id", "hex_name")
    return events(spark, sf).join(cells, "locality_id").select(
        "checklist_id", F.col("locality_id").alias("site_id"), "hex_name", "year", "doy")


def site_cells(spark, sf):
    return spatial.hex_assign(spatial.project_laea(sites(spark, sf)), HEX_WIDTH)


def surveys_hex(spark, sf, extra: tuple[str, ...] = ()):
    """Grid with the cell of the site, joined before unfolding."""
    base = events_geo(spark, sf) if extra else events(spark, sf)
    cells = site_cells(spark, sf).select("locality_id", "hex_name")
    ev = base.join(cells, "locality_id").select(
        "checklist_id", F.col("locality_id").alias("site_id"), "hex_name", "year", "doy", *extra)
    grid = zero_fill(ev, counts(spark, sf), species(spark, sf))
    return grid.withColumnsRenamed({"common_name": "species", "observation_count": "count"})


# four region rectangles in equal-area metres (fixed values)
REGIONS = {"East": (900_000.0, -1_500_000.0, 2_600_000.0, 200_000.0),
           "North": (-500_000.0, 700_000.0, 1_500_000.0, 1_600_000.0),
           "South": (-900_000.0, -1_700_000.0, 500_000.0, -300_000.0),
           "West": (-2_600_000.0, -1_200_000.0, -1_300_000.0, 1_100_000.0)}


def regions(spark):
    rows = [(n, [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]) for n, (x0, y0, x1, y1) in REGIONS.items()]
    return spark.createDataFrame(rows, "poly_id string, ring array<struct<x:double,y:double>>")


# --- draws --------------------------------------------------------------------


def _vec(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e")).select(
        "vec_id", "pos", F.col("e").cast("double").alias("e"))


def survey_draws(spark, sf):
    v = F.col("vec_id")
    return _vec(spark, sf).select(
        F.concat(F.lit("S"), (v % 2).cast("string")).alias("species"),
        F.floor(v / 2).alias("draw"), (F.col("pos") + 1 + DRAW_YEAR0).alias("year"),
        (F.col("pos") + 1).alias("y"), F.exp("e").alias("value"))


def _stratum_keys():
    v = F.col("vec_id")
    draw = F.floor(v / 10)
    return [F.concat(F.lit("S"), (v % 2).cast("string")).alias("species"),
            (F.floor(v / 2) % 5 + 1).cast("int").alias("strat"), draw.alias("draw"),
            (draw % 4).cast("int").alias("chain"), F.floor(draw / 4).cast("int").alias("iteration")]


def stratum_draws(spark, sf):
    return _vec(spark, sf).select(*_stratum_keys(), (F.col("pos") + 1).alias("y"),
                                  (F.col("pos") + 1 + DRAW_YEAR0).alias("year"),
                                  F.exp("e").alias("value")).withColumn(
        "region", F.concat(F.lit("R"), F.col("strat").cast("string")))


def log_draws(spark, sf):
    """Stratum draws on the log scale, exactly as stored."""
    return _vec(spark, sf).select(*_stratum_keys(), (F.col("pos") + 1).alias("y"), F.col("e").alias("value"))


def param_draws(spark, sf):
    """Parameter slices of the draw vectors: dict of draw tables."""
    p = _vec(spark, sf).select(*_stratum_keys(), "pos", F.col("e").alias("value"))
    first = p.filter(F.col("strat") == 1)

    def part(df, lo, hi, dim):
        return df.filter(F.col("pos").between(lo, hi)).withColumn(dim, F.col("pos") - lo + 1)

    scalars = (table(spark, sf, "embeddings").select(*_stratum_keys(), "embedding")
               .filter(F.col("strat") == 1)
               .select("species", "draw", *[
                   (F.abs(c) if n != "ALPHA1" else c).alias(n) for n, c in (
                       (n, F.get("embedding", F.lit(i)).cast("double"))
                       for n, i in (("ALPHA1", 60), ("sdyear", 61), ("sdalpha", 62), ("sdnoise", 63)))]))
    alpha = part(p, 16, 47, "__s").withColumn("site", ((F.col("strat") - 1) * 32 + F.col("__s")).cast("int"))
    return {
        "year_pred": part(p, 0, 6, "yr").select("species", "strat", "draw", "yr", "value"),
        "Y_pred": part(first, 0, 6, "yr").select("species", "draw", "yr", "value"),
        "season": part(first, 8, 15, "day").select("species", "draw", "day", "value"),
        "alpha": alpha.select("species", "draw", "site", "value"),
        "site_strata": alpha.select("species", "strat", "site").distinct(),
        "year_effect": part(first, 48, 54, "yr").select("species", "draw", "yr", "value"),
        "scalars": scalars,
        "b": part(p, 56, 59, "knot").select("species", "strat", "draw", "knot", "value"),
        "B": part(first, 56, 59, "knot").select("species", "draw", "knot", "value"),
    }


def model_rows(spark, sf):
    """Counts coded for the parameter draws: species, strat, site, yr, date, count."""
    cust = F.col("o_custkey")
    return (table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
            .join(table(spark, sf, "part").select("p_partkey", "p_brand"),
                  F.col("l_partkey") == F.col("p_partkey"))
            .join(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"),
                  F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.concat(F.lit("S"), (brand_number("p_brand") % 2).cast("string")).alias("species"),
                    (cust % 5 + 1).cast("int").alias("strat"),
                    ((cust % 5) * 32 + F.floor(cust / 5) % 32 + 1).cast("int").alias("site"),
                    (F.year("o_orderdate") - 1994).alias("yr"),
                    F.year("o_orderdate").alias("year"),
                    (F.dayofyear("o_orderdate") % 8 + 1).alias("date"),
                    F.col("l_quantity").cast("int").alias("count")))


def draw_generations(spark, sf):
    """Generation length of the two draw species."""
    g = table(spark, sf, "embeddings").select((F.col("vec_id") % 2).alias("k")).distinct()
    return g.select(F.concat(F.lit("S"), F.col("k").cast("string")).alias("species"),
                    F.when(F.col("k") == 0, 2.0).otherwise(6.5).alias("gen_length"))


def draw_observed(spark, sf):
    """Observed counts under the species, regions and years of the draws."""
    return model_rows(spark, sf).select(
        "species", F.concat(F.lit("R"), F.col("strat").cast("string")).alias("region"),
        (F.col("year") + 23).alias("year"), "count")


# --- SQL fragments ------------------------------------------------------------

_HEX_S = "(300000e0 / sqrt(3e0))"

FRAGMENTS: dict[str, tuple[str, str]] = {
    # name: (names it needs, body)
    "sites": ("", """
        SELECT c_custkey AS locality_id, c_name AS locality,
               25e0 + ((c_custkey * 37) % 3000) / 100e0 AS latitude,
               -130e0 + ((c_custkey * 53) % 7000) / 100e0 AS longitude FROM customer"""),
    "site_regions": ("", """
        SELECT c_custkey AS locality_id, r_name AS region, n_name, n_nationkey
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""),
    "ev": ("", """
        SELECT o_orderkey AS checklist_id, o_custkey AS locality_id,
               CASE WHEN o_orderkey % 5 = 0 THEN 'G' || CAST(o_orderkey // 10 AS VARCHAR) END AS group_id,
               CAST(o_orderdate AS DATE) AS observation_date, o_orderpriority AS protocol_type,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice % 120e0 END AS duration_minutes,
               CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 11) / 10e0 END AS effort_distance_km,
               o_orderkey % 9 <> 0 AS all_species_reported,
               lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':'
                 || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':00' AS time_observations_started,
               CAST(year(o_orderdate) AS INTEGER) AS year, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy
        FROM orders"""),
    "ev_geo": ("ev site_regions", """
        SELECT ev.*, region, CASE WHEN checklist_id % 17 <> 0 THEN n_name END AS state,
               CASE WHEN n_nationkey % 3 = 0 THEN 'US' ELSE 'CA' END AS country_code,
               (CASE WHEN n_nationkey % 3 = 0 THEN 'US' ELSE 'CA' END) || '-'
                 || substr('ONNSPENBNLABBCQC', 1 + 2 * (n_nationkey % 8), 2) AS state_code
        FROM ev JOIN site_regions USING (locality_id)"""),
    "obs": ("", """
        SELECT l_orderkey AS checklist_id, p_brand AS common_name,
               CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN 'X'
                    ELSE CAST(l_quantity AS VARCHAR) END AS observation_count, l_linenumber AS line
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "cnt": ("obs", """
        SELECT checklist_id, common_name, line,
               CAST(trunc(TRY_CAST(observation_count AS DOUBLE)) AS INTEGER) AS observation_count
        FROM obs WHERE TRY_CAST(observation_count AS DOUBLE) IS NOT NULL"""),
    "bad": ("cnt", """
        SELECT DISTINCT checklist_id FROM (
          SELECT checklist_id, common_name FROM cnt GROUP BY 1, 2
          HAVING count(DISTINCT observation_count) > 1)"""),
    "good": ("cnt bad", """
        SELECT DISTINCT checklist_id, common_name, observation_count FROM cnt
        WHERE checklist_id NOT IN (SELECT checklist_id FROM bad)"""),
    "sp": ("", "SELECT DISTINCT p_brand AS common_name FROM part"),
    "splist": ("sp", r"""
        SELECT common_name AS species, n % 2 = 0 AS two_seasons,
               CASE WHEN n % 4 = 0 THEN 'ASIA - EUROPE' WHEN n % 4 = 2 THEN 'AFRICA' END AS regions_w_alt_season
        FROM (SELECT common_name, CAST(regexp_extract(common_name, '([0-9]+)', 1) AS INTEGER) AS n FROM sp)"""),
    "zf": ("ev good bad sp", """
        SELECT ev.checklist_id, ev.locality_id AS site_id, ev.year, ev.doy, sp.common_name AS species,
               coalesce(good.observation_count, 0) AS count
        FROM ev CROSS JOIN sp
        LEFT JOIN good ON good.checklist_id = ev.checklist_id AND good.common_name = sp.common_name
        WHERE ev.checklist_id NOT IN (SELECT checklist_id FROM bad)"""),
    "geo_c": ("", """
        SELECT a, e, qp, b1, a * sqrt(qp / 2) AS rq,
               a * (cos(p1) / sqrt(1 - (e * sin(p1)) ** 2)) / (a * sqrt(qp / 2) * cos(b1)) AS d
        FROM (SELECT *, asin(((1 - e * e) * (sin(p1) / (1 - (e * sin(p1)) ** 2)
                     - ln((1 - e * sin(p1)) / (1 + e * sin(p1))) / (2 * e))) / qp) AS b1
              FROM (SELECT *, (1 - e * e) * (1 / (1 - e * e) - ln((1 - e) / (1 + e)) / (2 * e)) AS qp
                    FROM (SELECT 6378137e0 AS a, radians(40e0) AS p1,
                                 sqrt((1e0 / 298.257223563e0) * (2 - 1e0 / 298.257223563e0)) AS e)))"""),
    "site_xy": ("sites geo_c", """
        SELECT locality_id, locality, latitude, longitude,
               rq * sqrt(2 / (1 + sin(b1) * sin(b) + cos(b1) * cos(b) * cos(l))) * d * cos(b) * sin(l) AS x,
               rq * sqrt(2 / (1 + sin(b1) * sin(b) + cos(b1) * cos(b) * cos(l))) / d
                 * (cos(b1) * sin(b) - sin(b1) * cos(b) * cos(l)) AS y
        FROM (SELECT *, asin(((1 - e * e) * (sin(p) / (1 - (e * sin(p)) ** 2)
                   - ln((1 - e * sin(p)) / (1 + e * sin(p))) / (2 * e))) / qp) AS b
              FROM (SELECT sites.*, geo_c.*, radians(latitude) AS p, radians(longitude + 95e0) AS l
                    FROM sites CROSS JOIN geo_c))"""),
    "site_hex": ("site_xy", f"""
        SELECT locality_id, locality, latitude, longitude, x, y, q, r,
               CAST(q AS VARCHAR) || '_' || CAST(r AS VARCHAR) AS hex_name
        FROM (SELECT *, CAST(CASE WHEN dq > dr AND dq > dt THEN -rr - rt ELSE rq END AS BIGINT) AS q,
                     CAST(CASE WHEN NOT (dq > dr AND dq > dt) AND dr > dt THEN -rq - rt ELSE rr END AS BIGINT) AS r
              FROM (SELECT *, abs(rq - fq) AS dq, abs(rr - fr) AS dr, abs(rt - ft) AS dt
                    FROM (SELECT *, floor(fq + 0.5e0) AS rq, floor(fr + 0.5e0) AS rr, floor(ft + 0.5e0) AS rt
                          FROM (SELECT *, -fq - fr AS ft
                                FROM (SELECT *, (x * (sqrt(3e0) / 3) - y / 3) / {_HEX_S} AS fq,
                                             y * (2e0 / 3) / {_HEX_S} AS fr FROM site_xy)))))"""),
    "zfh": ("zf site_hex", """
        SELECT zf.*, hex_name FROM zf JOIN site_hex ON zf.site_id = site_hex.locality_id"""),
    "vec": ("", """
        SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS pos,
               CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings"""),
    "dsv": ("vec", """
        SELECT 'S' || CAST(vec_id % 2 AS VARCHAR) AS species, vec_id // 2 AS draw,
               CAST(pos + 1961 AS INTEGER) AS year, CAST(pos + 1 AS INTEGER) AS y, exp(e) AS value FROM vec"""),
    "dkey": ("vec", """
        SELECT 'S' || CAST(vec_id % 2 AS VARCHAR) AS species, CAST((vec_id // 2) % 5 + 1 AS INTEGER) AS strat,
               vec_id // 10 AS draw, CAST((vec_id // 10) % 4 AS INTEGER) AS chain,
               CAST((vec_id // 10) // 4 AS INTEGER) AS iteration, pos, e FROM vec"""),
    "dst": ("dkey", """
        SELECT species, strat, draw, chain, iteration, CAST(pos + 1 AS INTEGER) AS y,
               CAST(pos + 1961 AS INTEGER) AS year, exp(e) AS value,
               'R' || CAST(strat AS VARCHAR) AS region FROM dkey"""),
    "p_year": ("dkey", """SELECT species, strat, draw, CAST(pos + 1 AS INTEGER) AS yr, e AS value
        FROM dkey WHERE pos BETWEEN 0 AND 6"""),
    "p_Y": ("dkey", """SELECT species, draw, CAST(pos + 1 AS INTEGER) AS yr, e AS value
        FROM dkey WHERE strat = 1 AND pos BETWEEN 0 AND 6"""),
    "p_season": ("dkey", """SELECT species, draw, CAST(pos - 7 AS INTEGER) AS day, e AS value
        FROM dkey WHERE strat = 1 AND pos BETWEEN 8 AND 15"""),
    "p_alpha": ("dkey", """SELECT species, strat, draw, CAST((strat - 1) * 32 + pos - 15 AS INTEGER) AS site, e AS value
        FROM dkey WHERE pos BETWEEN 16 AND 47"""),
    "p_effect": ("dkey", """SELECT species, draw, CAST(pos - 47 AS INTEGER) AS yr, e AS value
        FROM dkey WHERE strat = 1 AND pos BETWEEN 48 AND 54"""),
    "p_b": ("dkey", """SELECT species, strat, draw, CAST(pos - 55 AS INTEGER) AS knot, e AS value
        FROM dkey WHERE pos BETWEEN 56 AND 59"""),
    "p_scalar": ("dkey", """
        SELECT species, draw, max(CASE WHEN pos = 60 THEN e END) AS ALPHA1,
               max(CASE WHEN pos = 61 THEN abs(e) END) AS sdyear,
               max(CASE WHEN pos = 62 THEN abs(e) END) AS sdalpha,
               max(CASE WHEN pos = 63 THEN abs(e) END) AS sdnoise,
               max(CASE WHEN pos BETWEEN 8 AND 15 THEN e END) / 2 AS seas,
               avg(CASE WHEN pos BETWEEN 8 AND 15 THEN e END) AS seas_mean
        FROM dkey WHERE strat = 1 GROUP BY 1, 2"""),
    "mrow": ("", """
        SELECT 'S' || CAST(CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 2 AS VARCHAR) AS species,
               CAST(o_custkey % 5 + 1 AS INTEGER) AS strat,
               CAST((o_custkey % 5) * 32 + (o_custkey // 5) % 32 + 1 AS INTEGER) AS site,
               CAST(year(o_orderdate) - 1994 AS INTEGER) AS yr, CAST(year(o_orderdate) AS INTEGER) AS year,
               CAST(dayofyear(o_orderdate) % 8 + 1 AS INTEGER) AS date, CAST(l_quantity AS INTEGER) AS count
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey"""),
    "gens": ("", """
        SELECT 'S' || CAST(k AS VARCHAR) AS species, CASE WHEN k = 0 THEN 2e0 ELSE 6.5e0 END AS gen_length
        FROM (SELECT DISTINCT vec_id % 2 AS k FROM embeddings)"""),
    "dobs": ("mrow", """
        SELECT species, 'R' || CAST(strat AS VARCHAR) AS region, year + 23 AS year, count FROM mrow"""),
    "g3": ("gens", """
        SELECT species, CAST(greatest(10, ceil(gen_length * 3)) AS INTEGER) AS g FROM gens"""),
    "periods": ("g3", """
        SELECT species, 'Long-term' AS trend_type, 1980 AS start_year, 2024 AS end_year FROM g3
        UNION ALL SELECT species, 'First-15-year', 1980, 1995 FROM g3
        UNION ALL SELECT species, '15-year', 2004, 2024 FROM g3
        UNION ALL SELECT species, 'Previous-three-generation', greatest(1980, 2024 - 2 * g), 2024 - g FROM g3
        UNION ALL SELECT species, 'Recent-three-generation', 2024 - g, 2024 FROM g3"""),
}


def sql(needs: str, body: str) -> str:
    """``body`` preceded by the fragments it needs, each once and after its own needs."""
    done: list[str] = []

    def add(name):
        for n in FRAGMENTS[name][0].split():
            add(n)
        if name not in done:
            done.append(name)

    for name in needs.split():
        add(name)
    if not done:
        return body
    parts = ",\n".join(f"{n} AS ({FRAGMENTS[n][1]})" for n in done)
    return f"WITH {parts}\n{body}"
