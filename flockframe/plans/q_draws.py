"""Registered queries: draw tables, indices, diagnostics, count adjustments."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import diagnostics, draws, indices
from . import testdata as T
from .registry import query, r6, rounded
from .testdata import sql

_SUMMARY = """round(avg({v}), 6) AS mean, round(quantile_cont({v}, 0.5), 6) AS median,
    round(stddev_samp({v}), 6) AS sd, round(quantile_cont({v}, 0.025), 6) AS lci,
    round(quantile_cont({v}, 0.975), 6) AS uci"""
_STATS = ["mean", "median", "sd", "lci", "uci"]


def _wide(spark, sf):
    """One row per draw with columns alpha[1] ... alpha[16], b[1,1] ... b[4,4]."""
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(33)]
    cols = [e[i].alias(f"alpha[{i + 1}]") for i in range(16)]
    cols += [e[16 + i].alias(f"b[{i // 4 + 1},{i % 4 + 1}]") for i in range(16)]
    return T.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("draw"), *cols, e[32].alias("ALPHA1"))


@query(sql("vec", """SELECT vec_id AS draw, 'b' AS variable, CAST((pos - 16) // 4 + 1 AS INTEGER) AS s,
      CAST((pos - 16) % 4 + 1 AS INTEGER) AS k, round(e, 6) AS value FROM vec WHERE pos BETWEEN 16 AND 31"""))
def draws_long(spark, sf):
    return rounded(draws.draws_long(_wide(spark, sf), ["draw"], "b", ["s", "k"]), "value")


@query(sql("vec", f"SELECT {_SUMMARY.format(v='e')} FROM vec WHERE pos = 32"))
def draw_summary_0d(spark, sf):
    d = draws.draws_long(_wide(spark, sf), ["draw"], "ALPHA1")
    return rounded(draws.summarise(d, [], spread=True), *_STATS)


@query(sql("vec", f"""SELECT CAST(pos + 1 AS INTEGER) AS s, {_SUMMARY.format(v='e')},
      round(quantile_cont(e, 0.05), 6) AS "Q_05", round(quantile_cont(e, 0.95), 6) AS "Q_95"
    FROM vec WHERE pos < 16 GROUP BY 1"""))
def draw_summary_1d(spark, sf):
    d = draws.draws_long(_wide(spark, sf), ["draw"], "alpha", ["s"])
    return rounded(draws.summarise(d, ["s"], probs=(0.05, 0.95)), *_STATS, "Q_05", "Q_95")


@query(sql("dst", f"""SELECT species, strat, year, {_SUMMARY.format(v='value')} FROM dst GROUP BY 1, 2, 3"""))
def draw_summary_2d(spark, sf):
    return rounded(draws.summarise(T.stratum_draws(spark, sf), ["species", "strat", "year"]), *_STATS)


@query(sql("dst", f"""SELECT species, {_SUMMARY.format(v='value')} FROM dst GROUP BY 1"""))
def draw_summary_spread(spark, sf):
    """Quantiles by distributed ranks, as used above the group bound."""
    return rounded(draws.summarise(T.stratum_draws(spark, sf), ["species"], spread=True), *_STATS)


@query(sql("vec", """SELECT 'alpha[' || CAST(pos + 1 AS VARCHAR) || ']' AS parameter,
      CAST(pos + 1 AS INTEGER) AS site, round(exp(avg(e)), 6) AS mean FROM vec WHERE pos < 16 GROUP BY pos"""))
def param_extract(spark, sf):
    table = (draws.unpivot_parameters(_wide(spark, sf), ["draw"])
             .groupBy("parameter").agg(F.avg("value").alias("mean")))
    return draws.param_extract(table, "alpha", ["site"], exp=True).select("parameter", "site", r6("mean"))


_STAGE = """stages AS (SELECT species, CAST(year AS INTEGER) AS year, CASE WHEN 2024 - year <= g THEN 'recent'
      WHEN 2024 - year <= 2 * g THEN 'previous' ELSE 'earlier' END AS stage
    FROM (SELECT species, g, unnest(range(1980, 2025)) AS year FROM g3))"""


def _with(needs, extra, body):
    return sql(needs, "@@").replace("\n@@", f",\n{extra}\n{body}")


@query("""WITH g3 AS (SELECT DISTINCT p_brand AS species, greatest(10,
      CAST(ceil(CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) / 2e0 * 3) AS INTEGER)) AS g FROM part),
    """ + _STAGE + " SELECT species, year, stage FROM stages")
def stage_labels(spark, sf):
    return indices.stage_labels(T.generations(spark, sf), 1980, 2024)


@query(_with("dsv g3", _STAGE, f"""SELECT d.*, stage FROM (
      SELECT species, 'N_alt' AS variable, year, {_SUMMARY.format(v='value')} FROM dsv GROUP BY ALL
      UNION ALL SELECT species, 'NSmooth_alt', year, {_SUMMARY.format(v='sqrt(value)')} FROM dsv GROUP BY ALL) d
    LEFT JOIN stages ON stages.species = d.species AND stages.year = d.year"""))
def annual_index(spark, sf):
    d = T.survey_draws(spark, sf)
    both = d.withColumn("variable", F.lit("N_alt")).unionByName(
        d.withColumn("variable", F.lit("NSmooth_alt")).withColumn("value", F.sqrt("value")))
    stages = indices.stage_labels(T.draw_generations(spark, sf), 1980, 2024)
    return rounded(indices.annual_index(both, stages), *_STATS)


@query(sql("dst", f"""SELECT species, strat, year, region, {_SUMMARY.format(v='value')}
    FROM dst GROUP BY ALL"""))
def stratum_index(spark, sf):
    d = T.stratum_draws(spark, sf)
    strata = d.select("species", "strat", "region").distinct()
    table = draws.summarise(d, ["species", "strat", "year"]).join(strata, ["species", "strat"], "left")
    return rounded(table, *_STATS)


@query(sql("dst", """
    SELECT species, region, year, round(quantile_cont(v, 0.5), 6) AS median, round(avg(v), 6) AS mean,
           round(quantile_cont(v, 0.025), 6) AS lci, round(quantile_cont(v, 0.975), 6) AS uci
    FROM (SELECT species, draw, region, year, sum(value) AS v FROM dst GROUP BY ALL
          UNION ALL SELECT species, draw, 'Composite', year, sum(value) FROM dst GROUP BY ALL) GROUP BY ALL"""))
def composite_index(spark, sf):
    return rounded(indices.composite_index(T.stratum_draws(spark, sf)), "median", "mean", "lci", "uci")


_SPLIT_RHAT = """SELECT species, strat, y, sqrt(((n - 1) / n * w + b) / w) AS rhat FROM (
      SELECT species, strat, y, avg(v) AS w, var_samp(m) AS b, avg(k) AS n FROM (
        SELECT species, strat, y, chain, half, avg(value) AS m, var_samp(value) AS v, count(*) AS k FROM (
          SELECT *, CASE WHEN iteration - i0 < n // 2 THEN 0 WHEN iteration - i0 >= n - n // 2 THEN 1 END AS half
          FROM (SELECT *, min(iteration) OVER (PARTITION BY species, strat, y, chain) AS i0,
                       count(*) OVER (PARTITION BY species, strat, y, chain) AS n FROM dst))
        WHERE half IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""


@query(sql("dst", f"SELECT species, strat, y, round(rhat, 6) AS rhat FROM ({_SPLIT_RHAT})"))
def split_rhat(spark, sf):
    return rounded(diagnostics.split_rhat(T.stratum_draws(spark, sf), ["species", "strat", "y"]), "rhat")


def _normal_quantile_sql(p):
    """The library's rational approximation, written out; its constants are tested against Python's own."""
    def rational(part, x):
        top, bottom = (f"{c[-1]!r}" for c in part)
        for a, b in zip(part[0][-2::-1], part[1][-2::-1]):
            top, bottom = f"({top} * {x} + {a!r})", f"({bottom} * {x} + {b!r})"
        return f"CAST({top} AS DOUBLE) / {bottom}"

    middle, near, far = C._AS241
    q, tail = f"({p} - 0.5e0)", f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"""CASE WHEN abs({q}) <= 0.425e0 THEN {q} * {rational(middle, f'(0.180625e0 - {q} * {q})')}
        WHEN {tail} <= 5 THEN sign({q}) * {rational(near, f'({tail} - 1.6e0)')}
        ELSE sign({q}) * {rational(far, f'({tail} - 5e0)')} END"""


def _scores_sql(table):
    keys = "species, strat, y"
    return f"""SELECT {keys}, chain, iteration, {_normal_quantile_sql('p')} AS value FROM (
      SELECT *, (rank() OVER (PARTITION BY {keys} ORDER BY value)
                 + (count(*) OVER (PARTITION BY {keys}, value) - 1) / 2e0 - 0.375e0)
                / (count(*) OVER (PARTITION BY {keys}) + 0.25e0) AS p FROM {table})"""


@query(_with("dkey", f"""
    raw AS (SELECT species, strat, chain, iteration, CAST(pos + 1 AS INTEGER) AS y, e AS value FROM dkey),
    middle AS (SELECT species, strat, y, 0.5e0 * l[(len(l) + 1) // 2] + 0.5e0 * l[len(l) // 2 + 1] AS m
        FROM (SELECT species, strat, y, list_sort(list(value)) AS l FROM raw GROUP BY ALL)),
    folded AS (SELECT species, strat, y, chain, iteration, abs(value - m) AS value
        FROM raw JOIN middle USING (species, strat, y)),
    z1 AS ({_scores_sql('raw')}), z2 AS ({_scores_sql('folded')})""",
             f"""SELECT species, strat, y, round(max(rhat), 6) AS rhat FROM (
      {_SPLIT_RHAT.replace('FROM dst', 'FROM z1')} UNION ALL {_SPLIT_RHAT.replace('FROM dst', 'FROM z2')}) GROUP BY ALL"""))
def rank_rhat(spark, sf):
    return rounded(diagnostics.rank_rhat(T.log_draws(spark, sf), ["species", "strat", "y"]), "rhat")


_ESS_SQL = """
    raw AS (SELECT species, strat, chain, iteration, CAST(pos + 1 AS INTEGER) AS y, e AS value FROM dkey),
    len AS (SELECT species, strat, y, min(k) AS n, count(*) AS m FROM (
        SELECT species, strat, y, chain, count(*) AS k FROM raw GROUP BY ALL) GROUP BY ALL),
    cut AS (SELECT raw.*, n, m FROM raw JOIN len USING (species, strat, y) WHERE iteration < n),
    cen AS (SELECT *, value - avg(value) OVER (PARTITION BY species, strat, y, chain) AS c FROM cut),
    means AS (SELECT species, strat, y, var_samp(mu) AS vm FROM (
        SELECT species, strat, y, chain, avg(value) AS mu FROM cut GROUP BY ALL) GROUP BY ALL),
    lagged AS (SELECT a.species, a.strat, a.y, a.n, a.m, b.iteration - a.iteration AS t,
        sum(a.c * b.c) / a.n / a.m AS g
      FROM cen a JOIN cen b ON b.species = a.species AND b.strat = a.strat AND b.y = a.y AND b.chain = a.chain
        AND b.iteration >= a.iteration
      GROUP BY a.species, a.strat, a.y, a.n, a.m, b.iteration - a.iteration),
    rho AS (SELECT l.species, l.strat, l.y, l.n, l.m, t,
        CASE WHEN t = 0 THEN 1 ELSE 1 - (z.g * l.n / (l.n - 1) - l.g) / (z.g + vm) END AS r
      FROM lagged l JOIN (SELECT species, strat, y, g FROM lagged WHERE t = 0) z USING (species, strat, y)
      JOIN means USING (species, strat, y)),
    pairs AS (SELECT species, strat, y, n, m, t // 2 AS k, sum(r) AS p FROM rho WHERE t < n // 2 * 2 GROUP BY ALL),
    stops AS (SELECT species, strat, y, coalesce(min(CASE WHEN p <= 0 THEN k END), max(k) + 1) AS stop FROM pairs GROUP BY ALL),
    tau AS (SELECT species, strat, y, n, m, stop, -1 + 2 * sum(low) AS tau FROM (
        SELECT *, min(p) OVER (PARTITION BY species, strat, y ORDER BY k) AS low FROM pairs
        JOIN stops USING (species, strat, y) WHERE k < stop) GROUP BY ALL)"""


@query(_with("dkey", _ESS_SQL, """SELECT species, strat, y,
      round(m * n / greatest(tau + greatest(coalesce(r, 0), 0), 1 / log10(m * n)), 6) AS ess
    FROM tau LEFT JOIN (SELECT species AS s, strat AS st, y AS yy, t, r FROM rho) q
      ON s = species AND st = strat AND yy = y AND t = 2 * stop"""))
def effective_size(spark, sf):
    return rounded(diagnostics.effective_size(T.log_draws(spark, sf), ["species", "strat", "y"]), "ess")


def _ess_sql(source, p):
    """CTEs of the effective sizes of ``source``'s chains; their names begin with ``p``, the last is ``p``ess."""
    body = _ESS_SQL[_ESS_SQL.index("    len AS"):]
    for name in ("len", "cut", "cen", "means", "lagged", "rho", "pairs", "stops", "tau"):
        body = re.sub(rf"\b(FROM|JOIN) {name}\b|\b{name}( AS \()", lambda m: f"{m[1]} {p}{name}" if m[1] else f"{p}{name}{m[2]}", body)
    body = body.replace("FROM raw", f"FROM {source}").replace("raw.*", f"{source}.*")
    return body + f""",
    {p}ess AS (SELECT species, strat, y, m * n / greatest(tau + greatest(coalesce(r, 0), 0), 1 / log10(m * n)) AS ess
      FROM {p}tau LEFT JOIN (SELECT species AS s, strat AS st, y AS yy, t, r FROM {p}rho) q
        ON s = species AND st = strat AND yy = y AND t = 2 * stop)"""


def _halved(source):
    """Each half chain of a table as a chain of its own, iterations from 0."""
    return f"""SELECT species, strat, y, chain * 2 + half AS chain, value,
        row_number() OVER (PARTITION BY species, strat, y, chain, half ORDER BY iteration) - 1 AS iteration FROM (
          SELECT *, CASE WHEN iteration - i0 < k // 2 THEN 0 WHEN iteration - i0 >= k - k // 2 THEN 1 END AS half
          FROM (SELECT *, min(iteration) OVER (PARTITION BY species, strat, y, chain) AS i0,
                       count(*) OVER (PARTITION BY species, strat, y, chain) AS k FROM {source})) WHERE half IS NOT NULL"""


@query(_with("dkey", f"""
    raw AS (SELECT species, strat, chain, iteration, CAST(pos + 1 AS INTEGER) AS y, e AS value FROM dkey),
    stat AS (SELECT species, strat, y, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS sd,
        quantile_cont(value, 0.05) AS q5, quantile_cont(value, 0.95) AS q95 FROM raw GROUP BY ALL),
    folded AS (SELECT species, strat, y, chain, iteration, abs(value - median) AS value FROM raw JOIN stat USING (species, strat, y)),
    z1 AS ({_scores_sql('raw')}), z2 AS ({_scores_sql('folded')}),
    halves AS ({_halved('raw')}), scored AS ({_halved('z1')}),
    low AS (SELECT h.* REPLACE (CAST(value <= q5 AS DOUBLE) AS value) FROM halves h JOIN stat USING (species, strat, y)),
    high AS (SELECT h.* REPLACE (CAST(value <= q95 AS DOUBLE) AS value) FROM halves h JOIN stat USING (species, strat, y)),
    {_ess_sql('scored', 'b_')}, {_ess_sql('low', 'l_')}, {_ess_sql('high', 'h_')}""", f"""
    SELECT species, strat, y, round(mean, 6) AS mean, round(median, 6) AS median, round(sd, 6) AS sd, round(mad, 6) AS mad,
      round(q5, 6) AS q5, round(q95, 6) AS q95, round(rhat, 6) AS rhat, round(b_ess.ess, 6) AS ess_bulk,
      round(least(l_ess.ess, h_ess.ess), 6) AS ess_tail
    FROM stat JOIN (SELECT species, strat, y, 1.4826e0 * quantile_cont(value, 0.5) AS mad FROM folded GROUP BY ALL) USING (species, strat, y)
    JOIN (SELECT species, strat, y, max(rhat) AS rhat FROM ({_SPLIT_RHAT.replace('FROM dst', 'FROM z1')} UNION ALL
          {_SPLIT_RHAT.replace('FROM dst', 'FROM z2')}) GROUP BY ALL) USING (species, strat, y)
    JOIN b_ess USING (species, strat, y) JOIN l_ess USING (species, strat, y) JOIN h_ess USING (species, strat, y)"""))
def convergence_summary(spark, sf):
    """All columns of a sampler's fit summary."""
    out = diagnostics.convergence_summary(T.log_draws(spark, sf), ["species", "strat", "y"])
    return rounded(out, "mean", "median", "sd", "mad", "q5", "q95", "rhat", "ess_bulk", "ess_tail")


@query(sql("dst", f"""SELECT species, round(max(rhat), 6) AS max_rhat, round(avg(rhat), 6) AS mean_rhat,
      round(min(100 + y + strat / 10e0), 6) AS min_ess, round(avg(100 + y + strat / 10e0), 6) AS mean_ess
    FROM ({_SPLIT_RHAT}) WHERE y % 2 = 1 GROUP BY 1"""))
def convergence_rollup(spark, sf):
    rhat = diagnostics.split_rhat(T.stratum_draws(spark, sf), ["species", "strat", "y"])
    name = F.concat(F.when(F.col("y") % 2 == 1, "nsmooth").otherwise("n"), F.lit("["),
                    F.col("strat").cast("string"), F.lit(","), F.col("y").cast("string"), F.lit("]"))
    summary = rhat.withColumn("variable", name).withColumn(
        "ess_bulk", 100 + F.col("y") + F.col("strat") / 10.0)
    out = diagnostics.convergence_rollup(summary, ["species"], contains="smooth")
    return rounded(out, "max_rhat", "mean_rhat", "min_ess", "mean_ess")


@query(sql("dst", """SELECT species, region, round(avg(value), 6) AS mean_looic, round(median(value), 6) AS median_looic,
      round(quantile_cont(value, 0.75), 6) AS q75_looic, round(avg(ln(value)), 6) AS mean_k,
      round(median(ln(value)), 6) AS median_k, round(quantile_cont(ln(value), 0.75), 6) AS q75_k
    FROM dst GROUP BY ALL"""))
def pointwise_rollup(spark, sf):
    points = T.stratum_draws(spark, sf).withColumn("looic", F.col("value")).withColumn("k", F.log("value"))
    return rounded(diagnostics.pointwise_rollup(points, ["species", "region"]),
                   *[f"{s}_{c}" for c in ("looic", "k") for s in ("mean", "median", "q75")])


@query(sql("dsv", """SELECT species, draw, year, round(value, 6) AS value, round(midp, 6) AS midp
    FROM dsv JOIN (SELECT species, draw, ln(value) AS midp FROM dsv WHERE year = 2024) USING (species, draw)
    WHERE draw IN (SELECT draw FROM (SELECT DISTINCT draw FROM dsv)
                   ORDER BY CAST('0x' || substr(md5('2024|' || draw), 1, 13) AS BIGINT), draw LIMIT 20)"""))
def sample_draws(spark, sf):
    """20 whole draws by digest, with the log value of the last year."""
    d = draws.sample_draws(T.survey_draws(spark, sf), 20, seed=2024)
    d = draws.with_final_level(d, 2024, ["species", "draw"]).select("species", "draw", "year", "value", "midp")
    return rounded(d, "value", "midp")


@query(sql("dsv", """SELECT species, draw, year, round(value, 6) AS value, round(midp, 6) AS midp
    FROM dsv JOIN (SELECT species, draw, ln(value) AS midp FROM dsv WHERE year = 2024) USING (species, draw)"""))
def draws_with_final_level(spark, sf):
    d = draws.with_final_level(T.survey_draws(spark, sf), 2024, ["species", "draw"])
    return rounded(d.select("species", "draw", "year", "value", "midp"), "value", "midp")


# --- count adjustments --------------------------------------------------------


@query(sql("p_alpha p_scalar", """SELECT species, site, round(avg(v), 6) AS mean,
      round(quantile_cont(v, 0.025), 6) AS lci, round(quantile_cont(v, 0.975), 6) AS uci
    FROM (SELECT species, site, exp(value) AS v FROM p_alpha) GROUP BY 1, 2"""))
def site_effects(spark, sf):
    return rounded(indices.site_effects(T.param_draws(spark, sf)["alpha"]), "mean", "lci", "uci")


_SCALE = """scale AS (SELECT species, day, exp(-avg(value)) AS seas_sc FROM p_season GROUP BY 1, 2),
    scaled AS (SELECT m.*, count * seas_sc AS count_scale FROM mrow m
      LEFT JOIN scale ON scale.species = m.species AND scale.day = m.date)"""


def _scaled(spark, sf):
    scale = indices.season_scale(T.param_draws(spark, sf)["season"], ["species", "day"])
    return indices.season_scaled_counts(T.model_rows(spark, sf), scale.withColumnRenamed("day", "date"),
                                        ["species", "date"])


@query(_with("p_season mrow", _SCALE, """SELECT species, strat, year, round(avg(count_scale), 6) AS obsmean,
    count(*) AS n_counts, round(sqrt(count(*)), 6) AS sqrt_n FROM scaled GROUP BY ALL"""))
def season_scaled_counts(spark, sf):
    return _scaled(spark, sf).groupBy("species", "strat", "year").agg(
        r6(F.avg("count_scale"), "obsmean"), F.count(F.lit(1)).alias("n_counts"),
        r6(F.sqrt(F.count(F.lit(1))), "sqrt_n"))


_OBS = """round(avg({v}), 6) AS obsmean, round(quantile_cont(CAST({v} AS DOUBLE), 0.05), 6) AS obslci,
    round(quantile_cont(CAST({v} AS DOUBLE), 0.95), 6) AS obsuci,
    round(quantile_cont(CAST({v} AS DOUBLE), 0.5), 6) AS obsmed,
    count(*) AS nsurveys, round(sqrt(count(*)), 6) AS sqrt_n"""
_OBS_COLUMNS = ["obsmean", "obslci", "obsuci", "obsmed", "sqrt_n"]


@query(_with("p_season mrow", _SCALE, f"""SELECT species, year, {_OBS.format(v='count_scale')},
    count(DISTINCT strat) AS n_strat FROM scaled GROUP BY ALL"""))
def observed_summary(spark, sf):
    out = indices.observed_summary(_scaled(spark, sf), ["species", "year"], "count_scale", distinct_of="strat")
    return rounded(out, *_OBS_COLUMNS)


@query(_with("p_season mrow p_alpha", _SCALE + """,
    adj AS (SELECT species, site, avg(exp(value)) AS adjs FROM p_alpha GROUP BY 1, 2)""",
             f"""SELECT s.species, s.strat, s.year, {_OBS.format(v='count_scale')},
    count(DISTINCT s.site) AS n_site, round(avg(adjs), 6) AS mean_counts_incl
    FROM scaled s LEFT JOIN adj ON adj.species = s.species AND adj.site = s.site GROUP BY ALL"""))
def observed_summary_by_stratum(spark, sf):
    adj = indices.site_effects(T.param_draws(spark, sf)["alpha"]).select(
        "species", "site", F.col("mean").alias("adjs"))
    rows = _scaled(spark, sf).join(adj, ["species", "site"], "left")
    out = indices.observed_summary(rows, ["species", "strat", "year"], "count_scale",
                                   distinct_of="site", offset="adjs")
    return rounded(out, *_OBS_COLUMNS, "mean_counts_incl")


@query(sql("zf", """SELECT species, year, count(*) AS n_counts, round(avg(count), 6) AS mean_counts,
      round(quantile_cont(CAST(count AS DOUBLE), 0.25), 6) AS lqrt_counts,
      round(quantile_cont(CAST(count AS DOUBLE), 0.75), 6) AS uqrt_counts FROM zf GROUP BY 1, 2"""))
def observed_quartiles(spark, sf):
    out = indices.observed_quartiles(T.survey_values(spark, sf, ["year"]), ["species", "year"], weight="n")
    return rounded(out, "mean_counts", "lqrt_counts", "uqrt_counts")


_ALPHA = "am AS (SELECT species, site, avg(value) AS mean FROM p_alpha GROUP BY 1, 2)"


def _alpha_means(spark, sf):
    return T.param_draws(spark, sf)["alpha"].groupBy("species", "site").agg(F.avg("value").alias("mean"))


@query(_with("mrow p_alpha", _ALPHA, """SELECT species, year, round(1 / sum(share), 6) AS p_alpha FROM (
      SELECT DISTINCT m.species, m.year, m.site, exp(mean) / total AS share FROM mrow m
      JOIN am ON am.species = m.species AND am.site = m.site
      JOIN (SELECT species, sum(exp(mean)) AS total FROM am GROUP BY 1) t ON t.species = m.species) GROUP BY 1, 2"""))
def site_correction(spark, sf):
    return rounded(indices.site_correction(T.model_rows(spark, sf), _alpha_means(spark, sf)), "p_alpha")


@query(_with("mrow p_alpha p_season", _ALPHA + ",\n" + _SCALE + f""",
    cor AS (SELECT species, year, 1 / sum(share) AS p_alpha FROM (
      SELECT DISTINCT m.species, m.year, m.site, exp(mean) / total AS share FROM mrow m
      JOIN am ON am.species = m.species AND am.site = m.site
      JOIN (SELECT species, sum(exp(mean)) AS total FROM am GROUP BY 1) t ON t.species = m.species) GROUP BY 1, 2),
    ob AS (SELECT species, year, avg(count_scale) AS obsmean, count(*) AS nsurveys FROM scaled GROUP BY 1, 2)""",
             """SELECT ob.species, ob.year, round(obsmean * p_alpha, 6) AS obsmean, nsurveys
    FROM ob JOIN cor ON cor.species = ob.species AND cor.year = ob.year"""))
def index_with_observed(spark, sf):
    observed = indices.observed_summary(_scaled(spark, sf), ["species", "year"], "count_scale")
    cor = indices.site_correction(T.model_rows(spark, sf), _alpha_means(spark, sf))
    frame = T.model_rows(spark, sf).select("species", "year").distinct()
    out = indices.index_with_observed(frame, observed, ["species", "year"], cor)
    return out.select("species", "year", r6("obsmean"), "nsurveys")


_DRIFT = """SELECT species, year{k}, round(avg(mean), 6) AS mean_alpha FROM (
    SELECT DISTINCT m.species, m.year, m.strat, m.site, mean FROM mrow m
    LEFT JOIN am ON am.species = m.species AND am.site = m.site) GROUP BY ALL"""


@query(_with("mrow p_alpha", _ALPHA, _DRIFT.format(k="")))
def site_effect_drift(spark, sf):
    return rounded(indices.site_effect_drift(T.model_rows(spark, sf), _alpha_means(spark, sf)), "mean_alpha")


@query(_with("mrow p_alpha", _ALPHA, _DRIFT.format(k=", strat")))
def site_effect_drift_by_stratum(spark, sf):
    return rounded(indices.site_effect_drift(T.model_rows(spark, sf), _alpha_means(spark, sf), ("strat",)),
                   "mean_alpha")


@query(_with("p_season p_alpha p_scalar", """
    off AS (SELECT species, strat, avg(m) AS adjs FROM (
      SELECT species, strat, site, avg(exp(value)) AS m FROM p_alpha GROUP BY 1, 2, 3) GROUP BY 1, 2),
    shift AS (SELECT species, avg(ALPHA1) AS s FROM p_scalar GROUP BY 1),
    eff AS (SELECT p.species, day, avg(exp(value + s)) AS mean, quantile_cont(exp(value + s), 0.025) AS lci,
                   quantile_cont(exp(value + s), 0.975) AS uci
            FROM p_season p JOIN shift ON shift.species = p.species GROUP BY 1, 2)""",
             """SELECT off.species, strat, day, round(mean * adjs, 6) AS mean, round(lci * adjs, 6) AS lci,
      round(uci * adjs, 6) AS uci FROM eff JOIN off ON off.species = eff.species"""))
def season_curve(spark, sf):
    p = T.param_draws(spark, sf)
    offsets = indices.stratum_offsets(indices.site_effects(p["alpha"]), p["site_strata"], ["species", "strat"])
    shift = p["scalars"].groupBy("species").agg(F.avg("ALPHA1").alias("shift"))
    out = indices.season_curve(p["season"], shift, offsets)
    return rounded(out.select("species", "strat", "day", "mean", "lci", "uci"), "mean", "lci", "uci")


@query(sql("zf", """SELECT species, doy, round(avg(count), 6) AS mean,
      round(quantile_cont(CAST(count AS DOUBLE), 0.5), 6) AS median,
      round(quantile_cont(CAST(count AS DOUBLE), 0.05), 6) AS lqrt,
      round(quantile_cont(CAST(count AS DOUBLE), 0.95), 6) AS uqrt FROM zf GROUP BY 1, 2"""))
def season_profile(spark, sf):
    out = indices.season_profile(T.survey_values(spark, sf, ["doy"]), ["species", "doy"], weight="n")
    return rounded(out, "mean", "median", "lqrt", "uqrt")


@query(sql("vec", """SELECT CAST(pos + 1 AS INTEGER) AS s, round(quantile_cont(e, 0.025), 6) AS "PI2_5",
      round(quantile_cont(e, 0.975), 6) AS "PI97_5", round(avg(e), 6) AS mean FROM vec WHERE pos < 16 GROUP BY 1"""))
def quantile_columns(spark, sf):
    """Columns named by percentage come out under plain names."""
    d = draws.summarise(draws.draws_long(_wide(spark, sf), ["draw"], "alpha", ["s"]), ["s"])
    percent = d.select("s", F.col("lci").alias("2.5%"), F.col("uci").alias("97.5%"), "mean")
    return rounded(percent.toDF(*[C.rename_quantile(c) for c in percent.columns]), "PI2_5", "PI97_5", "mean")
