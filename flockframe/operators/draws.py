"""Draw tables: reshaping, summaries and sampling.

Long draws: species, variable, chain, iteration, draw, dimension columns, value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.aggregates import interval, quantile_name, quantiles, ranked_quantiles
from ..functions.columns import digest_number
from ..session import join_on

def parameter_name(c: Column) -> Column:
    """``alpha[3,1]`` -> ``alpha``."""
    return F.regexp_extract(c, r"^([^\[]+)", 1)


def parameter_index(c: Column, dim: int) -> Column:
    """Integer index number ``dim`` (from 1) of ``alpha[3,1]``; null if there is none."""
    inner = F.split(F.regexp_extract(c, r"\[([0-9,]+)\]", 1), ",")
    return F.get(inner, F.lit(dim - 1)).try_cast("int")


def unpivot_parameters(wide: DataFrame, ids: list[str], variable: str | None = None) -> DataFrame:
    """Wide draws -> ids, parameter (the column name), value."""
    values = [c for c in wide.columns if c not in ids
              and (variable is None or c == variable or c.startswith(variable + "["))]
    if not values:
        raise ValueError(f"no columns for {variable!r}")
    # brackets in column names keep Spark from compiling the plan, so plain names stand in
    plain = [f"v{i}" for i in range(len(values))]
    renamed = wide.select(*ids, *[F.col(f"`{c}`").alias(n) for c, n in zip(values, plain)])
    cells = F.array(*[F.struct(F.lit(c).alias("parameter"), F.col(n).alias("value"))
                      for c, n in zip(values, plain)])
    return renamed.select(*ids, F.explode(cells).alias("__c")).select(*ids, "__c.*")


def draws_long(wide: DataFrame, ids: list[str], variable: str | None = None,
               dims: list[str] = ()) -> DataFrame:
    """Wide draws (columns ``name[i,j]``) -> long with one integer column per dimension."""
    return unpivot_parameters(wide, ids, variable).select(
        *ids, parameter_name(F.col("parameter")).alias("variable"),
        *[parameter_index(F.col("parameter"), i).alias(d) for i, d in enumerate(dims, 1)], "value")


def array_draws(df: DataFrame, ids: list[str], values: str, dim: str) -> DataFrame:
    """Draws held as one array per row -> long; ``dim`` counts from 1."""
    return df.select(*ids, F.posexplode(values).alias("__pos", "value")).select(
        *ids, (F.col("__pos") + 1).alias(dim), F.col("value").cast("double").alias("value"))


def summarise(draws: DataFrame, keys: list[str], value: Column | str = "value", *, ci: float = 0.95,
              probs=(), spread: bool = False) -> DataFrame:
    """mean, median, sd, lci, uci and optional ``Q_*`` quantiles per key, in one pass.

    A group is normally one parameter and holds the retained draws (thousands). For few keys
    with very many rows, or none, the caller asks to ``spread`` a group over tasks
    (``ranked_quantiles``). The rows are the same; a group without values has null quantiles.
    """
    value = F.col(value) if isinstance(value, str) else value
    lo, hi = interval(ci)
    names = {"median": 0.5, "lci": lo, "uci": hi, **{quantile_name(p): p for p in probs}}
    rows = draws.select(*keys, value.alias("__value"))
    moments = [F.avg("__value").alias("mean"), F.stddev_samp("__value").alias("sd")]
    columns = [*keys, "mean", "median", "sd", "lci", "uci", *[quantile_name(p) for p in probs]]
    if spread:
        rows = rows.withColumn("__all", F.lit(0))
        ranked = ranked_quantiles(rows, ["__all", *keys], "__value", names)
        return join_on(rows.groupBy("__all", *keys).agg(*moments), ranked, ["__all", *keys], "left").select(*columns)
    out = rows.groupBy(*keys).agg(*moments, quantiles(F.col("__value"), names.values()).alias("__q"))
    return out.withColumns({n: F.col("__q")[i] for i, n in enumerate(names)}).select(*columns)


def param_extract(summary: DataFrame, variable: str, dims: list[str], *, exp: bool = False,
                  columns=("mean", "sd", "lci", "median", "uci")) -> DataFrame:
    """Rows ``variable[...]`` of a summary table with parsed indices, optionally exponentiated."""
    rows = summary.filter(F.startswith(F.col("parameter"), F.lit(variable + "[")))
    rows = rows.withColumns({d: parameter_index(F.col("parameter"), i) for i, d in enumerate(dims, 1)})
    if exp:
        rows = rows.withColumns({c: F.exp(c) for c in columns if c in rows.columns})
    return rows


def sample_draws(draws: DataFrame, n: int = 100, seed: int = 0, draw: str = "draw") -> DataFrame:
    """``n`` whole draws, those of the least digests of ``seed`` and draw number; the same draws for all species."""
    chosen = (draws.select(draw).distinct()
              .orderBy(digest_number(F.lit(seed), F.col(draw)), draw).limit(n))
    return draws.join(chosen, draw, "left_semi")


def with_final_level(draws: DataFrame, end_year: int, keys: list[str]) -> DataFrame:
    """Attach the log value of the last year to every row of its draw."""
    last = draws.filter(F.col("year") == end_year).groupBy(*keys).agg(
        F.log(F.max("value")).alias("midp"))
    return join_on(draws, last, keys, "left")
