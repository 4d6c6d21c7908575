"""Convergence diagnostics per parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import columns as C
from ..functions.aggregates import quantiles
from ..session import join_on


def _halves(draws, keys):
    """Mark each chain's first and second half; a middle iteration of odd chains is left out."""
    n = draws.groupBy(*keys, "chain").agg(F.min("iteration").alias("__i0"),
                                 (F.max("iteration") - F.min("iteration") + 1).alias("__n"))
    at = F.col("iteration") - F.col("__i0")
    half = F.floor(F.col("__n") / 2)
    return (join_on(draws, n, [*keys, "chain"])
            .withColumn("__half", F.when(at < half, 0).when(at >= F.col("__n") - half, 1))
            .filter(F.col("__half").isNotNull()))


def _rhat(sequences, keys):
    """R-hat from per-sequence moments __m, __v, __k."""
    parts = sequences.groupBy(*keys).agg(
        F.avg("__v").alias("w"), F.var_samp("__m").alias("b_n"), F.avg("__k").alias("n"))
    pooled = (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b_n")
    return parts.select(*keys, F.sqrt(F.try_divide(pooled, F.col("w"))).alias("rhat"))


def split_rhat(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Split R-hat: between- and within-variance of half chains."""
    seqs = _halves(draws, keys).groupBy(*keys, "chain", "__half").agg(
        F.avg("value").alias("__m"), F.var_samp("value").alias("__v"),
        F.count(F.lit(1)).alias("__k"))
    return _rhat(seqs, keys)


def rank_normalised(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Values replaced by normal scores of their (average) ranks among the parameter's draws.

    One parameter holds its retained draws, thousands of rows; equal values are
    counted before they are ranked.
    """
    freq = draws.groupBy(*keys, "value").agg(F.count(F.lit(1)).cast("double").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("value"))
    total = F.sum("__n").over(Window.partitionBy(*keys))
    # average rank of the tied values, shifted and scaled into (0, 1)
    p = (upto - (F.col("__n") - 1) / 2 - 0.375) / (total + 0.25)
    scores = freq.select(*keys, "value", C.normal_quantile(p).alias("__z"))
    return (join_on(draws, scores, [*keys, "value"])
            .withColumn("value", F.col("__z")).drop("__z"))


def rank_rhat(draws: DataFrame, keys: list[str]) -> DataFrame:
    """The greater of split R-hat of the normal scores and of the folded normal scores.

    The first reacts to chains that differ in level, the second (scores of the
    distance from the median) to chains that differ in spread.
    """
    draws = draws.select(*keys, "chain", "iteration", "value")
    middle = draws.groupBy(*keys).agg(F.median("value").alias("__m"))
    folded = (join_on(draws, middle, keys)
              .withColumn("value", F.abs(F.col("value") - F.col("__m"))).drop("__m"))
    level = split_rhat(rank_normalised(draws, keys), keys)
    spread = split_rhat(rank_normalised(folded, keys), keys)
    return level.unionByName(spread).groupBy(*keys).agg(F.max("rhat").alias("rhat"))


def bulk_ess(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Effective sample size of the normal scores, each half chain a chain of its own."""
    scores = rank_normalised(draws.select(*keys, "chain", "iteration", "value"), keys)
    halves = _halves(scores, keys).withColumn("chain", F.col("chain") * 2 + F.col("__half"))
    return effective_size(halves, keys).withColumnRenamed("ess", "ess_bulk")


def effective_size(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Effective sample size by initial positive, monotone sums of the pooled autocorrelation.

    One parameter's chains (thousands of numbers) go to one Arrow call; the
    parameters are spread over the cluster.
    """
    schema = draws.select(*keys).schema.add("ess", "double")

    def per_parameter(pdf):
        import numpy as np
        import pandas as pd

        chains = [g.sort_values("iteration")["value"].to_numpy() for _, g in pdf.groupby("chain")]
        n = min(len(c) for c in chains)
        x = np.stack([c[:n] for c in chains])
        m, ess = len(x), float("nan")
        if n > 3 and x.std() > 0:
            centred = x - x.mean(axis=1, keepdims=True)
            size = 2 ** int(np.ceil(np.log2(2 * n)))
            power = np.abs(np.fft.rfft(centred, size, axis=1)) ** 2
            lagged = np.fft.irfft(power, size, axis=1)[:, :n].mean(axis=0) / n
            within = lagged[0] * n / (n - 1)
            pooled = lagged[0] + (x.mean(axis=1).var(ddof=1) if m > 1 else 0.0)
            rho = 1 - (within - lagged) / pooled
            rho[0] = 1.0
            pairs = rho[: n // 2 * 2].reshape(-1, 2).sum(axis=1)
            stop = int(np.argmax(pairs <= 0)) if (pairs <= 0).any() else len(pairs)
            rest = max(rho[2 * stop], 0.0) if 2 * stop < n else 0.0
            tau = -1 + 2 * np.minimum.accumulate(pairs[:stop]).sum() + rest
            ess = float(m * n / max(tau, 1 / np.log10(m * n)))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "ess": [ess]})

    return draws.select(*keys, "chain", "iteration", "value").groupBy(*keys).applyInPandas(
        per_parameter, schema)


#: Makes the median absolute deviation of normal values their standard deviation (fixed value).
MAD_SCALE = 1.4826


def tail_ess(draws: DataFrame, keys: list[str], tails: tuple[float, ...] = (0.05, 0.95)) -> DataFrame:
    """Effective sample size in the tails: the least of those of the indicators of lying at or below a tail's quantile.

    Each half chain is a chain of its own. A tail with all values on one side has no size.
    """
    draws = draws.select(*keys, "chain", "iteration", "value")
    ends = draws.groupBy(*keys).agg(quantiles(F.col("value"), tails).alias("__q"))
    marks = join_on(_halves(draws, keys), ends, keys).select(
        *keys, (F.col("chain") * 2 + F.col("__half")).alias("chain"), "iteration", "value", F.posexplode("__q").alias("__tail", "__end"))
    marks = marks.withColumn("value", (F.col("value") <= F.col("__end")).cast("double"))
    return effective_size(marks, [*keys, "__tail"]).groupBy(*keys).agg(F.min("ess").alias("ess_tail"))


def draw_statistics(draws: DataFrame, keys: list[str]) -> DataFrame:
    """mean, median, sd, mad, q5 and q95 of each parameter's draws."""
    rows = draws.select(*keys, "value")
    whole = rows.groupBy(*keys).agg(F.avg("value").alias("mean"), quantiles(F.col("value"), (0.5, 0.05, 0.95)).alias("__q"),
                                    F.stddev_samp("value").alias("sd"))
    whole = whole.select(*keys, "mean", F.col("__q")[0].alias("median"), "sd", F.col("__q")[1].alias("q5"), F.col("__q")[2].alias("q95"))
    away = join_on(rows, whole.select(*keys, "median"), keys).groupBy(*keys).agg(
        (F.median(F.abs(F.col("value") - F.col("median"))) * MAD_SCALE).alias("mad"))
    return join_on(whole, away, keys).select(*keys, "mean", "median", "sd", "mad", "q5", "q95")


def convergence_summary(draws: DataFrame, keys: list[str]) -> DataFrame:
    """mean, median, sd, mad, q5, q95, rhat, ess_bulk and ess_tail per parameter, the input of ``convergence_rollup``."""
    out = draw_statistics(draws, keys)
    for part in (rank_rhat(draws, keys), bulk_ess(draws, keys), tail_ess(draws, keys)):
        out = join_on(out, part, keys)
    return out


def convergence_rollup(summary: DataFrame, keys: list[str], contains: str | None = None) -> DataFrame:
    """Worst and mean R-hat and effective size, optionally for variables holding a text."""
    if contains:
        summary = summary.filter(F.contains(F.col("variable"), F.lit(contains)))
    return summary.groupBy(*keys).agg(
        F.max("rhat").alias("max_rhat"), F.avg("rhat").alias("mean_rhat"),
        F.min("ess_bulk").alias("min_ess"), F.avg("ess_bulk").alias("mean_ess"))


def pointwise_rollup(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, median and upper quartile of pointwise looic and k by key."""
    aggs = []
    for c in ("looic", "k"):
        v = F.col(c).cast("double")
        aggs += [F.avg(v).alias(f"mean_{c}"), F.median(v).alias(f"median_{c}"),
                 F.percentile(v, F.lit(0.75)).alias(f"q75_{c}")]
    return points.groupBy(*keys).agg(*aggs)
