"""Aggregate helpers, all exact and mergeable on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..session import checkpoint, join_on


def quantiles(c: Column, probs) -> Column:
    """Array of linearly interpolated quantiles (type 7) in one pass."""
    return F.percentile(c, F.array(*[F.lit(float(p)) for p in probs]))


def quantile(c: Column, p: float) -> Column:
    return F.percentile(c, F.lit(float(p)))


def share_below(c: Column, threshold: float) -> Column:
    """Share of all rows below a threshold; nulls stay in the denominator."""
    return F.count_if(c < threshold) / F.count(F.lit(1))


def log_slope(value: Column, x: Column) -> Column:
    """Least-squares slope of log(value) on x; non-positive values are left out."""
    return F.regr_slope(F.when(value > 0, F.log(value)), x.cast("double"))


def interval(ci: float) -> tuple[float, float]:
    lo = (1 - ci) / 2
    return lo, 1 - lo


def quantile_name(p: float) -> str:
    """0.025 -> Q_025, 0.5 -> Q_5."""
    return "Q_" + f"{p:g}".replace("0.", "", 1)


def ranked_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact grouped quantiles for groups too large for one task.

    Equal values are counted first. The different values are dealt out by range, between splitters that Spark
    samples, so parts are alike in size however the values lie, outliers included. The parts' totals (a row for each
    part that a group touches) give the rank that each part starts at and tell which parts hold the wanted ranks;
    only those few are ordered.
    """
    if not keys:
        raise ValueError("ranked_quantiles needs at least one key")
    freq = (df.filter(F.col(value).isNotNull())
            .groupBy(*keys, F.col(value).cast("double").alias("__v"))
            .agg(F.count(F.lit(1)).alias("__n")))
    parted = checkpoint(freq.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id()))
    order, group = Window.partitionBy(*keys).orderBy("__part"), Window.partitionBy(*keys)
    totals = (parted.groupBy(*keys, "__part").agg(F.sum("__n").alias("__bn"))
              .withColumn("__before", F.sum("__bn").over(order) - F.col("__bn"))
              .withColumn("__total", F.sum("__bn").over(group)))

    def position(p):
        return (F.col("__total") - 1) * float(p)

    ranks = F.array(*[f(position(p)) for p in probs.values() for f in (F.floor, F.ceil)])
    wanted = (totals
              .filter(F.exists(ranks, lambda r: (r >= F.col("__before"))
                               & (r < F.col("__before") + F.col("__bn"))))
              .select(*keys, "__part", "__before", "__total"))
    within = Window.partitionBy(*keys, "__part").orderBy("__v")
    rows = (join_on(parted, wanted, [*keys, "__part"])
            .withColumn("__end", F.col("__before") + F.sum("__n").over(within))
            .withColumn("__start", F.col("__end") - F.col("__n")))

    def at(rank):
        return F.max(F.when((rank >= F.col("__start")) & (rank < F.col("__end")), F.col("__v")))

    picks = {}
    for i, p in enumerate(probs.values()):
        picks[f"__a{i}"] = at(F.floor(position(p)))
        picks[f"__b{i}"] = at(F.ceil(position(p)))
        picks[f"__w{i}"] = F.max(position(p) - F.floor(position(p)))
    out = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in picks.items()])
    return out.select(*keys, *[
        (F.col(f"__a{i}") + F.col(f"__w{i}") * (F.col(f"__b{i}") - F.col(f"__a{i}"))).alias(name)
        for i, name in enumerate(probs)])
