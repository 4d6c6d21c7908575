"""Comparing dataset versions and trend versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.aggregates import quantile
from ..session import join_on


def stack_versions(tables: dict[str, DataFrame]) -> DataFrame:
    """Union by name with a ``version`` column; absent columns are null."""
    out = None
    for label, df in tables.items():
        df = df.withColumn("version", F.lit(label))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def tag_versions(records: DataFrame, versions: dict[str, tuple[Column, Column]], count: str = "count") -> DataFrame:
    """Versions that can be told from one and the same records, as a stacked table: ``versions`` gives for each label the
    condition under which it holds a record, and the record's count there. The records are read once."""
    entries = F.array(*[F.when(keep, F.struct(F.lit(label).alias("version"), value.alias(count))) for label, (keep, value) in versions.items()])
    rest = [c for c in records.columns if c != count]
    return records.select(*rest, F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("__e")).select(*rest, "__e.*")


def collapse_regions(region: Column, keep, rest: str) -> Column:
    """Region names outside ``keep`` (or unknown) become ``rest``."""
    return F.when(region.isin(*keep), region).otherwise(F.lit(rest))


def annual_counts(df: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """n, mean, maximum and 95 % quantile of the counts per key."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_counts"), F.avg(count).alias("mean_count"),
        F.max(count).alias("max_count"),
        quantile(F.col(count).cast("double"), 0.95).alias("quantile_95_count"))


def long_sites(df: DataFrame, keys: list[str], min_years: int = 10) -> DataFrame:
    """Sites with more than ``min_years`` survey years."""
    return (df.select(*keys, "year").distinct().groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_years")).filter(F.col("n_years") > min_years))


def cross_version_matches(df: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """Keys found in more than one version, with the spread of their counts."""
    # moments per version first: the distinct versions of a key are then plain rows
    moments = df.groupBy(*keys, "version").agg(
        F.count(count).cast("double").alias("__n"), F.sum(count).cast("double").alias("__s"),
        F.sum(F.col(count).cast("double") * F.col(count)).alias("__q"))
    n, s, q = F.sum("__n"), F.sum("__s"), F.sum("__q")
    var = F.when(n > 1, F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1))
    return (moments.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_vers"), F.sqrt(var).alias("sd_count"))
            .filter(F.col("n_vers") > 1))


def version_diff(both: DataFrame, keys: list[str], count: str = "count", old: str = "v_old", new: str = "v_new") -> DataFrame:
    """Two versions of a stacked table, key by key, with the count difference and a status.

    keys, count_old, n_old, count_new, n_new, dif_count, status: ``changed``, ``same`` or ``missing`` (in one version
    only). One aggregation counts the records of either version by key and count; a key's few different counts, not its
    records, are then paired as a full join would.
    """
    here = both.filter(F.col("version").isin(old, new)).groupBy(*keys, F.col(count).alias("__c")).agg(
        F.count_if(F.col("version") == old).alias("__old"), F.count_if(F.col("version") == new).alias("__new"))

    def side(name):
        n = F.col(f"__{name}")
        return F.collect_list(F.when(n > 0, F.struct(F.col("__c").alias(f"count_{name}"), n.alias(f"n_{name}")))).alias(f"__s_{name}")

    pairs = here.groupBy(*keys).agg(side("old"), side("new")).withColumn("__o", F.explode_outer("__s_old")).withColumn(
        "__n", F.explode_outer("__s_new"))
    return (pairs.select(*keys, "__o.*", "__n.*").withColumn("dif_count", F.col("count_new") - F.col("count_old"))
            .withColumn("status", F.when(F.col("dif_count").isNull(), "missing")
                        .when(F.col("dif_count") != 0, "changed").otherwise("same")))


def old_with_new(old: DataFrame, new: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Inner join where the key columns have different names on the two sides."""
    cond = None
    for left, right in pairs.items():
        c = old[left] == new[right]
        cond = c if cond is None else cond & c
    return old.join(new, cond).drop(*[new[r] for r in pairs.values()])


def trend_versions(tables: list[tuple[DataFrame, str, str]], trend_type: str | None = "Long-term"
                   ) -> DataFrame:
    """Stack (trends, version, model) tables and label each by ``version-endyear``."""
    out = None
    for df, version, model in tables:
        df = df.withColumn("version", F.lit(version)).withColumn("model", F.lit(model))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if trend_type:
        out = out.filter(F.col("trend_type") == trend_type)
    return out.withColumn("version_2", F.concat_ws("-", "version", F.col("end_year").cast("string")))
