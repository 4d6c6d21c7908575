"""A third of all rows under one key: results stay whole and equal to plain computations."""

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from flockframe.operators import clean, compare, coverage, indices
from flockframe.operators.zero_fill import grid_parts, grid_sums, zero_fill

N = 6000


@pytest.fixture(scope="module")
def world(spark):
    """Checklist 7 holds a third of the counts, site 0 a third of the checklists, species A a third of the names."""
    hot = F.col("id") % 3 == 0
    ev = spark.range(N // 4).select(
        F.col("id").alias("checklist_id"), F.when(hot, 0).otherwise(F.col("id") % 40).alias("site_id"),
        (1990 + F.col("id") % 30).cast("int").alias("year"), (F.col("id") % 365 + 1).cast("int").alias("doy"))
    obs = spark.range(N).select(
        F.when(hot, 7).otherwise(F.col("id") % (N // 4)).alias("checklist_id"),
        F.when(F.col("id") % 3 == 1, "A").otherwise(F.concat(F.lit("s"), (F.col("id") % 28).cast("string")))
        .alias("common_name"),
        F.when(hot, 5).otherwise(F.col("id") % 4).cast("int").alias("observation_count"))
    return ev, obs, obs.select("common_name").distinct()


def plain_grid(world):
    ev, obs, sp = (d.toPandas() for d in world)
    obs = obs.drop_duplicates()
    n = obs.groupby(["checklist_id", "common_name"]).size()
    bad = set(n[n > 1].reset_index().checklist_id)
    ev, obs = ev[~ev.checklist_id.isin(bad)], obs[~obs.checklist_id.isin(bad)]
    out = ev.merge(sp, how="cross").merge(obs, how="left", on=["checklist_id", "common_name"])
    return out.assign(observation_count=out.observation_count.fillna(0).astype(int))


def as_rows(df, columns):
    return sorted(df[columns].itertuples(index=False, name=None))


def test_grid(world):
    columns = ["checklist_id", "site_id", "year", "doy", "common_name", "observation_count"]
    want = plain_grid(world)
    assert any(want.checklist_id == 7) and rows(zero_fill(*world).select(columns)) == as_rows(want, columns)


def test_grid_sums_and_parts(world):
    grid = plain_grid(world)
    want = grid.groupby(["site_id", "common_name"]).observation_count.agg(total="sum", n="size").reset_index()
    assert rows(grid_sums(*world, ["site_id"])) == as_rows(want, ["site_id", "common_name", "total", "n"])
    totals, sizes = grid_parts(*world, ["site_id"])
    assert dict(rows(sizes)) == grid.groupby("site_id").checklist_id.nunique().to_dict()
    got = totals.filter("total > 0").groupBy().agg(F.sum("total")).first()[0]
    assert got == grid.observation_count.sum()


def test_coverage_and_observed_summary(spark, world):
    grid = plain_grid(world).rename(columns={"common_name": "species", "observation_count": "count"})
    df = spark.createDataFrame(grid)
    seen = grid[grid["count"] > 0].groupby(["species", "site_id"]).year.agg(["min", "max", "nunique"])
    want = sorted(seen[(seen["max"] - seen["min"] >= 10) & (seen["nunique"] >= 2)].index)
    assert rows(coverage.site_coverage(df).select("species", "site_id")) == want
    obs = indices.observed_summary(df, ["species"], "count", distinct_of="site_id").toPandas().set_index("species")
    g = grid.groupby("species")["count"]
    for column, plain in (("obsmean", g.mean()), ("obslci", g.quantile(0.05)), ("obsuci", g.quantile(0.95)),
                          ("obsmed", g.median()), ("nsurveys", g.size())):
        pd.testing.assert_series_equal(obs[column].sort_index(), plain, check_names=False, check_dtype=False)


def test_latest_record_and_duplicates(world):
    ev = world[0]
    pdf = ev.toPandas().sort_values(["year", "checklist_id"]).groupby("site_id").tail(1)
    got = clean.latest_complete(ev, ["site_id"], "year", ["doy"], ["checklist_id"])
    assert rows(got) == as_rows(pdf, ["site_id", "doy"])
    n = ev.toPandas().drop_duplicates(["site_id", "year"]).groupby("site_id").size() - 1
    assert dict(rows(clean.duplicate_counts(ev, "site_id", ["year"]))) == n.to_dict()


def test_version_diff_pairs_counts_not_records(world):
    obs = world[1].withColumnRenamed("observation_count", "count")
    both = compare.tag_versions(obs, {"v_old": (F.lit(True), F.col("count")), "v_new": (F.lit(True), F.col("count") + 1)})
    out = compare.version_diff(both, ["common_name"])
    per_name = obs.select("common_name", "count").distinct().groupBy("common_name").count().collect()
    assert out.count() == sum(r["count"] ** 2 for r in per_name)
    assert out.select("common_name", "count_old", "n_old").distinct().agg(F.sum("n_old")).first()[0] == N


def test_tagged_versions_are_the_stacked_ones(world):
    obs = world[1].withColumnRenamed("observation_count", "count")
    new = obs.filter("count > 3").withColumn("count", F.col("count") * 2)
    tagged = compare.tag_versions(obs, {"a": (F.lit(True), F.col("count")), "b": (F.col("count") > 3, F.col("count") * 2)})
    stacked = compare.stack_versions({"a": obs, "b": new})
    columns = sorted(stacked.columns)
    assert tagged.select(columns).exceptAll(stacked.select(columns)).isEmpty() and tagged.count() == stacked.count()
    keys = ["common_name"]
    got = compare.version_diff(tagged, keys, old="a", new="b").groupBy("status").count()
    sides = [compare_side(df, keys, n) for df, n in ((obs, "old"), (new, "new"))]
    want = sides[0].join(sides[1], keys, "full").withColumn("status", F.expr(
        "CASE WHEN c_new - c_old IS NULL THEN 'missing' WHEN c_new <> c_old THEN 'changed' ELSE 'same' END")).groupBy("status").count()
    assert rows(got) == rows(want)


def compare_side(df, keys, name):
    return df.groupBy(*keys, F.col("count").alias(f"c_{name}")).count().drop("count")
