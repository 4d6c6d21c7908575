"""Cleaning operators and the plain aggregation also accept a streaming table."""

from conftest import rows
from pyspark.sql import functions as F

from flockframe.operators import clean, compare

SCHEMA = "checklist_id long, state string, common_name string, observation_count string, year int"


def test_cleaning_and_counts_on_a_stream(spark, tmp_path):
    data = [(1, "A", "x", "3", 2000), (2, None, "x", "X", 2000), (3, "B", "y", "5", 2001), (4, None, "y", "7", 2001)]
    for i in range(2):
        spark.createDataFrame(data[i * 2:i * 2 + 2], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))

    def work(df):
        return clean.exclude_states(clean.clean_counts(df), ["B"])

    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = work(stream).groupBy("common_name", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("observation_count").alias("s"))
    q = (out.writeStream.outputMode("complete").format("memory").queryName("cleaned")
         .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    assert q.awaitTermination(60)
    batch = work(spark.read.parquet(str(tmp_path / "in"))).groupBy("common_name", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("observation_count").alias("s"))
    assert rows(spark.table("cleaned")) == rows(batch) == [("x", 2000, 1, 3), ("y", 2001, 1, 7)]


def test_annual_counts_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("v", 2000, 1), ("v", 2000, 3)], "version string, year int, count int").write.parquet(
        str(tmp_path / "in"))
    stream = spark.readStream.schema("version string, year int, count int").parquet(str(tmp_path / "in"))
    q = (compare.annual_counts(stream, ["version", "year"]).writeStream.outputMode("complete").format("memory")
         .queryName("annual").option("checkpointLocation", str(tmp_path / "state"))
         .trigger(availableNow=True).start())
    assert q.awaitTermination(60)
    assert rows(spark.table("annual").withColumn("quantile_95_count", F.round("quantile_95_count", 9))) == [
        ("v", 2000, 2, 2.0, 3, 2.9)]
