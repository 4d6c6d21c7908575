"""Stages of the corpus pipeline: each applies one operator's decisions to a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import checkpoint
from .minhash import near_duplicates
from .packing import pack
from .quality import accepted
from .secrets import mask
from .wumanber import without_passages


def written(docs: DataFrame) -> DataFrame:
    """A stage's result as a table in the shared folder."""
    return checkpoint(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, each row judged by its own text."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near copies (similarity of 0.8 or more): of each linked group the one with the least doc_id stays.

    Rows of one doc_id are one document, of which one row stays. Rows without an id all stay.
    """
    found = checkpoint(near_duplicates(docs, percent=80))
    dropped = found.filter("not kept").select("doc_id").distinct()
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    single = docs.join(dropped.union(repeated).distinct().hint("merge"), "doc_id", "left_anti")
    again = docs.join(repeated.hint("merge"), "doc_id", "left_semi").join(dropped.hint("merge"), "doc_id", "left_anti")
    first = again.withColumn("__row", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).filter("__row = 1")
    return single.unionByName(first.drop("__row")).select(docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return pack(docs)
