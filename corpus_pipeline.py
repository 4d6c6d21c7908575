"""A corpus pipeline of the numbered operators: quality, near copies, benchmark passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flockframe.llm import stages

#: (name, function) of each stage; a function takes (spark, docs, sf_dir) and returns the next one's docs.
STAGES = [("quality", stages.quality), ("near_copies", stages.near_copies),
          ("benchmark_passages", stages.benchmark_passages), ("secret_spans", stages.secret_spans),
          ("packing", stages.packing)]
#: No SQL: trained models decide what stays. tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stages.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
