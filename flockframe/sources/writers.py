"""Writers for stage snapshots and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def save_snapshot(df: DataFrame, path: str, by: str = "species", buckets: int = 16) -> None:
    """Parquet table partitioned by species; only the partitions present in ``df`` are replaced.

    Rows are spread by (species, hash bucket) rather than by species alone, so a
    species with many rows is written by many tasks.
    """
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(buckets))
    (df.repartition(F.col(by), spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(by).parquet(path))


def save_csv(df: DataFrame, path: str) -> None:
    """Result table as CSV with header; NA marks missing values."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def save_split(df: DataFrame, path: str, by: str = "region_type") -> None:
    """One CSV folder per value of ``by``."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").partitionBy(by).csv(path)
