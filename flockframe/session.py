"""Session helpers: lineage cuts on shared storage and null-safe joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators count on (all changeable per session).

    Small join sides are broadcast by measured size only (AQE and the
    ``autoBroadcastJoinThreshold`` setting); no operator forces a broadcast.
    Skewed join partitions are split even where that costs another shuffle.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: ``spark.checkpoint.dir``, or else one in the session's warehouse,
    which a cluster shares too."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder, partitioned ``by`` columns, and go on from that table.

    Lineage, plan and inferred constraints all end here, so loops keep small plans,
    a lost executor costs no rework upstream, and joins see the table's true size.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys where null matches null; key columns come out once."""
    if not keys:
        raise ValueError("join_on needs at least one key")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = F.col(f"__l.{k}").eqNullSafe(F.col(f"__r.__r_{k}"))
        cond = c if cond is None else cond & c
    joined = left.alias("__l").join(renamed.alias("__r"), cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "right"):
        joined = joined.withColumns(
            {k: F.coalesce(F.col(k), F.col(f"__r_{k}")) for k in keys})
    return joined.drop(*[f"__r_{k}" for k in keys])
