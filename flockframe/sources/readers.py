"""Readers. All take explicit schemas, so no extra pass infers types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import schemas


def read_delimited(spark: SparkSession, paths: str | list[str], schema: str, sep: str = "\t") -> DataFrame:
    """One or several delimited exports of the same layout, appended."""
    return (spark.read.schema(schema).option("header", True).option("sep", sep)
            .option("nullValue", "").csv(paths))


def read_observations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_delimited(spark, paths, schemas.OBSERVATIONS)


def read_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_delimited(spark, paths, schemas.EVENTS)


def append_regions(*tables: DataFrame) -> DataFrame:
    """Append per-region tables by column name; columns absent in one are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def read_workbook(spark: SparkSession, paths: str | list[str], sep: str = ",") -> DataFrame:
    """Second-program sheet saved as delimited text: types by position, then canonical names."""
    return read_delimited(spark, paths, schemas.WORKBOOK, sep)


def read_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma-separated lookup or earlier result table with NA for missing."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Vertex table -> one ring per polygon, vertices in order of ``seq``."""
    return rings_from_vertices(spark.read.schema(schemas.VERTICES).parquet(path))


def rings_from_vertices(vertices: DataFrame) -> DataFrame:
    """A ring is one polygon's outline, so the collected list is the size of that outline."""
    ring = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    return vertices.groupBy("poly_id").agg(
        F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))


def read_draw_files(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    """Sampler output, one file per chain: ``#`` lines skipped, chain number from the file name.

    ``columns`` are the header names in file order; names like ``alpha.1.2`` come
    out as ``alpha[1,2]``. Each row carries ``chain`` and its ``iteration``: the
    position of the row in its file, counted over the file's byte blocks.
    """
    schema = ", ".join(f"`{c}` double" for c in columns)
    raw = (spark.read.schema(schema).option("header", True).option("comment", "#")
           .option("enforceSchema", True).csv(paths))
    renamed = raw.toDF(*[bracketed(c) for c in columns])
    name = F.col("_metadata.file_name")
    tagged = raw.select("*", F.regexp_extract(name, r"([0-9]+)\.csv", 1).cast("int").alias("chain"),
                        F.col("_metadata.file_block_start").alias("__block"),
                        F.monotonically_increasing_id().alias("__row"))
    out = tagged.toDF(*renamed.columns, "chain", "__block", "__row")
    # a block is one read split, so its order stays within one task of bounded size
    block = Window.partitionBy("chain", "__block").orderBy("__row")
    sizes = out.groupBy("chain", "__block").agg(F.count(F.lit(1)).alias("__size"))
    earlier = Window.partitionBy("chain").orderBy("__block")
    offsets = sizes.select("chain", "__block", (F.sum("__size").over(earlier) - F.col("__size")).alias("__off"))
    return (out.withColumn("__at", F.row_number().over(block)).join(offsets, ["chain", "__block"])
            .withColumn("iteration", (F.col("__off") + F.col("__at")).cast("int"))
            .select(*renamed.columns, "chain", "iteration"))


def bracketed(name: str) -> str:
    """``alpha.1.2`` -> ``alpha[1,2]``."""
    base, *index = name.split(".")
    return f"{base}[{','.join(index)}]" if index else base


def read_available(spark: SparkSession, path: str, species: DataFrame, key: str = "species") -> DataFrame:
    """Partitioned table restricted to the listed species; species without data just do not appear."""
    return spark.read.parquet(path).join(species.select(key).distinct(), key, "left_semi")
