"""Base tables and their current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = ("node", "way", "relation")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current(df: DataFrame, version: str, key: str = "id") -> DataFrame:
    """One row per key: the one with the highest version.

    A null version is below any other.  Rows of one key and version are repeats of one another; should they differ, the
    greatest row wins, so that the result doesn't depend on the order of the input.  Rows with a null key are dropped, as
    nothing can refer to them.
    """
    rest = [c for c in df.columns if c != key]
    packed = F.struct(F.col(version).alias("__v"), *[F.col(c) for c in rest])
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(packed).alias("__row"))
    return best.select(key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def current_locations(spark: SparkSession, folder: str) -> DataFrame:
    return current(read(spark, folder, "locations").select("id", "lon_i", "lat_i", "version"), "version")


def current_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return current(read(spark, folder, "nodes").select("id", "tags", "meta"), "meta.version")


def current_ways(spark: SparkSession, folder: str) -> DataFrame:
    return current(read(spark, folder, "ways").select("id", "nodes", "tags", "meta"), "meta.version")


def current_relations(spark: SparkSession, folder: str) -> DataFrame:
    return current(read(spark, folder, "relations").select("id", "members", "tags", "meta"), "meta.version")
