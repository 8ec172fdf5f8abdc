"""Deterministic projections of the driver's tables into trajectories, points of interest and features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions.geo import lit
from wayloom.functions.region import Region
from wayloom.operators.sequences import numbered_within
from wayloom.sources.tables import trips_from_points

REGION = Region()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fix_place(of: Callable[[str], Column]) -> tuple[Column, Column]:
    """lon and lat of a fix, whose columns of finds by name."""
    e, u = of("event_id"), of("user_id")
    return lit(120.1) + ((e * 7919 + u * 104729) % 10000).cast("double") * lit(0.00001), lit(30.2275) + ((e * 6271 + u * 15485863) % 10000).cast("double") * lit(0.000008)


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fix for each event."""
    ts, (lon, lat) = F.col("ts"), fix_place(F.col)
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("int").alias("sec"),
        lon.alias("lon"), lat.alias("lat"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips_from_points(gps(spark, sf_dir), REGION, place=fix_place)


def numbered_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips with idx, their number within the day by user."""
    return numbered_within(trips(spark, sf_dir), ["month", "day"], [F.col("user_id")], "idx")


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(p.alias("poi_id"), F.col("p_type").alias("category"), (lit(120.1) + (p * 7919 % 10000).cast("double") * lit(0.00001)).alias("lon"), (lit(30.2275) + (p * 6271 % 10000).cast("double") * lit(0.000008)).alias("lat"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("feature"), "label")
