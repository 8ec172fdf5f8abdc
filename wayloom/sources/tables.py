"""Stored trips, points of interest and exports: Parquet by default, CSV, text, JDBC and JSON columns where the data come so."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions.region import Region
from wayloom.sources.schema import POI, POINT, TRIP


def trips_from_points(points: DataFrame, region: Region, key: tuple[str, ...] = ("user_id", "month", "day"), order: tuple[str, ...] = ("sec", "event_id"), least: int = 2, place: Callable[[Callable[[str], Column]], tuple[Column, Column]] | None = None) -> DataFrame:
    """Trips (schema TRIP but for idx) from one row for each GPS fix: one shuffle on the trip's key.

    Origin and destination stand on the trip's row, so that later filters on them reach the scan and no join pairs them. Trips of fewer than least points are left out.
    Where lon and lat of a fix follow from columns of key and order, place states how, of a function that finds these by name; they are then computed behind the shuffle instead of going through it.
    """
    listed = F.sort_array(F.collect_list(F.struct(*order, *(("lon", "lat") if place is None else ()))))
    grouped = points.groupBy(*key).agg(listed.alias("listed")).where(F.size("listed") >= least)
    at = lambda p: (p["lon"], p["lat"]) if place is None else place(lambda c: F.col(c) if c in key else p[c])
    fix = lambda p: dict(zip(("lon", "lat", "sec"), (*at(p), p["sec"]), strict=True))
    first, last = fix(F.element_at("listed", 1)), fix(F.element_at("listed", -1))
    out = grouped.select(
        F.concat_ws("_", *key).alias("trip_key"), *key, F.size("listed").alias("n"), first["sec"].alias("start_sec"), last["sec"].alias("end_sec"),
        F.transform("listed", lambda p: F.struct(*[v.alias(c) for c, v in fix(p).items()])).alias("points"),
        *[p[c].alias(f"{e}_{c}") for e, p in (("o", first), ("d", last)) for c in ("lon", "lat", "sec")],
    )
    inside = region.contains(F.col("o_lon"), F.col("o_lat")) & region.contains(F.col("d_lon"), F.col("d_lat"))
    return out.withColumns({"o_cell": region.cell_inside(F.col("o_lon"), F.col("o_lat")), "d_cell": region.cell_inside(F.col("d_lon"), F.col("d_lat")), "od_in_region": inside})


def write_trips(trips: DataFrame, path: str) -> None:
    """One folder for each month and day, so that a scope reads only its days. A second write replaces the first."""
    trips.write.mode("overwrite").partitionBy("month", "day").parquet(path)


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIP).parquet(path)


def ingest_if_absent(spark: SparkSession, table: str, trips: DataFrame) -> bool:
    """Create a catalog table of trips unless it is there and has rows; tells whether it wrote."""
    database = table.rpartition(".")[0]
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    if spark.catalog.tableExists(table) and not spark.table(table).isEmpty():
        return False
    trips.write.mode("overwrite").partitionBy("month", "day").format("parquet").saveAsTable(table)
    return True


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def jdbc_trips(spark: SparkSession, url: str, table: str, month: int, days: tuple[int, int], **options: str) -> DataFrame:
    """Trips of a relational table with a JSON point list; the month and day predicate is pushed to the database, which is read with a connection for each day unless options say otherwise."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **({"partitionColumn": "date", "lowerBound": str(days[0]), "upperBound": str(days[1] + 1), "numPartitions": str(max(1, days[1] - days[0] + 1))} | options)).load()
    return decode_points(rows.where((F.col("month") == month) & F.col("date").between(*days)), F.col("point_list")).drop("point_list")


def decode_points(rows: DataFrame, json_column: Column) -> DataFrame:
    """rows with points from a JSON array of [lon, lat, sec]; NULL for what isn't such a list."""
    parsed = F.from_json(json_column, "array<array<double>>")
    return rows.withColumn("points", F.transform(parsed, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"), p[2].cast("int").alias("sec")).cast(POINT)))


def encode_points(points: Column) -> Column:
    """JSON array of [lon, lat, sec]."""
    return F.to_json(F.transform(points, lambda p: F.array(p["lon"], p["lat"], p["sec"].cast("double"))))


def read_poi(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(POI)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def write_csv(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    """CSV with a header; with partition_by a folder for each of its values (one sheet for each community)."""
    writer = rows.write.mode("overwrite").option("header", True)
    (writer.partitionBy(partition_by) if partition_by else writer).csv(path)


def write_token_lines(rows: DataFrame, tokens: str, path: str) -> None:
    """One line of space-separated token ids for each row."""
    rows.select(F.array_join(F.col(tokens).cast("array<string>"), " ").alias("value")).write.mode("overwrite").text(path)


def read_token_lines(spark: SparkSession, path: str, start: int = 1, end: int = 2) -> DataFrame:
    """tokens array<int> of each line, between a start and an end id."""
    return spark.read.text(path).select(F.concat(F.array(F.lit(start)), F.split("value", " ").cast("array<int>"), F.array(F.lit(end))).alias("tokens"))


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("dyna_id long, type string, time string, origin_row_id int, origin_column_id int, destination_row_id int, destination_column_id int, flow double").csv(path)


def grid_geo(spark: SparkSession, rows: int = 10, columns: int = 10) -> DataFrame:
    """geo_id, type, row_id, column_id of a grid."""
    return spark.range(rows * columns).select(F.col("id").alias("geo_id"), F.lit("Grid").alias("type"), F.floor(F.col("id") / columns).cast("int").alias("row_id"), (F.col("id") % columns).cast("int").alias("column_id"))


def trip_key(day: Column, index: Column) -> Column:
    """day_index as text."""
    return F.concat_ws("_", day, index)


def parts_of_key(key: Column) -> tuple[Column, Column]:
    """Day and index of a trip_key of two parts."""
    parts = F.split(key, "_")
    return F.get(parts, 0).cast("int"), F.get(parts, 1).cast("int")


def pair_of_name(name: Column, sep: str = "_") -> tuple[Column, Column]:
    """Origin and destination cell of a line-graph node's name."""
    parts = F.split(name, sep)
    return F.get(parts, 0).cast("long"), F.get(parts, 1).cast("long")


def row_count(spark: SparkSession, table: str) -> int:
    """Rows of a catalog table."""
    return spark.table(table).count()


def bootstrap(spark: SparkSession, table: str, trips: DataFrame) -> int:
    """Create the table of trips where it is absent; its rows."""
    ingest_if_absent(spark, table, trips)
    return row_count(spark, table)


def write_poi_index(poi: DataFrame, path: str, radius: float) -> None:
    """Points of interest by square of radius Mercator metres (bx, by), sorted within files, so that searches of that radius read few row groups."""
    from wayloom.functions import geo

    at = poi.withColumn("bx", F.floor(geo.easting(F.col("lon")) / geo.lit(radius)).cast("long")).withColumn("by", F.floor(geo.northing(F.col("lat")) / geo.lit(radius)).cast("long"))
    at.repartitionByRange("bx", "by").sortWithinPartitions("bx", "by", "poi_id").write.mode("overwrite").parquet(path)


def write_result(rows: DataFrame, path: str) -> None:
    """Keep a result (counts, heat, neighbours) as Parquet in place of what was there."""
    rows.write.mode("overwrite").parquet(path)


def empty_folder(spark: SparkSession, path: str) -> None:
    """Remove what is in a folder; the folder itself is there afterwards."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(target, True)
    system.mkdirs(target)


def within_bounds(poi: DataFrame, points: DataFrame) -> DataFrame:
    """Points of interest in the bounding box of points (lon, lat)."""
    box = points.agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    return poi.join(F.broadcast(box)).where(F.col("lon").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n"))).select(*poi.columns)
