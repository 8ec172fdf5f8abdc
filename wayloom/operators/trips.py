"""Endpoints, filters, segments, speeds, sampling and tokens of trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.functions.region import FIRST_TOKEN, UNKNOWN_TOKEN, Region
from wayloom.operators.sequences import numbered_within
from wayloom.plans.lineage import cut


def scope(trips: DataFrame, month: int, days: tuple[int, int], hours: tuple[int, int] = (0, 24)) -> DataFrame:
    """Trips of a month and closed day range that start in a closed hour range. On a table partitioned by month and day only those folders are read."""
    return trips.where((F.col("month") == month) & F.col("day").between(*days) & F.col("start_sec").between(hours[0] * 3600, hours[1] * 3600))


def endpoints(trips: DataFrame) -> DataFrame:
    """Two rows a trip: (trip_key, month, day, flag, lon, lat, sec), flag 0 the origin and 1 the destination. No shuffle."""
    ends = F.array(*[F.struct(F.lit(k).alias("flag"), F.col(f"{e}_lon").alias("lon"), F.col(f"{e}_lat").alias("lat"), F.col(f"{e}_sec").alias("sec")) for k, e in enumerate("od")])
    return trips.select("trip_key", "month", "day", F.explode(ends).alias("e")).select("trip_key", "month", "day", "e.*")


def endpoints_in_region(trips: DataFrame, region: Region) -> DataFrame:
    return endpoints(trips).where(region.contains(F.col("lon"), F.col("lat")))


def within_rectangle(trips: DataFrame, lon_a: float, lat_a: float, lon_b: float, lat_b: float) -> DataFrame:
    """Trips with both ends in the closed rectangle of two opposite corners, in any order."""
    inside = F.lit(True)
    for e in "od":
        inside &= F.col(f"{e}_lon").between(geo.lit(min(lon_a, lon_b)), geo.lit(max(lon_a, lon_b))) & F.col(f"{e}_lat").between(geo.lit(min(lat_a, lat_b)), geo.lit(max(lat_a, lat_b)))
    return trips.where(inside)


def od_pairs(trips: DataFrame, month: int, days: tuple[int, int], hours: tuple[int, int], end_hours: bool = True) -> DataFrame:
    """Trips in scope with both ends in the region and, with end_hours, ending in the hour range too."""
    kept = scope(trips, month, days, hours).where("od_in_region")
    return kept.where(F.col("end_sec").between(hours[0] * 3600, hours[1] * 3600)) if end_hours else kept


def clip(trips: DataFrame, region: Region, least: int, most: int) -> DataFrame:
    """Points inside the region only; trips need least to most points before and after."""
    kept = trips.where(F.size("points").between(least, most)).withColumn("points", F.filter("points", lambda p: region.contains(p["lon"], p["lat"])))
    return kept.where(F.size("points").between(least, most))


def segments(trips: DataFrame) -> DataFrame:
    """A row for each pair of consecutive points: seq from 0, both points, metres, speed and level. Made within the trip's row, without a shuffle."""
    zipped = F.arrays_zip(F.expr("slice(points, 1, size(points) - 1)").alias("a"), F.expr("slice(points, 2, size(points) - 1)").alias("b"))
    rows = trips.select("trip_key", "month", "day", F.posexplode(zipped).alias("seq", "s"))
    rows = rows.select("trip_key", "month", "day", "seq", *[F.col(f"s.{p}.{c}").alias(f"{c}_{p}") for p in "ab" for c in ("lon", "lat", "sec")])
    dist = geo.metres(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))
    rows = rows.withColumn("metres", dist).withColumn("seconds", F.col("sec_b") - F.col("sec_a")).withColumn("speed", geo.speed_kmh(F.col("metres"), F.col("seconds")))
    return rows.withColumn("level", geo.speed_level(F.col("speed")))


def speed_summary(trips: DataFrame) -> DataFrame:
    """trip_key, displacement_speed (between the ends), mean, min and max segment speed and the levels in order. Segments without time count in no figure and have no level. All stands in the trip's row; nothing is shuffled."""

    def speed(a: Column, b: Column) -> Column:
        return geo.speed_kmh(geo.metres(a["lon"], a["lat"], b["lon"], b["lat"]), b["sec"] - a["sec"])

    rest = F.expr("slice(points, 2, greatest(size(points) - 1, 0))")
    speeds = F.filter(F.transform(rest, lambda b, i: speed(F.get("points", i), b)), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate("speeds", F.lit(0.0), lambda t, x: t + x), F.size("speeds"))
    levels = F.array_join(F.transform("speeds", lambda x: geo.speed_level(x).cast("string")), ",")
    straight = geo.speed_kmh(geo.metres(F.col("o_lon"), F.col("o_lat"), F.col("d_lon"), F.col("d_lat")), F.col("end_sec") - F.col("start_sec"))
    rows = trips.where(F.size("points") > 1).select("trip_key", straight.alias("displacement_speed"), speeds.alias("speeds"))
    return rows.select("trip_key", "displacement_speed", mean.alias("mean_segment_speed"), F.array_min("speeds").alias("min_speed"), F.array_max("speeds").alias("max_speed"), levels.alias("levels"))


def stride(trips: DataFrame, step: int) -> DataFrame:
    """Every step-th trip by idx."""
    return trips.where(F.col("idx") % step == 0)


def tokens(trips: DataFrame, region: Region, vocabulary: DataFrame | None = None) -> DataFrame:
    """trip_key and tokens: each point's vocabulary id, UNKNOWN_TOKEN outside the region or for a cell without one.

    Without a vocabulary (cell, id) a cell's id is FIRST_TOKEN + cell and the trip's row suffices. A vocabulary has at most a row for each cell of the region, so it is broadcast when the grid is small.
    """
    cell = lambda p: region.cell_inside(p["lon"], p["lat"])
    if vocabulary is None:
        return trips.select("trip_key", F.transform("points", lambda p: F.coalesce(cell(p) + FIRST_TOKEN, F.lit(UNKNOWN_TOKEN))).alias("tokens"))
    if region.cells <= 100_000:  # one row with the id of every cell, read by place
        frame = trips.sparkSession.range(region.cells).select(F.col("id").alias("cell")).join(vocabulary.select("cell", "id"), "cell", "left")
        ids = frame.agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "id"))), lambda x: x["id"]).alias("ids"))
        return trips.join(F.broadcast(ids)).select("trip_key", F.transform("points", lambda p: F.coalesce(F.get("ids", cell(p)), F.lit(UNKNOWN_TOKEN))).alias("tokens"))
    rows = trips.select("trip_key", F.posexplode(F.transform("points", cell)).alias("seq", "cell"))
    named = rows.join(vocabulary.select("cell", "id"), "cell", "left")
    return named.groupBy("trip_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("id", F.lit(UNKNOWN_TOKEN)).alias("id")))), lambda x: x["id"]).alias("tokens"))


def collapse(values: Column) -> Column:
    """An array without elements equal to the one before."""
    return F.filter(values, lambda x, i: (i == 0) | (x != F.get(values, i - 1)))


def split_train(rows: DataFrame, order: list[str], day: tuple[str, ...] = ("month", "day")) -> DataFrame:
    """part: the first 80 % (rounded down) of each day's rows train, the next 10 % valid, the rest test, in a stated order. Rows are numbered over all days, so a busy day is no single task."""
    placed = cut(numbered_within(rows, list(day), [F.col(c) for c in order], "r"))
    sizes = placed.groupBy(*day).agg(F.count("*").alias("of_day"))
    first, second = F.floor(F.col("of_day") * 8 / 10), F.floor(F.col("of_day") / 10)
    part = F.when(F.col("r") < first, "train").when(F.col("r") < first + second, "valid").otherwise("test")
    return placed.join(F.broadcast(sizes), list(day)).withColumn("part", part).select(*rows.columns, "part")


def noise(trips: DataFrame, variants: int = 16, keep_percent: int = 60, reach_m: int = 30, shift_s: int = 900) -> DataFrame:
    """variants noisy copies of every point: (trip_key, variant, seq, kept, dx, dy, sec).

    Ends are kept; other points with keep_percent in a hundred. dx and dy are shifts in metres up to reach_m, sec is shifted by up to shift_s round midnight. All come from arithmetic on day, user, place and variant, so a run repeats.
    """
    rows = trips.select("trip_key", "user_id", "day", "n", F.posexplode("points").alias("seq", "p")).withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    h = F.col("user_id") * 7919 + F.col("day") * 104729 + F.col("seq") * 1299709 + F.col("variant") * 15485863
    part = lambda k, m: (h * k + 11) % m
    return rows.select(
        "trip_key", "variant", "seq", ((F.col("seq") == 0) | (F.col("seq") == F.col("n") - 1) | (part(31, 101) < keep_percent)).alias("kept"),
        (part(37, 2 * reach_m + 1) - reach_m).cast("int").alias("dx"), (part(41, 2 * reach_m + 1) - reach_m).cast("int").alias("dy"),
        F.pmod(F.col("p.sec") + part(43, 2 * shift_s + 1) - shift_s, F.lit(86400)).cast("int").alias("sec"),
    )


def padded(rows: DataFrame, tokens_of: str = "tokens", pad: int = 0) -> DataFrame:
    """tokens filled up with pad to the longest of all rows, and the length before. The longest is one number, joined as a broadcast of one row."""
    most = rows.agg(F.max(F.size(tokens_of)).alias("most"))
    return rows.withColumn("length", F.size(tokens_of)).join(F.broadcast(most)).withColumn(tokens_of, F.concat(F.col(tokens_of).cast("array<long>"), F.array_repeat(F.lit(pad).cast("long"), F.col("most") - F.col("length")))).drop("most")


def gis_rows(trips: DataFrame) -> DataFrame:
    """Lines for a map: two rows for each segment, (line_name, index, lon, lat)."""
    s = segments(trips)
    both = F.array(F.struct(F.lit(0).alias("end"), F.col("lon_a").alias("lon"), F.col("lat_a").alias("lat")), F.struct(F.lit(1).alias("end"), F.col("lon_b").alias("lon"), F.col("lat_b").alias("lat")))
    return s.select(F.concat_ws("_", "trip_key", "seq").alias("line_name"), (F.col("seq") * 2).alias("twice"), F.explode(both).alias("e")).select("line_name", (F.col("twice") + F.col("e.end")).cast("int").alias("index"), "e.lon", "e.lat")


def bounds(trips: DataFrame) -> DataFrame:
    """Bounding box of all points, from each trip's own extremes."""
    lon, lat = F.transform("points", lambda p: p["lon"]), F.transform("points", lambda p: p["lat"])
    return trips.agg(F.min(F.array_min(lon)).alias("min_lon"), F.max(F.array_max(lon)).alias("max_lon"), F.min(F.array_min(lat)).alias("min_lat"), F.max(F.array_max(lat)).alias("max_lat"))


def lookup(trips: DataFrame, keys: DataFrame) -> DataFrame:
    """The trips whose trip_key is among keys."""
    return trips.join(keys.select("trip_key").distinct(), "trip_key", "left_semi")


def repeated_keys(ends: DataFrame, least: int = 2, most: int = 500) -> DataFrame:
    """(trip_key, n, first_sec, last_sec) of the first most trips, by trip_key, that have at least least endpoints."""
    tally = ends.groupBy("trip_key").agg(F.count("*").alias("n"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))
    return tally.where(F.col("n") >= least).orderBy("trip_key").limit(most)


def in_place_order(ends: DataFrame) -> DataFrame:
    """Endpoints by lon, then lat, then key."""
    return ends.orderBy("lon", "lat", "trip_key", "flag")


def nearest_centre(points: DataFrame, centres: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """(key, cell): the centre (cell, lon, lat) least far in squared degrees, ties to the least cell. The centres, at most most, stand in one broadcast row."""
    if centres.count() > most:
        raise ValueError("too many centres for one row; use poi.nearest")
    one = centres.agg(F.sort_array(F.collect_list(F.struct("cell", "lon", "lat"))).alias("centres"))
    square = F.transform("centres", lambda c: F.struct(((c["lon"] - F.col("lon")) * (c["lon"] - F.col("lon")) + (c["lat"] - F.col("lat")) * (c["lat"] - F.col("lat"))).alias("s"), c["cell"].alias("cell")))
    return points.join(F.broadcast(one)).select(key, F.array_min(square)["cell"].alias("cell"))
