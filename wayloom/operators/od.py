"""Counts over days, hours and slices, and flows between cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.functions.region import Region


def daily_counts(trips: DataFrame, month: int, days: int = 31) -> DataFrame:
    """(day, trips) for each day of a month, days without trips too."""
    spark = trips.sparkSession
    seen = trips.where(F.col("month") == month).groupBy("day").agg(F.count("*").alias("trips"))
    return spark.range(1, days + 1).select(F.col("id").cast("int").alias("day")).join(seen, "day", "left").select("day", F.coalesce("trips", F.lit(0)).alias("trips"))


def hourly_counts(trips: DataFrame, month: int, days: tuple[int, int]) -> DataFrame:
    """(hour, trips) over a closed day range by start hour, 24 rows."""
    spark = trips.sparkSession
    seen = trips.where((F.col("month") == month) & F.col("day").between(*days)).groupBy(geo.hour_of(F.col("start_sec")).alias("hour")).agg(F.count("*").alias("trips"))
    return spark.range(24).select(F.col("id").cast("int").alias("hour")).join(seen, "hour", "left").select("hour", F.coalesce("trips", F.lit(0)).alias("trips"))


def flow(pairs: DataFrame) -> DataFrame:
    """(o_cell, d_cell, flow) of trips with both ends in the region; partial sums before the shuffle, so a busy pair is one row from each task."""
    return pairs.where("od_in_region").groupBy("o_cell", "d_cell").agg(F.count("*").alias("flow"))


def top_flow(flows: DataFrame, k: int) -> DataFrame:
    """The k greatest flows, ties by cells."""
    return flows.orderBy(F.desc("flow"), "o_cell", "d_cell").limit(k)


def hot_endpoints(pairs: DataFrame, bound: int) -> DataFrame:
    """trip_key and cells of each trip after the first bound of its pair, by trip_key: those that find the pair hot."""
    own = Window.partitionBy("o_cell", "d_cell").orderBy("trip_key")
    rows = pairs.where("od_in_region").select("trip_key", "o_cell", "d_cell")
    if bound < 1:
        return rows
    # the first ones are limited within each task before the shuffle, so a busy pair sends bound rows from each
    first = rows.withColumn("seen", F.row_number().over(own)).where(F.col("seen") <= bound)
    return rows.join(first.select("trip_key"), "trip_key", "left_anti")


def cells_used(flows: DataFrame) -> DataFrame:
    return flows.select(F.explode(F.array("o_cell", "d_cell")).alias("cell")).distinct()


def heat(pairs: DataFrame, o_cells: list[int], d_cells: list[int], month: int, last_day: int, days: int) -> DataFrame:
    """(day, hour, trips) from some cells to others over the last days days, every hour of them."""
    spark = pairs.sparkSession
    first = last_day - days + 1
    seen = pairs.where((F.col("month") == month) & F.col("day").between(first, last_day) & F.col("o_cell").isin(o_cells) & F.col("d_cell").isin(d_cells) & F.col("od_in_region"))
    seen = seen.groupBy("day", geo.hour_of(F.col("start_sec")).alias("hour")).agg(F.count("*").alias("trips"))
    frame = spark.range(days * 24).select((F.floor(F.col("id") / 24) + first).cast("int").alias("day"), (F.col("id") % 24).cast("int").alias("hour"))
    return frame.join(seen, ["day", "hour"], "left").select("day", "hour", F.coalesce("trips", F.lit(0)).alias("trips"))


def slices(pairs: DataFrame, region: Region, same_slice: bool = False) -> DataFrame:
    """(slice, o_cell, d_cell, flow): slices of the month, counted from its first day, by start time; same_slice drops trips that end in another."""
    per_day = 86400 // region.time_step
    kept = pairs.where("od_in_region")
    if same_slice:
        kept = kept.where(region.slice(F.col("o_sec")) == region.slice(F.col("d_sec")))
    at = ((F.col("day") - 1) * per_day + region.slice(F.col("o_sec"))).cast("long")
    return kept.groupBy(at.alias("slice"), "o_cell", "d_cell").agg(F.count("*").alias("flow"))


def dense_slices(flows: DataFrame, first: int, last: int, cells: list[int]) -> DataFrame:
    """Every (slice, o_cell, d_cell) of a slice range and some cells, flow 0 where there is none; meant for export, its size is the product of the ranges."""
    spark = flows.sparkSession
    n = len(cells)
    ids = F.array(*[F.lit(c) for c in cells])
    frame = spark.range((last - first + 1) * n * n).select((F.floor(F.col("id") / (n * n)) + first).alias("slice"), F.element_at(ids, (F.floor(F.col("id") / n) % n + 1).cast("int")).cast("long").alias("o_cell"), F.element_at(ids, (F.col("id") % n + 1).cast("int")).cast("long").alias("d_cell"))
    kept = flows.where(F.col("slice").between(first, last))
    return frame.join(kept, ["slice", "o_cell", "d_cell"], "left").withColumn("flow", F.coalesce("flow", F.lit(0)))


def history(flows: DataFrame, first: int, last: int) -> DataFrame:
    """(o_cell, d_cell, history): flow in each slice of a range, in order, as one array."""
    kept = flows.where(F.col("slice").between(first, last)).groupBy("o_cell", "d_cell").agg(F.map_from_entries(F.collect_list(F.struct("slice", "flow"))).alias("m"))
    return kept.select("o_cell", "d_cell", F.transform(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")), lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0).cast("long"))).alias("history"))


def grid_rows(dense: DataFrame, region: Region, first: int, cells: list[int]) -> DataFrame:
    """The export form of dense_slices from first on over cells: dyna_id (the row's number, by its slice and cells), type, time, row and column ids, flow."""
    place = lambda c: F.array_position(F.array(*[F.lit(x).cast("long") for x in sorted(cells)]), F.col(c)) - 1
    number = ((F.col("slice") - first) * len(cells) + place("o_cell")) * len(cells) + place("d_cell")
    step = 86400 // region.time_step
    sec = (F.col("slice") % step) * region.time_step
    row, col = lambda c: F.floor(F.col(c) / region.num_x).cast("int"), lambda c: (F.col(c) % region.num_x).cast("int")
    return dense.select(number.cast("long").alias("dyna_id"), F.lit("state").alias("type"), F.concat(F.lpad((F.floor(F.col("slice") / step) + 1).cast("string"), 2, "0"), F.lit("T"), geo.clock(sec)).alias("time"), row("o_cell").alias("origin_row_id"), col("o_cell").alias("origin_column_id"), row("d_cell").alias("destination_row_id"), col("d_cell").alias("destination_column_id"), "flow")


def cell_points(ends: DataFrame, region: Region) -> DataFrame:
    """Endpoints in the region with their cell: the long form of the cell-to-points and point-to-cell maps."""
    return ends.where(region.contains(F.col("lon"), F.col("lat"))).withColumn("cell", region.cell(F.col("lon"), F.col("lat")))


def adjacency(flows: DataFrame, out: bool = True) -> DataFrame:
    """(cell, neighbours): cells reached from (or reaching) each cell, sorted."""
    a, b = ("o_cell", "d_cell") if out else ("d_cell", "o_cell")
    return flows.groupBy(F.col(a).alias("cell")).agg(F.sort_array(F.collect_set(b)).alias("neighbours"))


def centres(points: DataFrame, by: str = "cell") -> DataFrame:
    """Mean lon and lat of each cluster's points."""
    return points.groupBy(by).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count("*").alias("n"))


def cluster_degree(flows: DataFrame) -> DataFrame:
    """(cell, out_degree, in_degree, out_flow, in_flow)."""
    ends = flows.select(F.explode(F.array(F.struct(F.col("o_cell").alias("cell"), F.lit(1).alias("o"), F.lit(0).alias("i"), "flow"), F.struct(F.col("d_cell").alias("cell"), F.lit(0).alias("o"), F.lit(1).alias("i"), "flow"))).alias("e")).select("e.*")
    return ends.groupBy("cell").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum(F.col("o") * F.col("flow")).alias("out_flow"), F.sum(F.col("i") * F.col("flow")).alias("in_flow"))


def cluster_history(pairs: DataFrame) -> DataFrame:
    """(cell, day, out_flow, in_flow)."""
    ends = pairs.where("od_in_region").select("day", F.explode(F.array(F.struct(F.col("o_cell").alias("cell"), F.lit(1).alias("o")), F.struct(F.col("d_cell").alias("cell"), F.lit(0).alias("o")))).alias("e")).select("day", "e.*")
    return ends.groupBy("cell", "day").agg(F.sum("o").alias("out_flow"), F.sum(F.lit(1) - F.col("o")).alias("in_flow"))


def hot_grid_graph(pairs: DataFrame, bound: int) -> DataFrame:
    """(o_cell, d_cell, flow) of the hot endpoints only: trips of a pair beyond its first bound."""
    return hot_endpoints(pairs, bound).groupBy("o_cell", "d_cell").agg(F.count("*").alias("flow"))


def hot_flow(pairs: DataFrame, hot: list[int], shift: int = 0) -> DataFrame:
    """(o_cell, d_cell, flow) of trips with both cells among hot, cell ids lessened by shift."""
    kept = pairs.where(F.col("od_in_region") & F.col("o_cell").isin(hot) & F.col("d_cell").isin(hot))
    return kept.groupBy((F.col("o_cell") - shift).alias("o_cell"), (F.col("d_cell") - shift).alias("d_cell")).agg(F.count("*").alias("flow"))


def only_pairs(flows: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """flows of the OD pairs (o_cell, d_cell) in pairs; all where pairs is None."""
    return flows if pairs is None else flows.join(pairs.select("o_cell", "d_cell").distinct(), ["o_cell", "d_cell"], "left_semi")


def first_masked(flows: DataFrame, mask: DataFrame, most: int = 1000, cells: int = 100) -> DataFrame:
    """(number, o_cell, d_cell): the first most pairs of mask by o_cell * cells + d_cell that have a flow."""
    some = only_pairs(mask.select("o_cell", "d_cell").distinct(), flows.where("flow > 0"))
    at = F.col("o_cell") * cells + F.col("d_cell")
    return some.orderBy(at).limit(most).withColumn("number", F.row_number().over(Window.orderBy(at)) - 1).select("number", "o_cell", "d_cell")


def slice_flows(flows: DataFrame, at: int, mask: DataFrame | None = None) -> DataFrame:
    """(o_cell, d_cell, flow) of one slice, positive flows of masked pairs only."""
    return only_pairs(flows.where((F.col("slice") == at) & (F.col("flow") > 0)), mask).select("o_cell", "d_cell", "flow")


def sliding_history(flows: DataFrame, first: int, last: int, width: int = 767) -> DataFrame:
    """(slice, o_cell, d_cell, flow, history): for every slice of a range of each pair that has a flow, its flow and those of the width slices before, the oldest first, 0 where there is none."""
    kept = flows.where(F.col("slice").between(first - width, last)).groupBy("o_cell", "d_cell").agg(F.collect_list(F.struct("slice", "flow")).alias("f"))
    # one dense array for each pair, of which every slice's history is a part
    span = last - first + width + 1
    filled = F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda k: F.coalesce(F.try_element_at(F.map_from_entries(F.transform("f", lambda x: F.struct((x["slice"] - (first - width)).cast("int"), x["flow"]))), k), F.lit(0).cast("long")))
    rows = kept.select("o_cell", "d_cell", filled.alias("dense")).select("o_cell", "d_cell", "dense", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("slice"))
    at = (F.col("slice") - first).cast("int")
    return rows.select("slice", "o_cell", "d_cell", F.get("dense", at + width).alias("flow"), F.slice("dense", at + 1, width).alias("history"))


def flow_totals(grid: DataFrame) -> DataFrame:
    """(rows, flow): number of rows and sum of the flow column of an export."""
    return grid.agg(F.count("*").alias("rows"), F.coalesce(F.sum("flow"), F.lit(0)).alias("flow"))


def pair_of(index: Column, cells: int = 100) -> tuple[Column, Column]:
    """Origin and destination cell of a flattened pair index."""
    return F.floor(index / cells).cast("long"), (index % cells).cast("long")
