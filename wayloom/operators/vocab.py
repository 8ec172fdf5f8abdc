"""Cell vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions.region import FIRST_TOKEN, Region
from wayloom.plans.lineage import cut


def cell_counts(points: DataFrame, region: Region) -> DataFrame:
    """(cell, n) of points in the region."""
    inside = points.where(region.contains(F.col("lon"), F.col("lat")))
    return inside.groupBy(region.cell(F.col("lon"), F.col("lat")).alias("cell")).agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame, most: int, least_count: int, drop_first: bool = False) -> DataFrame:
    """(cell, n, id) of the most frequent cells with at least least_count points; id from FIRST_TOKEN by count, then cell. drop_first leaves out the most frequent one."""
    top = counts.where(F.col("n") >= least_count).orderBy(F.desc("n"), "cell").limit(most)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "cell")) - 1
    out = top.withColumn("r", rank)
    if drop_first:
        out = out.where("r > 0").withColumn("r", F.col("r") - 1)
    return out.select("cell", "n", (F.col("r") + FIRST_TOKEN).cast("int").alias("id"))


def nearest_hot(cells: DataFrame, hot: DataFrame, region: Region, k: int, skip_self: bool = True) -> DataFrame:
    """(cell, neighbour, rank, square): the k nearest hot cells of each cell in grid steps, ties by cell; a hot cell skips itself.

    Squares of cells that grow from round to round: a cell meets the hot ones of its 3 x 3 squares, an equi-join, and is done when k of them lie within one square's width; the others go on with squares twice as wide, until one covers the grid.
    """
    xy = lambda c: ((F.col(c) % region.num_x).alias("x"), F.floor(F.col(c) / region.num_x).alias("y"))
    left = cut(cells.select("cell", *xy("cell")))
    side = cut(hot.select(F.col("cell").alias("neighbour"), *[c.alias(f"h{n}") for c, n in zip(xy("cell"), "xy", strict=True)]))
    n, own, out = side.count(), Window.partitionBy("cell").orderBy("square", "neighbour"), None
    width = max(1, round((region.cells * (k + 1) / max(n, 1)) ** 0.5))
    while True:
        last = width >= max(region.num_x, region.num_y)
        square = lambda c: F.floor(F.col(c) / width)  # noqa: B023, E731
        a = left.withColumn("i", F.explode(F.sequence(square("x") - 1, square("x") + 1))).withColumn("j", F.explode(F.sequence(square("y") - 1, square("y") + 1)))
        b = side.withColumn("i", square("hx")).withColumn("j", square("hy"))
        met = a.join(b, ["i", "j"]).where(F.col("cell") != F.col("neighbour") if skip_self else F.lit(True))
        dx, dy = F.col("x") - F.col("hx"), F.col("y") - F.col("hy")
        near = met.select("cell", "neighbour", (dx * dx + dy * dy).cast("long").alias("square")).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
        if last:
            return near if out is None else out.unionByName(near)
        near = cut(near)
        done = near.groupBy("cell").agg(F.count("*").alias("n"), F.max("square").alias("far")).where((F.col("n") == k) & (F.col("far") <= width * width)).select("cell")
        near = near.join(done, "cell", "left_semi")
        out = near if out is None else out.unionByName(near)
        left = cut(left.join(done, "cell", "left_anti"))
        if left.isEmpty():
            return out
        width *= 2


def cell_to_id(cells: DataFrame, vocab: DataFrame, region: Region) -> DataFrame:
    """(cell, id): a cell's own id or that of the nearest hot cell."""
    own = cells.select("cell").distinct().join(vocab.select("cell", "id"), "cell", "left")
    missing = own.where("id is null").select("cell")
    near = nearest_hot(missing, vocab, region, 1, False).join(vocab.select(F.col("cell").alias("neighbour"), F.col("id").alias("near_id")), "neighbour").select("cell", "near_id")
    return own.join(near, "cell", "left").select("cell", F.coalesce("id", "near_id").alias("id"))
