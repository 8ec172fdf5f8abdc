"""A rectangular study region with a Mercator grid and time slices, compiled into Column expressions."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import geo

# fixed values: the default study region and its cell size in metres
DEFAULT_BOX = (120.1088, 30.2335, 120.1922, 30.3015)
DEFAULT_STEPS = (9284.045532159507 / 10, 8765 / 10)
UNKNOWN_TOKEN = 3
FIRST_TOKEN = 4


@dataclass(frozen=True)
class Region:
    """lon/lat box, cell sizes in metres, start and length of time slices in seconds."""

    min_lon: float = DEFAULT_BOX[0]
    min_lat: float = DEFAULT_BOX[1]
    max_lon: float = DEFAULT_BOX[2]
    max_lat: float = DEFAULT_BOX[3]
    x_step: float = DEFAULT_STEPS[0]
    y_step: float = DEFAULT_STEPS[1]
    time_start: int = 0
    time_step: int = 900

    @classmethod
    def around(cls, lon: float, lat: float, width_m: float, height_m: float, **kw) -> Region:
        """The box of the given size in metres about a centre."""
        x, y = geo.easting_of(lon), geo.northing_of(lat)
        back = lambda v: math.degrees(math.asin(math.tanh(v / geo.RADIUS)))
        return cls((x - width_m / 2) / geo.RADIUS / geo.RADIAN, back(y - height_m / 2), (x + width_m / 2) / geo.RADIUS / geo.RADIAN, back(y + height_m / 2), **kw)

    @cached_property
    def min_x(self) -> float:
        return geo.easting_of(self.min_lon)

    @cached_property
    def min_y(self) -> float:
        return geo.northing_of(self.min_lat)

    @cached_property
    def num_x(self) -> int:
        return math.ceil(round(geo.easting_of(self.max_lon) - self.min_x, 6) / self.x_step)

    @cached_property
    def num_y(self) -> int:
        return math.ceil(round(geo.northing_of(self.max_lat) - self.min_y, 6) / self.y_step)

    @property
    def cells(self) -> int:
        return self.num_x * self.num_y

    def contains(self, lon: Column, lat: Column) -> Column:
        """Closed box test."""
        return lon.between(geo.lit(self.min_lon), geo.lit(self.max_lon)) & lat.between(geo.lit(self.min_lat), geo.lit(self.max_lat))

    def contains_at(self, lon: Column, lat: Column, sec: Column, first: int = 0, last: int = 86400) -> Column:
        """Closed box and time test."""
        return self.contains(lon, lat) & sec.between(first, last)

    def polygon_time_cell(self, polygon: Column, polygons: int, sec: Column) -> Column:
        """Id of a polygon and slice: the slice times the number of polygons, plus the polygon."""
        return self.slice(sec) * F.lit(polygons).cast("long") + polygon.cast("long")

    def cell(self, lon: Column, lat: Column) -> Column:
        """Row-major cell id, also for points outside (which may fall beyond the grid)."""
        y = F.floor(F.round(geo.northing(lat) - geo.lit(self.min_y), 6) / geo.lit(self.y_step))
        x = F.floor(F.round(geo.easting(lon) - geo.lit(self.min_x), 6) / geo.lit(self.x_step))
        return (y * F.lit(self.num_x) + x).cast("long")

    def cell_inside(self, lon: Column, lat: Column) -> Column:
        """Cell id, NULL outside the region."""
        return F.when(self.contains(lon, lat), self.cell(lon, lat))

    def slice(self, sec: Column) -> Column:
        """Time slice from time_start on, round midnight."""
        return F.floor(F.pmod(sec - F.lit(self.time_start), F.lit(86400)) / F.lit(self.time_step)).cast("long")

    def space_time_cell(self, lon: Column, lat: Column, sec: Column) -> Column:
        return self.slice(sec) * F.lit(self.cells).cast("long") + self.cell(lon, lat)

    def cell_x(self, cell: Column) -> Column:
        return geo.lit(self.min_x) + (cell % self.num_x + geo.lit(0.5)) * geo.lit(self.x_step)

    def cell_y(self, cell: Column) -> Column:
        return geo.lit(self.min_y) + (F.floor(cell / self.num_x) + geo.lit(0.5)) * geo.lit(self.y_step)

    def unit_centre(self, cell: Column) -> tuple[Column, Column]:
        """Centre of a cell as shares (0 to 1) of the region's width and height."""
        width, height = geo.easting_of(self.max_lon) - self.min_x, geo.northing_of(self.max_lat) - self.min_y
        return (self.cell_x(cell) - geo.lit(self.min_x)) / geo.lit(width), (self.cell_y(cell) - geo.lit(self.min_y)) / geo.lit(height)

    def centres(self, spark: SparkSession) -> DataFrame:
        """cell, lon, lat of every cell's centre."""
        c = F.col("cell")
        return spark.range(self.cells).select(F.col("id").alias("cell")).select("cell", geo.longitude(self.cell_x(c)).alias("lon"), geo.latitude(self.cell_y(c)).alias("lat"))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Region:
        return cls(**json.loads(text))
