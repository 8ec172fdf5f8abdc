"""Spherical Mercator in metres, distances, speeds and clock times as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: sphere radius, half of it as the northing factor is stated, speed levels in km/h
RADIUS = 6378137.0
HALF_RADIUS = 3189068.5
RADIAN = 0.017453292519943295
SPEED_LEVELS = (20.0, 40.0, 60.0)


def lit(x: float) -> Column:
    return F.lit(float(x))


def easting(lon: Column) -> Column:
    return lit(RADIUS) * lon * lit(RADIAN)


def northing(lat: Column) -> Column:
    s = F.sin(lat * lit(RADIAN))
    return lit(HALF_RADIUS) * F.log((lit(1) + s) / (lit(1) - s))


def longitude(x: Column) -> Column:
    return x / lit(RADIUS) / lit(RADIAN)


def latitude(y: Column) -> Column:
    e = F.exp(y / lit(HALF_RADIUS))
    return F.asin((e - lit(1)) / (e + lit(1))) / lit(RADIAN)


def easting_of(lon: float) -> float:
    return RADIUS * lon * RADIAN


def northing_of(lat: float) -> float:
    s = math.sin(lat * RADIAN)
    return HALF_RADIUS * math.log((1 + s) / (1 - s))


def metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in Mercator metres."""
    dx, dy = easting(lon1) - easting(lon2), northing(lat1) - northing(lat2)
    return F.sqrt(dx * dx + dy * dy)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance, angles taken in radians."""
    a = F.pow(F.sin((lat2 - lat1) * lit(RADIAN / 2)), 2) + F.cos(lat1 * lit(RADIAN)) * F.cos(lat2 * lit(RADIAN)) * F.pow(F.sin((lon2 - lon1) * lit(RADIAN / 2)), 2)
    return lit(2 * RADIUS / 1000) * F.asin(F.sqrt(F.least(a, lit(1))))


def speed_kmh(dist: Column, seconds: Column) -> Column:
    """NULL where no time has passed."""
    return F.try_divide(dist * lit(3.6), seconds.cast("double"))


def speed_level(speed: Column) -> Column:
    """1 up to and with 20 km/h, 2 under 40, 3 under 60, else 4."""
    a, b, c = SPEED_LEVELS
    return F.when(speed <= a, 1).when(speed < b, 2).when(speed < c, 3).when(speed.isNotNull(), 4)


def clock(sec: Column) -> Column:
    """HH:MM:SS of seconds since midnight."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(sec / 3600)), two(F.floor(sec % 3600 / 60)), two(sec % 60))


def hour_of(sec: Column) -> Column:
    """Hour bucket 0 to 23; second 86400 counts to the last."""
    return F.least(F.floor(sec / 3600), F.lit(23)).cast("int")


def in_circular_range(start: int, end: int, t: Column) -> Column:
    """t in the closed range start..end, which may wrap round midnight."""
    return t.between(start, end) if start < end else (t >= start) | (t <= end)


def slice_angle(pos: Column, total: int) -> Column:
    """Angle of slice pos of total on a clock face, from twelve o'clock, clockwise."""
    return lit(math.pi) * (lit(0.5) - lit(2) * pos / lit(total))


def scale(value: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """value from low..high to to_low..to_high; to_low where low = high."""
    return lit(to_low) + F.coalesce(F.try_divide(value - low, high - low), lit(0)) * lit(to_high - to_low)


def od_pair_distance(o1, d1, o2, d2) -> Column:
    """The lesser of the summed end distances of two OD pairs as they stand and crossed, in hundreds of metres; points are (lon, lat) Columns."""
    return F.least(metres(*o1, *o2) + metres(*d1, *d2), metres(*o1, *d2) + metres(*d1, *o2)) / lit(100)


def gps_key(lon: Column, lat: Column, sec: Column) -> Column:
    """lon_lat_sec as text, five and six decimals."""
    return F.concat_ws("_", F.format_string("%.5f", lon), F.format_string("%.6f", lat), sec.cast("string"))


def three_stops(value: Column, low: float, middle: float, high: float) -> Column:
    """Place of a value on a scale of three stops: 0 at low, 0.5 at middle, 1 at high, straight between and level beyond."""
    first = scale(value, lit(low), lit(middle), 0.0, 0.5)
    second = scale(value, lit(middle), lit(high), 0.5, 1.0)
    return F.greatest(lit(0.0), F.least(lit(1.0), F.when(value < lit(middle), first).otherwise(second)))


def place_of_least(values: Column) -> Column:
    """Place (from 0) of the least element of an array, the first of equal ones."""
    return (F.array_position(values, F.array_min(values)) - 1).cast("long")


def place_of_greatest(values: Column) -> Column:
    """Place (from 0) of the greatest element of an array, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 less the share of common elements of two arrays; 0 for two empty ones."""
    return lit(1) - F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), lit(1))
