"""Schemas of the stored tables."""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()), T.StructField("sec", T.IntegerType())])
TRIP = T.StructType([
    T.StructField("trip_key", T.StringType()), T.StructField("user_id", T.LongType()), T.StructField("month", T.IntegerType()), T.StructField("day", T.IntegerType()),
    T.StructField("idx", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("start_sec", T.IntegerType()), T.StructField("end_sec", T.IntegerType()), T.StructField("points", T.ArrayType(POINT)),
    *[T.StructField(f"{e}_{c}", T.DoubleType() if c != "sec" else T.IntegerType()) for e in "od" for c in ("lon", "lat", "sec")],
    T.StructField("o_cell", T.LongType()), T.StructField("d_cell", T.LongType()), T.StructField("od_in_region", T.BooleanType()),
])
POI = T.StructType([T.StructField("poi_id", T.LongType()), T.StructField("category", T.StringType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
FLOW = T.StructType([T.StructField("slice", T.LongType()), T.StructField("o_cell", T.LongType()), T.StructField("d_cell", T.LongType()), T.StructField("flow", T.LongType())])
