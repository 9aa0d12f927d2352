"""Close pairs of vessels through a grid, without comparing all with all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import MEAN_RADIUS, NAUTICAL_MILE, haversine_m, meters_to_nm

_DEGREE_M = math.pi * MEAN_RADIUS / 180


def _columns_at(row: Column, size: float) -> Column:
    """Cells around the globe in a row of cells; each is at least as wide in metres as high."""
    edge = F.least(F.greatest(F.abs(row * size), F.abs((row + 1) * size)), F.lit(89.9))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(edge)) / size)).cast("long")


def _column(lon: Column, n: Column) -> Column:
    around = F.pmod(lon, F.lit(360.0))
    return F.least(F.floor(around * n / 360.0).cast("long"), n - 1)


def near_pairs(left: DataFrame, right: DataFrame, radius_m: float, condition: Column) -> DataFrame:
    """Rows of left and right (structs a and b) within radius_m of each other for which condition holds.

    Both need longitude and latitude; condition may use a, b and dist. right lies in the cell of its point; left is
    repeated in the 3 x 3 cells around its own, so that the join is on equal cells. Rows of cells hold fewer cells
    towards the poles and close at 180 degrees. A crowded cell is split by adaptive execution.
    """
    size = radius_m / _DEGREE_M * 1.01 + 1e-9
    row = lambda lat: F.floor(lat / size).cast("long")
    a = left.select(F.struct(*left.columns).alias("a")).where("a.longitude IS NOT NULL AND a.latitude IS NOT NULL")
    a = a.withColumn("cy", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: row(F.col("a.latitude")) + d)))
    n = _columns_at(F.col("cy"), size)
    mine = _column(F.col("a.longitude"), n)
    a = a.withColumn("cx", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(mine + d, n)))))
    b = right.select(F.struct(*right.columns).alias("b")).where("b.longitude IS NOT NULL AND b.latitude IS NOT NULL")
    b = b.withColumn("cy", row(F.col("b.latitude")))
    b = b.withColumn("cx", _column(F.col("b.longitude"), _columns_at(F.col("cy"), size)))
    dist = haversine_m(F.col("b.latitude"), F.col("b.longitude"), F.col("a.latitude"), F.col("a.longitude"))
    return a.join(b, ["cy", "cx"]).withColumn("dist", dist).where(condition).drop("cy", "cx")


def proximity_pairs(df: DataFrame, radius_nm: float = 1.0) -> DataFrame:
    """Directed pairs of different vessels closer than radius_nm: mmsi, other and dist_nm."""
    radius = radius_nm * NAUTICAL_MILE
    pairs = near_pairs(df, df, radius, (F.col("a.mmsi") != F.col("b.mmsi")) & (meters_to_nm(F.col("dist")) < radius_nm))
    return pairs.select(F.col("a.mmsi").alias("mmsi"), F.col("b.mmsi").alias("other"), meters_to_nm(F.col("dist")).alias("dist_nm"))


def proximity_set(df: DataFrame, radius_nm: float = 1.0) -> DataFrame:
    """Vessels in at least one close pair."""
    return proximity_pairs(df, radius_nm).select("mmsi").distinct()
