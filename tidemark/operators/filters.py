"""Row filters; comparisons with null drop the row."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_box, within
from ..functions.vessels import as_time, older_than

TRACK = ("ts", "mmsi", "messageType", "sog", "cog", "rot", "trueHeading", "latitude", "longitude")


def select_track_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in TRACK if c in df.columns])


def valid_latitude(df: DataFrame, low: float = -90.0, high: float = 90.0) -> DataFrame:
    return df.where(F.col("latitude").between(low, high))


def valid_longitude(df: DataFrame, low: float = 0.0, high: float = 180.0) -> DataFrame:
    return df.where(F.col("longitude").between(low, high))


def lookback(df: DataFrame, as_of: datetime, hours: float) -> DataFrame:
    return df.where(~older_than(as_of, F.col("ts"), hours))


def time_range(df: DataFrame, start: datetime, end: datetime, open_start: bool = False) -> DataFrame:
    low = F.col("ts") > as_time(start) if open_start else F.col("ts") >= as_time(start)
    return df.where(low & (F.col("ts") < as_time(end)))


def since(df: DataFrame, start: str, mmsi: int | None = None) -> DataFrame:
    """Rows from a start text on, in which %20 stands for a space."""
    found = df.where(F.col("ts") >= F.lit(start.replace("%20", " ")).cast("timestamp_ntz"))
    return found if mmsi is None else by_mmsi(found, mmsi)


def valid_mmsi(df: DataFrame, positive: bool = False) -> DataFrame:
    return df.where(F.col("mmsi") > 0 if positive else F.col("mmsi") != 0)


def by_mmsi(df: DataFrame, mmsi: int) -> DataFrame:
    return df.where(F.col("mmsi") == mmsi)


def by_mmsi_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.where(F.col("mmsi").cast("string").startswith(prefix))


def moving(df: DataFrame) -> DataFrame:
    return df.where(F.col("sog") != 0)


def slow(df: DataFrame, max_sog: float = 0.7) -> DataFrame:
    return df.where(F.col("sog") <= max_sog)


def open_episodes(df: DataFrame) -> DataFrame:
    return df.where(F.col("tsOut").isNull())


def dwell_longer_than(df: DataFrame, as_of: datetime, hours: float, column: str) -> DataFrame:
    return df.where(older_than(as_of, F.col(column), hours))


def in_zones(df: DataFrame, zones) -> DataFrame:
    return df.where(F.col("zone").isin(*zones))


def within_box(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    return df.where(in_box(F.col("longitude"), F.col("latitude"), box))


def within_region(df: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Rows strictly inside a closed ring of (lon, lat); its envelope is compared first and reaches the scan."""
    lon, lat = [p[0] for p in ring], [p[1] for p in ring]
    edges = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((*a, *b), ("x1", "y1", "x2", "y2"), strict=True)]) for a, b in zip(ring, ring[1:], strict=False)])
    return within_box(df, (min(lon), min(lat), max(lon), max(lat))).where(within(F.col("longitude"), F.col("latitude"), edges))
