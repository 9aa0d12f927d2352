"""Schemas of the tables, enforced by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType()}


def _schema(text: str) -> T.StructType:
    """Fields written as `name type, ...`; needs no session, so workers can import it."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(","))])


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


POSITION = _schema(
    "feed string, event_id bigint, ts timestamp_ntz, mmsi bigint, navStatus int, navStatusDesc string, longitude double,"
    "latitude double, rot double, cog double, sog double, trueHeading double"
)
HISTORY = _schema("ts timestamp_ntz, mmsi bigint, messageType int, sog double, cog double, rot double, trueHeading double, latitude double, longitude double")
GPS = _schema("ts bigint, msgtype int, mmsi bigint, sog double, cog double, rot double, heading double, lat double, lng double")
STATIC = _schema(
    "feed string, mmsi bigint, shipType bigint, shipTypeDesc string, shipName string, callsign string, imo bigint,"
    "to_bow bigint, to_stern bigint, to_port bigint, to_starboard bigint, destination string"
)
EPISODE = _schema(
    "id bigint, tsDetected timestamp_ntz, tsCurrent timestamp_ntz, tsOut timestamp_ntz, mmsi bigint, navStatus int, navStatusDesc string,"
    "longitude double, latitude double, rot double, cog double, sog double, trueHeading double, zone int"
)
BOARD = _schema("sector int, lane int, vessels bigint")
ZONE = (
    _schema("zone int, name string, kind string")
    .add("ring", T.ArrayType(_doubles("lon", "lat")))
    .add("edges", T.ArrayType(_doubles("x1", "y1", "x2", "y2")))
    .add("bbox", _doubles("min_lon", "min_lat", "max_lon", "max_lat"))
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of schema, in its order and types; missing nullable columns are null, others are dropped."""
    return df.to(schema)
