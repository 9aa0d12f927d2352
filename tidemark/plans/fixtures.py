"""Domain tables derived from the generic test tables; one SQL text serves Spark and the oracle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.zones import zone_rings

AS_OF = datetime(2024, 1, 31)

# One point inside each sector 1-6 and lane, then points around the restricted zone.
LANE_POINTS = """
SELECT * FROM (VALUES
 (0,100.89e0,2.96e0),(1,100.81e0,2.92e0),(2,101.24e0,2.72e0),(3,101.11e0,2.71e0),
 (4,101.82e0,2.34e0),(5,101.78e0,2.30e0),(6,102.34e0,1.89e0),(7,102.28e0,1.88e0),
 (8,102.94e0,1.64e0),(9,102.83e0,1.59e0),(10,103.31e0,1.33e0),(11,103.29e0,1.30e0),
 (12,104.40e0,2.00e0),(13,105.10e0,2.00e0),(14,104.70e0,1.50e0),(15,104.70e0,2.40e0)
) AS t(k, lon, lat)"""

POSITIONS = """
SELECT CASE WHEN e.user_id % 5 <> 4 THEN 'A' ELSE 'B' END AS feed,
       e.event_id, e.ts, 533000000 + e.user_id AS mmsi,
       CASE WHEN e.moored THEN 1 ELSE 0 END AS "navStatus",
       CASE WHEN e.moored THEN 'At anchor' ELSE 'Under way' END AS "navStatusDesc",
       CASE WHEN e.moored THEN 104.6e0 + 3e-3 * ((e.g * 53) % 100) ELSE l.lon + 1e-3 * (e.event_id % 5) END AS longitude,
       CASE WHEN e.moored THEN 1.75e0 + 5e-3 * ((e.g * 37) % 100) + 4e-4 * (e.user_id % 3) ELSE l.lat + 1e-3 * (e.event_id % 5) END AS latitude,
       0e0 AS rot,
       CAST((e.event_id * 37) % 361 AS DOUBLE) AS cog,
       CASE WHEN e.moored THEN 1e-1 * (e.event_id % 8) ELSE 8e0 + 1e-1 * (e.event_id % 50) END AS sog,
       CAST((e.event_id * 37) % 360 AS DOUBLE) AS "trueHeading"
FROM (SELECT event_id, ts, user_id,
             CAST(FLOOR(user_id / 3) AS BIGINT) AS g,
             (day(ts) + CAST(FLOOR(user_id / 3) AS BIGINT)) % 3 <> 0 AS moored,
             (user_id + day(ts)) % 16 AS k
      FROM {events}) e
JOIN {lane_points} l ON l.k = e.k"""

STATIC = """
SELECT CASE WHEN c.c_custkey % 5 <> 4 THEN 'A' ELSE 'B' END AS feed,
       533000000 + c.c_custkey AS mmsi, c.ship_type AS "shipType",
       CASE WHEN c.c_custkey % 7 = 6 THEN NULL WHEN c.ship_type >= 80 THEN 'Tanker'
            WHEN c.ship_type >= 70 THEN 'Cargo' ELSE 'Other' END AS "shipTypeDesc",
       c.c_name AS "shipName", CONCAT('CS', CAST(c.c_custkey AS VARCHAR(20))) AS callsign,
       9000000 + c.c_custkey AS imo,
       20 + c.c_custkey % 150 AS to_bow, 10 + c.c_custkey % 60 AS to_stern,
       5 + c.c_custkey % 20 AS to_port, 5 + c.c_custkey % 20 AS to_starboard,
       n.n_name AS destination
FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 80 + c_custkey % 10
                     WHEN c_custkey % 3 = 1 THEN 70 + c_custkey % 10
                     ELSE 30 + (c_custkey * 7) % 40 END AS ship_type FROM {customer}) c
LEFT JOIN {nation} n ON n.n_nationkey = c.c_nationkey
WHERE c.c_custkey % 11 <> 10"""


def _spark(text: str) -> str:
    return text.replace('"', "`")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.sql(LANE_POINTS)
    return spark.sql(_spark(POSITIONS), events=spark.read.parquet(f"{sf_dir}/events.parquet"), lane_points=points)


def vessel_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(_spark(STATIC), customer=read("customer"), nation=read("nation"))


def gps_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    ms = (F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "ts") * 1000).alias("ts")
    return p.select(ms, F.lit(1).alias("msgtype"), "mmsi", "sog", "cog", "rot", F.col("trueHeading").alias("heading"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"), "event_id")


def static_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static message at the time of each order, with a callsign of its own."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") + 533000000).alias("mmsi"), F.col("o_orderkey").alias("message_id"), F.col("o_orderdate").alias("at"))
    ms = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("at").cast("timestamp_ntz")) * 1000
    static = vessel_static(spark, sf_dir).drop("callsign")
    return orders.join(static, "mmsi").select("*", ms.alias("ts"), F.concat(F.lit("M"), F.col("message_id").cast("string")).alias("callsign")).drop("at")


def verb_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all verbs for every vessel, some of them twice, and malformed ones."""
    vessels = vessel_static(spark, sf_dir).select(F.col("mmsi").cast("string").alias("m"))
    line = lambda f: vessels.select(f(F.col("m")).alias("value"))
    verbs = ("playback:", "playbackGps:", "vessel-info:", "all-vessel:", "playback:", "playback:x", "stop:", "vessel-info", "")
    out = None
    for verb in verbs:
        rows = line(lambda m, v=verb: F.concat(F.lit(v), m))
        out = rows if out is None else out.union(rows)
    return out


def requests(spark: SparkSession, sf_dir: str, every: int = 10) -> DataFrame:
    """A playback line for each vessel, or each tenth one, and as many malformed ones."""
    vessels = vessel_static(spark, sf_dir).where(F.col("mmsi") % every == 0).select("mmsi")
    good = vessels.select(F.concat(F.lit("playback:"), F.col("mmsi").cast("string")).alias("value"))
    return good.union(vessels.select(F.concat(F.lit("playback:x"), F.col("mmsi").cast("string")).alias("value")))


#: The same tables for the oracle, as the beginning of a WITH clause.
ORACLE_POSITIONS = f"lane_points AS ({LANE_POINTS}), positions AS ({POSITIONS.format(events='events', lane_points='lane_points')})"
ORACLE_STATIC = f"vessel_static AS ({STATIC.format(customer='customer', nation='nation')})"


def oracle_edges(zones) -> str:
    rings = zone_rings()
    rows = [f"({z},{k},{a[0]!r}e0,{a[1]!r}e0,{b[0]!r}e0,{b[1]!r}e0)" for z in zones for k, (a, b) in enumerate(zip(rings[z][2], rings[z][2][1:], strict=False))]
    return f"edges AS (SELECT * FROM (VALUES {','.join(rows)}) AS t(zone, k, x1, y1, x2, y2))"


def oracle_tags(zones, rows: str = "positions") -> str:
    """edges and tags(event_id, zone) by crossing parity."""
    return f"""{oracle_edges(zones)}, tags AS (
  SELECT p.event_id, e.zone FROM {rows} p, edges e GROUP BY p.event_id, e.zone
  HAVING sum(CASE WHEN (e.y1 > p.latitude) <> (e.y2 > p.latitude)
                   AND p.longitude < (e.x2 - e.x1) * (p.latitude - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END) % 2 = 1)"""


def oracle_episodes(zones, rows: str = "positions") -> str:
    """tags and episodes by islands."""
    return f"""{oracle_tags(zones, rows)}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts, event_id) AS rn, lead(ts) OVER (PARTITION BY mmsi ORDER BY ts, event_id) AS nxt FROM {rows}
), islands AS (
  SELECT n.*, t.zone, n.rn - row_number() OVER (PARTITION BY n.mmsi, t.zone ORDER BY n.rn) AS g FROM numbered n JOIN tags t USING (event_id)
), episodes AS (
  SELECT min(ts) AS "tsDetected", max(ts) AS "tsCurrent", CASE WHEN bool_or(nxt IS NULL) THEN NULL ELSE max(nxt) END AS "tsOut", mmsi,
         arg_min("navStatus", rn) AS "navStatus", arg_min("navStatusDesc", rn) AS "navStatusDesc",
         arg_max(longitude, rn) AS longitude, arg_max(latitude, rn) AS latitude, arg_max(rot, rn) AS rot, arg_max(cog, rn) AS cog,
         arg_max(sog, rn) AS sog, arg_max("trueHeading", rn) AS "trueHeading", zone
  FROM islands GROUP BY mmsi, zone, g)"""


ORACLE_MESSAGES = """static_messages AS (
  SELECT s.mmsi, o.o_orderkey AS message_id, o.o_orderdate AS ts, s."shipType", s."shipName", s.imo, 'M' || o.o_orderkey AS callsign, s.to_bow, s.to_stern, s.to_port, s.to_starboard
  FROM orders o JOIN vessel_static s ON s.mmsi = 533000000 + o.o_custkey)"""
