"""Driver queries of the vessel-monitoring operators, with their oracle SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import vessels as V
from ..operators import episodes as E
from ..operators import filters as P
from ..operators.proximity import proximity_pairs, proximity_set
from ..sources import io
from ..sources.repoll import repoll_positions
from ..sources.schemas import EPISODE, POSITION
from ..sources.store import fresh_path, stored
from ..sources.zones import REGIONS, read_geojson_zones, region_box, region_envelopes, ring_mean, swap_axes, zone_catalog, zone_rings
from ..streaming import stale as Z
from ..streaming import trackers as T
from . import boards as B
from . import fixtures as X
from . import requests as R
from . import sts as S
from . import views as W

ALL_ZONES = tuple(range(12))
MOVING_ZONES = tuple(range(1, 12))
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AT = "TIMESTAMP '2024-01-31 00:00:00'"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"2e0 * 6371000e0 * asin(sqrt(least(1e0, power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))))"


CATEGORY = """CASE WHEN "shipType" >= 40 AND "shipType" < 50 THEN 'hs_craft' WHEN "shipType" >= 50 AND "shipType" < 60 THEN 'tug'
 WHEN "shipType" >= 60 AND "shipType" < 70 THEN 'passenger' WHEN "shipType" >= 70 AND "shipType" < 80 THEN 'cargo'
 WHEN "shipType" >= 80 AND "shipType" < 90 THEN 'tanker' ELSE 'others' END"""
EPISODE_COLUMNS = ["tsDetected", "tsCurrent", "tsOut", "mmsi", "navStatus", "navStatusDesc", "longitude", "latitude", "rot", "cog", "sog", "trueHeading", "zone"]
EPISODE_LIST = ", ".join(f'"{c}"' for c in EPISODE_COLUMNS)
BOX = region_box("restricted")
IN_BOX = f"longitude > {BOX[0]!r}e0 AND longitude < {BOX[2]!r}e0 AND latitude > {BOX[1]!r}e0 AND latitude < {BOX[3]!r}e0"
WITH_P = f"WITH {X.ORACLE_POSITIONS}"
WITH_PS = f"{WITH_P}, {X.ORACLE_STATIC}"


def _episodes(spark: SparkSession, sf_dir: str, zones=ALL_ZONES) -> DataFrame:
    return E.zone_episodes(X.positions(spark, sf_dir), zone_catalog(spark, zones))


# zones ---------------------------------------------------------------------------------------------------------------


@query(f"{WITH_P}, {X.oracle_tags(ALL_ZONES)} SELECT event_id, zone FROM tags")
def zone_tags(spark, sf_dir):
    return E.tag_zones(X.positions(spark, sf_dir), zone_catalog(spark)).select("event_id", "zone")


@query(f"{WITH_P}, {X.oracle_tags(ALL_ZONES)} SELECT zone, count(*) AS hits FROM tags GROUP BY zone")
def zone_hit_counts(spark, sf_dir):
    return E.tag_zones(X.positions(spark, sf_dir), zone_catalog(spark)).groupBy("zone").agg(F.count(F.lit(1)).alias("hits"))


@query(f"{WITH_P} SELECT event_id, mmsi, longitude, latitude FROM positions WHERE {IN_BOX}")
def region_filter(spark, sf_dir):
    return P.within_box(X.positions(spark, sf_dir), BOX).select("event_id", "mmsi", "longitude", "latitude")


@query(f"{WITH_P}, {X.oracle_tags((0,))} SELECT DISTINCT mmsi FROM positions JOIN tags USING (event_id)")
def distinct_vessels_in_region(spark, sf_dir):
    return P.within_region(X.positions(spark, sf_dir), zone_rings()[0][2]).select("mmsi").distinct()


@query(f"{WITH_P}, {X.oracle_episodes(ALL_ZONES)} SELECT {EPISODE_LIST} FROM episodes")
def zone_episodes(spark, sf_dir):
    return _episodes(spark, sf_dir).select(EPISODE_COLUMNS)


@query(f'{WITH_P}, {X.oracle_episodes((0,))} SELECT {EPISODE_LIST} FROM episodes WHERE "tsOut" IS NULL')
def restricted_open_episodes(spark, sf_dir):
    return P.open_episodes(_episodes(spark, sf_dir, (0,))).select(EPISODE_COLUMNS)


NEAR = f"{WITH_P}, near AS (SELECT * FROM positions WHERE {IN_BOX})"


@query(f"{NEAR}, {X.oracle_episodes((0,), 'near')} SELECT {EPISODE_LIST} FROM episodes")
def envelope_episodes(spark, sf_dir):
    """Zone-0 episodes of reports inside the outer envelope: excursions beyond it do not end them."""
    return E.zone_episodes(P.within_box(X.positions(spark, sf_dir), BOX), zone_catalog(spark, (0,))).select(EPISODE_COLUMNS)


STALE = f"""{NEAR}, {X.oracle_episodes((0,), 'near')}, latest AS (
  SELECT mmsi, arg_max(longitude, (ts, event_id)) AS lo, arg_max(latitude, (ts, event_id)) AS la FROM positions GROUP BY mmsi
), gone AS (SELECT mmsi FROM latest WHERE NOT ({IN_BOX.replace('longitude', 'lo').replace('latitude', 'la')}))"""


@query(f"""{STALE} SELECT mmsi, zone, "tsDetected",
  CASE WHEN "tsOut" IS NULL AND "tsDetected" < {AT} - INTERVAL 5 DAY AND mmsi IN (SELECT mmsi FROM gone) THEN {AT} ELSE "tsOut" END AS "tsOut" FROM episodes""")
def stale_close(spark, sf_dir):
    positions = X.positions(spark, sf_dir)
    episodes = E.zone_episodes(P.within_box(positions, BOX), zone_catalog(spark, (0,)))
    return E.close_stale(positions, episodes, X.AS_OF, BOX).select("mmsi", "zone", "tsDetected", "tsOut")


@query(f"""{STALE} SELECT mmsi, zone, "tsDetected",
  CASE WHEN "tsOut" IS NULL AND "tsDetected" < {AT} - INTERVAL 5 DAY AND mmsi IN (SELECT mmsi FROM gone) THEN {AT} ELSE "tsOut" END AS "tsOut" FROM episodes""")
def monitor_restricted_zone(spark, sf_dir):
    """The whole cycle over an empty episode table."""
    empty = spark.createDataFrame([], EPISODE)
    done = W.monitor_zone(X.positions(spark, sf_dir), empty, zone_catalog(spark, (0,)), X.AS_OF, hours=None)
    return done.select("mmsi", "zone", "tsDetected", "tsOut")


@query(f"""{WITH_P}, {X.oracle_episodes((0,))} SELECT p.event_id, p.mmsi FROM positions p
  WHERE p.mmsi IN (SELECT mmsi FROM episodes WHERE "tsOut" IS NULL AND "tsDetected" < {AT} - INTERVAL 5 DAY)""")
def positions_of_stale(spark, sf_dir):
    return E.positions_of_stale(X.positions(spark, sf_dir), _episodes(spark, sf_dir, (0,)), X.AS_OF).select("event_id", "mmsi")


@query(f"""{WITH_P}, {X.oracle_episodes((0,))}, open AS (SELECT mmsi, zone, max("tsDetected") AS since FROM episodes WHERE "tsOut" IS NULL GROUP BY mmsi, zone)
  SELECT p.event_id, p.mmsi, t.zone, o.since AS "openSince" FROM positions p JOIN tags t USING (event_id) LEFT JOIN open o ON o.mmsi = p.mmsi AND o.zone = t.zone""")
def match_open_episode(spark, sf_dir):
    positions = X.positions(spark, sf_dir)
    tagged = E.tag_zones(positions, zone_catalog(spark, (0,)))
    return E.match_open_episode(tagged, _episodes(spark, sf_dir, (0,))).select("event_id", "mmsi", "zone", "openSince")


@query(f"""{WITH_P}, {X.oracle_episodes((0,))} SELECT mmsi, zone, "tsDetected", CASE WHEN mmsi % 2 = 0 AND "tsOut" IS NULL THEN {AT} ELSE "tsOut" END AS "tsOut" FROM episodes""")
def close_episodes(spark, sf_dir):
    episodes = _episodes(spark, sf_dir, (0,))
    return E.close_episodes(episodes, episodes.where("mmsi % 2 = 0"), X.AS_OF).select("mmsi", "zone", "tsDetected", "tsOut")


EARLY, LATE = "TIMESTAMP '2024-01-16 00:00:00'", datetime(2024, 1, 16)


@query(f"""{WITH_P}, early AS (SELECT * FROM positions WHERE ts < {EARLY}), {X.oracle_episodes((0,), 'early')},
 late AS (SELECT 0 AS side, mmsi, zone, "tsDetected", "tsCurrent", "tsOut" FROM episodes)
 SELECT mmsi, zone, "tsDetected", CASE WHEN "tsOut" IS NULL THEN {AT} ELSE "tsCurrent" END AS "tsCurrent", coalesce("tsOut", {AT}) AS "tsOut" FROM late""")
def episode_upsert(spark, sf_dir):
    """Episodes of the first half, upserted with their open ones closed at the fixture clock."""
    early = E.zone_episodes(X.positions(spark, sf_dir).where(F.col("ts") < V.as_time(LATE)), zone_catalog(spark, (0,)))
    changes = P.open_episodes(early).withColumn("tsOut", V.as_time(X.AS_OF)).withColumn("tsCurrent", V.as_time(X.AS_OF))
    return io.upsert_episodes(early, changes).select("mmsi", "zone", "tsDetected", "tsCurrent", "tsOut")


_boxes = " UNION ALL ".join(f"""SELECT '{r}' AS region, min(x1) - {w}e0 AS min_lon, min(y1) - {s}e0 AS min_lat, max(x1) + {e}e0 AS max_lon, max(y1) + {n}e0 AS max_lat
  FROM edges WHERE zone IN ({', '.join(map(str, z))})""" for r, (z, w, e, n, s) in REGIONS.items())


@query(f"""{WITH_P}, {X.oracle_edges(ALL_ZONES)}, boxes AS ({_boxes})
 SELECT region, round(min_lon, 6) AS min_lon, round(min_lat, 6) AS min_lat, round(max_lon, 6) AS max_lon, round(max_lat, 6) AS max_lat, count(*) AS reports, count(DISTINCT mmsi) AS vessels
 FROM boxes JOIN positions ON longitude > min_lon AND longitude < max_lon AND latitude > min_lat AND latitude < max_lat GROUP BY ALL""")
def zone_envelopes(spark, sf_dir):
    """The padded envelope of each region with the reports and vessels inside it."""
    boxes = region_envelopes(spark)
    corners = ("min_lon", "min_lat", "max_lon", "max_lat")
    # three regions are fixed, so each report is tested by an array of their boxes and not joined
    held = F.filter(F.array(*[F.struct(F.lit(r).alias("region"), *[F.lit(v).alias(c) for c, v in zip(corners, region_box(r), strict=True)]) for r in REGIONS]), lambda b: G.in_box(F.col("longitude"), F.col("latitude"), b))
    hits = X.positions(spark, sf_dir).select("mmsi", F.explode(held).alias("b")).groupBy("b.region").agg(F.count(F.lit(1)).alias("reports"), F.countDistinct("mmsi").alias("vessels"))
    return hits.join(F.broadcast(boxes), "region").select("region", *[F.round(c, 6).alias(c) for c in corners], "reports", "vessels")


@query(f"""{WITH_P}, {X.oracle_tags(ALL_ZONES)}, hit AS (SELECT zone, count(*) AS hits FROM tags GROUP BY zone),
 means AS (SELECT zone, (sum(x1) + arg_max(x2, k)) / (count(*) + 1) AS lon, (sum(y1) + arg_max(y2, k)) / (count(*) + 1) AS lat FROM edges GROUP BY zone)
 SELECT zone, round(lon, 6) AS mean_lon, round(lat, 6) AS mean_lat, hits FROM means JOIN hit USING (zone)""")
def ring_means(spark, sf_dir):
    """Label points of the zones that have reports, with their numbers."""
    means = ring_mean(zone_catalog(spark)).select("zone", F.round("mean_lon", 6).alias("mean_lon"), F.round("mean_lat", 6).alias("mean_lat"))
    return zone_hit_counts(spark, sf_dir).join(F.broadcast(means), "zone")


# vessels -------------------------------------------------------------------------------------------------------------


@query(f'WITH {X.ORACLE_STATIC} SELECT mmsi, {CATEGORY} AS shipcatagory FROM vessel_static')
def ship_category(spark, sf_dir):
    return X.vessel_static(spark, sf_dir).select("mmsi", V.ship_category(F.col("shipType")).alias("shipcatagory"))


@query(f"WITH {X.ORACLE_STATIC} SELECT mmsi, to_bow + to_stern AS length_m, to_port + to_starboard AS beam_m FROM vessel_static")
def hull_dims(spark, sf_dir):
    length, beam = V.hull_dims(*map(F.col, ("to_bow", "to_stern", "to_port", "to_starboard")))
    return X.vessel_static(spark, sf_dir).select("mmsi", length.alias("length_m"), beam.alias("beam_m"))


MARGIN = f"""CASE WHEN {AT} - "tsCurrent" > INTERVAL 2 HOUR THEN 50e0 WHEN {AT} - "tsCurrent" < INTERVAL 30 MINUTE THEN 10e0 ELSE 30e0 END"""
SOG_LIMIT = f"""CASE WHEN {AT} - "tsCurrent" > INTERVAL 1 HOUR THEN 1e0 WHEN {AT} - "tsCurrent" < INTERVAL 30 MINUTE THEN 5e-1 ELSE 1e0 END"""


@query(f'{WITH_P}, {X.oracle_episodes((0,))} SELECT mmsi, "tsDetected", {MARGIN} AS ts_margin, {SOG_LIMIT} AS ts_sog, CASE WHEN cog = 360 THEN 0e0 ELSE cog END AS cog_v FROM episodes')
def sts_margins(spark, sf_dir):
    return _episodes(spark, sf_dir, (0,)).select("mmsi", "tsDetected", V.time_margin(X.AS_OF, F.col("tsCurrent")).alias("ts_margin"), V.time_sog_limit(X.AS_OF, F.col("tsCurrent")).alias("ts_sog"), V.normalize_cog(F.col("cog")).alias("cog_v"))


MERGED = f"""{WITH_PS}, merged AS (
  SELECT p.*, s."shipType", s."shipTypeDesc", s."shipName", s.callsign, s.imo, s.to_bow, s.to_stern, s.to_port, s.to_starboard, s.destination,
         s.to_bow + s.to_stern AS length_m, s.to_port + s.to_starboard AS beam_m, {CATEGORY} AS shipcatagory
  FROM positions p LEFT JOIN vessel_static s ON s.mmsi = p.mmsi AND s.feed = p.feed
  WHERE p.latitude BETWEEN -90 AND 90 AND p.mmsi <> 0 AND (p.feed = 'B' OR p.ts >= {AT} - INTERVAL 10 DAY))"""


def _merged(spark, sf_dir):
    p, s = X.positions(spark, sf_dir), X.vessel_static(spark, sf_dir)
    feed = lambda df, f: df.where(F.col("feed") == f)
    return W.merged_feeds(feed(p, "A"), feed(s, "A"), feed(p, "B"), feed(s, "B"), X.AS_OF)


@query(f'{MERGED} SELECT feed, event_id, ts, mmsi, "shipName", imo, length_m, beam_m, shipcatagory, destination FROM merged')
def merged_feeds(spark, sf_dir):
    return _merged(spark, sf_dir).select("feed", "event_id", "ts", "mmsi", "shipName", "imo", "length_m", "beam_m", "shipcatagory", "destination")


COLOR_SQL = "CASE shipcatagory " + " ".join(f"WHEN '{c}' THEN '{','.join(map(str, v[:3]))}'" for c, v in V.COLORS.items()) + " END"


@query(f"""{MERGED}, {X.oracle_tags((0,))}, hot AS (SELECT DISTINCT mmsi FROM positions JOIN tags USING (event_id) WHERE sog = 0)
 SELECT event_id, mmsi, CASE WHEN mmsi IN (SELECT mmsi FROM hot) THEN 1 ELSE 0 END AS area_loc,
        {COLOR_SQL} || CASE WHEN mmsi IN (SELECT mmsi FROM hot) THEN ',255' ELSE ',70' END AS shipcolor2, {COLOR_SQL} || ',200' AS shipcolor,
        strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS lcltime, strftime(ts, '%Y-%m-%d %H:%M:%S') AS utctime FROM merged""")
def vessel_view(spark, sf_dir):
    tagged = E.tag_zones(X.positions(spark, sf_dir), zone_catalog(spark, (0,)))
    view = W.vessel_view(_merged(spark, sf_dir), tagged.where("sog = 0"), triangle_km=None)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return view.select("event_id", "mmsi", "area_loc", text("shipcolor2"), text("shipcolor"), "lcltime", "utctime")


def _direct(lat: str, lon: str, dist: str, bearing: str) -> tuple[str, str]:
    d, b, y, x = f"({dist}) / 6378137e0", f"radians({bearing})", f"radians({lat})", f"radians({lon})"
    lat2 = f"asin(sin({y}) * cos({d}) + cos({y}) * sin({d}) * cos({b}))"
    return f"degrees({lat2})", f"degrees({x} + atan2(sin({b}) * sin({d}) * cos({y}), cos({d}) - sin({y}) * sin({lat2})))"


_dest = _direct("latitude", "longitude", "sog * 1852e0", "cog")


@query(f"{WITH_P} SELECT event_id, round({_dest[0]}, 6) AS lat2, round({_dest[1]}, 6) AS lon2 FROM positions")
def destination_point(spark, sf_dir):
    """Where each vessel will be in an hour on its course."""
    lat, lon = G.destination_point(F.col("latitude"), F.col("longitude"), F.col("sog") * 1852.0, F.col("cog"))
    return X.positions(spark, sf_dir).select("event_id", F.round(lat, 6).alias("lat2"), F.round(lon, 6).alias("lon2"))


def _corner(x: float, y: float, name: str) -> str:
    t = "radians(cog)"
    east, north = f"({x}e0 * cos({t}) - ({y}e0) * sin({t})) * 1000", f"({x}e0 * sin({t}) + ({y}e0) * cos({t})) * 1000"
    return f"{name}_e AS (SELECT event_id, cog, {_direct('latitude', 'longitude', east, '-90e0')[0]} AS la, {_direct('latitude', 'longitude', east, '-90e0')[1]} AS lo FROM positions), {name} AS (SELECT event_id, round({_direct('la', 'lo', north, '0e0')[1]}, 6) AS lon, round({_direct('la', 'lo', north, '0e0')[0]}, 6) AS lat FROM {name}_e)"


@query(f"""{WITH_P}, {_corner(0.0, 2.0, 'f')}, {_corner(-0.5, -0.5, 'l')}, {_corner(0.5, -0.5, 'r')}
 SELECT event_id, f.lon AS front_lon, f.lat AS front_lat, l.lon AS left_lon, l.lat AS left_lat, r.lon AS right_lon, r.lat AS right_lat FROM f JOIN l USING (event_id) JOIN r USING (event_id)""")
def heading_triangle(spark, sf_dir):
    corners = G.heading_triangle(F.col("latitude"), F.col("longitude"), F.col("cog"), 2.0)
    named = [F.round(c, 6).alias(f"{n}_{a}") for n, pair in zip(("front", "left", "right"), corners, strict=True) for a, c in zip(("lon", "lat"), pair, strict=True)]
    return X.positions(spark, sf_dir).select("event_id", *named)


def _geodesic(rounds: int) -> str:
    """CTEs g0, g1, ... of Vincenty's direct solution over positions, and geo(event_id, la, lo)."""
    f, b2 = G.WGS84[1], 1 - G.WGS84[1]
    parts = [f"""g AS (SELECT event_id, longitude, radians(cog) AS z, sog * 1852e0 AS s, {b2!r}e0 * tan(radians(latitude)) AS tu FROM positions),
 h AS (SELECT *, 1 / sqrt(1 + tu * tu) AS cu, tu / sqrt(1 + tu * tu) AS su, atan2(tu, cos(z)) AS s1, sin(z) / sqrt(1 + tu * tu) AS sa FROM g),
 i AS (SELECT *, 1 - sa * sa AS c2, (1 - sa * sa) * {(1 - b2**2) / b2**2!r}e0 AS u FROM h),
 j AS (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS aa, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS bb FROM i),
 k0 AS (SELECT *, s / ({G.WGS84[0] * b2!r}e0 * aa) AS q, s / ({G.WGS84[0] * b2!r}e0 * aa) AS q0 FROM j)"""]
    for n in range(rounds):
        parts.append(f"""m{n} AS (SELECT *, cos(2 * s1 + q) AS m FROM k{n}), k{n + 1} AS (SELECT * EXCLUDE (q, m),
 q0 + bb * sin(q) * (m + bb / 4 * (cos(q) * (2 * m * m - 1) - bb / 6 * m * (4 * sin(q) * sin(q) - 3) * (4 * m * m - 3))) AS q FROM m{n})""")
    c = f"({f / 16!r}e0 * c2 * (4 + {f!r}e0 * (4 - 3 * c2)))"
    parts.append(f"""geo AS (SELECT event_id, degrees(atan2(su * cos(q) + cu * sin(q) * cos(z), {b2!r}e0 * sqrt(sa * sa + power(su * sin(q) - cu * cos(q) * cos(z), 2)))) AS la,
 longitude + degrees(atan2(sin(q) * sin(z), cu * cos(q) - su * sin(q) * cos(z)) - (1 - {c}) * {f!r}e0 * sa * (q + {c} * sin(q) * (cos(2 * s1 + q) + {c} * cos(q) * (2 * power(cos(2 * s1 + q), 2) - 1)))) AS lo FROM k{rounds})""")
    return ", ".join(parts)


@query(f"{WITH_P}, {_geodesic(6)} SELECT event_id, round(la, 8) AS lat2, round(lo, 8) AS lon2 FROM geo")
def geodesic_point(spark, sf_dir):
    """Where each vessel will be in an hour on its course, on the ellipsoid."""
    lat, lon = G.geodesic_point(F.col("latitude"), F.col("longitude"), F.col("sog") * 1852.0, F.col("cog"))
    return X.positions(spark, sf_dir).select("event_id", F.round(lat, 8).alias("lat2"), F.round(lon, 8).alias("lon2"))


DWELL = f"""{WITH_PS}, {X.oracle_episodes((0,))}, open AS (SELECT * FROM episodes WHERE "tsOut" IS NULL)"""


@query(f"""{DWELL} SELECT e.mmsi, e."tsDetected", e.sog, s."shipName", {CATEGORY} AS shipcatagory FROM open e LEFT JOIN vessel_static s ON s.mmsi = e.mmsi
 WHERE e."tsDetected" < {AT} - INTERVAL 2 HOUR AND e.sog <= 7e-1""")
def dwell_report(spark, sf_dir):
    return S.dwell_report(_episodes(spark, sf_dir, (0,)), X.vessel_static(spark, sf_dir), X.AS_OF, 2).select("mmsi", "tsDetected", "sog", "shipName", "shipcatagory")


# boards --------------------------------------------------------------------------------------------------------------

BOARD = f"""{WITH_PS}, {X.oracle_episodes(MOVING_ZONES)}, open AS (SELECT * FROM episodes WHERE "tsOut" IS NULL),
 pairs AS (SELECT s.zone AS sector, l.zone AS lane, l.mmsi FROM open l JOIN (SELECT DISTINCT mmsi, zone FROM open WHERE zone BETWEEN 1 AND 9) s ON s.mmsi = l.mmsi WHERE l.zone IN (10, 11))"""


@query(f"{BOARD} SELECT sector, lane, count(*) AS vessels FROM pairs GROUP BY sector, lane")
def sector_lane_counts(spark, sf_dir):
    return B.sector_lane_counts(_episodes(spark, sf_dir, MOVING_ZONES))


@query(f"{BOARD} SELECT mmsi FROM pairs WHERE sector = 2 AND lane = 10")
def in_sector_and_lane(spark, sf_dir):
    return B.in_sector_and_lane(_episodes(spark, sf_dir, MOVING_ZONES), 2, 10).select("mmsi")


_cells = {f"Sector{s}_{n}": f"sector = {s} AND lane = {k}" for s in range(1, 7) for k, n in ((10, "North"), (11, "South"))}
_sums = _cells | {f"total_sector{s}": f"sector = {s}" for s in range(1, 7)} | {"total_tss_north": "sector <= 6 AND lane = 10", "total_tss_south": "sector <= 6 AND lane = 11", "total": "sector <= 6"}
BOARD_ROW = f"{BOARD} SELECT " + ", ".join(f'count(*) FILTER (WHERE {c}) AS "{n}"' for n, c in _sums.items()) + " FROM pairs"


@query(BOARD_ROW)
def summary_board(spark, sf_dir):
    return B.summary_board(_episodes(spark, sf_dir, MOVING_ZONES))


@query(BOARD + " " + " UNION ALL ".join(f"SELECT '{n}' AS metric, count(*) FILTER (WHERE {c}) AS \"Total\", {i} AS ordinal FROM pairs" for i, (n, c) in enumerate(_sums.items())))
def board_long(spark, sf_dir):
    return B.board_long(B.summary_board(_episodes(spark, sf_dir, MOVING_ZONES)))


@query(BOARD + " SELECT " + ", ".join(f'count(*) FILTER (WHERE {c} AND sector IN (1, 3) AND lane = 10) AS "{n}"' for n, c in _sums.items()) + " FROM pairs")
def selected_board(spark, sf_dir):
    """Sectors 1 and 3 and the northbound lane selected; the rest is 0."""
    return B.summary_board(_episodes(spark, sf_dir, MOVING_ZONES), sectors=(1, 3), lanes=(10,))


TYPES = f"""{BOARD}, types AS (SELECT p.sector, p.lane, count(*) AS "Count", s."shipType" AS "ShipTypeNo", coalesce(s."shipTypeDesc", 'Not Available') AS "ShipType"
 FROM pairs p LEFT JOIN vessel_static s ON s.mmsi = p.mmsi GROUP BY p.sector, p.lane, s."shipType", s."shipTypeDesc")"""


@query(f"{TYPES} SELECT * FROM types")
def ship_type_breakdown(spark, sf_dir):
    return B.ship_type_breakdown(_episodes(spark, sf_dir, MOVING_ZONES), X.vessel_static(spark, sf_dir))


@query(f'{TYPES} SELECT DISTINCT "Count", "ShipTypeNo", "ShipType" FROM types')
def ship_type_union_compat(spark, sf_dir):
    return B.ship_type_breakdown(_episodes(spark, sf_dir, MOVING_ZONES), X.vessel_static(spark, sf_dir), compat_distinct=True)


@query(f'{TYPES} SELECT "ShipType", CAST(sum("Count") AS BIGINT) AS "Total" FROM types GROUP BY "ShipType"')
def ship_type_bars(spark, sf_dir):
    return B.bar_totals(B.ship_type_breakdown(_episodes(spark, sf_dir, MOVING_ZONES), X.vessel_static(spark, sf_dir)))


@query(f"{WITH_P}, {X.oracle_tags(ALL_ZONES)} SELECT zone, count(DISTINCT mmsi) AS vessels FROM positions JOIN tags USING (event_id) GROUP BY zone")
def zone_vessel_estimate(spark, sf_dir):
    """Vessels by zone from merged daily sketches; they are exact while a zone has few vessels for a sketch's registers."""
    return B.merged_vessels(B.vessel_sketches(E.tag_zones(X.positions(spark, sf_dir), zone_catalog(spark))), "zone")


# proximity and transfers ---------------------------------------------------------------------------------------------

NEAR_PAIRS = f"""{WITH_P}, {X.oracle_episodes((0,))}, open AS (SELECT * FROM episodes WHERE "tsOut" IS NULL), pairs AS (
 SELECT a.mmsi, b.mmsi AS other, {_haversine('b.latitude', 'b.longitude', 'a.latitude', 'a.longitude')} / 1852e0 AS dist_nm FROM open a, open b WHERE a.mmsi <> b.mmsi)"""


@query(f"{NEAR_PAIRS} SELECT mmsi, other, round(dist_nm, 3) AS dist_nm FROM pairs WHERE dist_nm < 1e0")
def proximity_pairs_1nm(spark, sf_dir):
    return proximity_pairs(P.open_episodes(_episodes(spark, sf_dir, (0,)))).withColumn("dist_nm", F.round("dist_nm", 3))


@query(f"{NEAR_PAIRS} SELECT DISTINCT mmsi FROM pairs WHERE dist_nm < 1e0")
def proximity_vessels(spark, sf_dir):
    return proximity_set(P.open_episodes(_episodes(spark, sf_dir, (0,))))


_DIFF = "abs(b.cog_v - a.cog_v)"
_LIMIT = f"""CASE WHEN {_DIFF} > 30 AND {_DIFF} <= 110 OR {_DIFF} >= 260 AND {_DIFF} <= 280 OR {_DIFF} > 300 AND {_DIFF} < 350 THEN CAST(b.beam_m + a.to_stern AS DOUBLE)
 ELSE (b.beam_m + a.beam_m) / 2e0 + b.ts_margin END"""
STS = f"""{DWELL}, view AS (
  SELECT e.*, s."shipType", s."shipName", s.to_stern, s.to_bow + s.to_stern AS length_m, s.to_port + s.to_starboard AS beam_m, {MARGIN} AS ts_margin, {SOG_LIMIT} AS ts_sog,
         CASE WHEN cog = 360 THEN 0e0 ELSE cog END AS cog_v, row_number() OVER (ORDER BY e."tsDetected", e.mmsi) AS o
  FROM open e LEFT JOIN vessel_static s ON s.mmsi = e.mmsi WHERE {AT} - "tsCurrent" > INTERVAL 30 MINUTE AND sog <= 7e-1
), near AS (
  SELECT a.mmsi AS am, b.mmsi AS bm, a.o AS oa, b.o AS ob, a."tsDetected" AS ats, b."tsDetected" AS bts, a.length_m AS al, b.length_m AS bl, b.longitude AS blon, b.latitude AS blat, a."shipName" AS name,
         {_haversine('b.latitude', 'b.longitude', 'a.latitude', 'a.longitude')} AS dist, {_LIMIT} AS lim
  FROM view a, view b WHERE a."shipType" >= 80 AND a."shipType" < 90 AND a.mmsi <> b.mmsi AND b.sog <= b.ts_sog
), pairs AS (SELECT * FROM near WHERE dist <= lim)"""


def _restricted(spark, sf_dir):
    return stored(S.restrict_view(_episodes(spark, sf_dir, (0,)), X.vessel_static(spark, sf_dir), X.AS_OF), "restrict-view")


@query(f"{STS} SELECT am AS mmsi, bm AS partner, round(dist, 3) AS dist FROM pairs")
def sts_pairs(spark, sf_dir):
    return S.sts_pairs(_restricted(spark, sf_dir)).select(F.col("a.mmsi").alias("mmsi"), F.col("b.mmsi").alias("partner"), F.round("dist", 3).alias("dist"))


@query(f"""{STS} SELECT a.mmsi, b.mmsi AS partner, {_LIMIT} AS lim FROM view a JOIN view b ON CAST(floor((a.mmsi - 533000000) / 3) AS BIGINT) = CAST(floor((b.mmsi - 533000000) / 3) AS BIGINT) AND a.mmsi <> b.mmsi""")
def sts_thresholds(spark, sf_dir):
    """Thresholds between the vessels of each berth group."""
    view = _restricted(spark, sf_dir).withColumn("g", F.floor((F.col("mmsi") - 533000000) / 3))
    a, b = (view.select("g", F.struct(*view.columns).alias(n)) for n in "ab")
    diff = V.heading_diff(F.col("b.cog_v"), F.col("a.cog_v"))
    lim = V.sts_threshold_m(diff, F.col("b.beam_m"), F.col("a.beam_m"), F.col("a.to_stern"), F.col("b.ts_margin"))
    return a.join(b, "g").where("a.mmsi <> b.mmsi").select(F.col("a.mmsi").alias("mmsi"), F.col("b.mmsi").alias("partner"), lim.alias("lim"))


def _rounds(n: int) -> str:
    parts = ["anchors AS (SELECT DISTINCT am, oa FROM pairs)", "later AS (SELECT p.am, p.bm FROM pairs p JOIN anchors x ON x.am = p.bm WHERE p.oa < x.oa)", "u0 AS (SELECT am FROM anchors)"]
    for i in range(n):
        parts.append(f"f{i} AS (SELECT am FROM u{i} WHERE am NOT IN (SELECT bm FROM later WHERE am IN (SELECT am FROM u{i})))")
        parts.append(f"u{i + 1} AS (SELECT am FROM u{i} WHERE am NOT IN (SELECT am FROM f{i}) AND am NOT IN (SELECT bm FROM later WHERE am IN (SELECT am FROM f{i})))")
    parts.append("fired AS (" + " UNION ALL ".join(f"SELECT am FROM f{i}" for i in range(n)) + ")")
    parts.append("own AS (SELECT * FROM pairs WHERE am IN (SELECT am FROM fired))")
    parts.append("flagged AS (SELECT mmsi, min(oa) AS first FROM (SELECT am AS mmsi, oa FROM own UNION ALL SELECT bm, oa FROM own) GROUP BY mmsi)")
    return ", ".join(parts)


@query(f"{STS}, {_rounds(5)} SELECT mmsi FROM flagged")
def sts_flagged(spark, sf_dir):
    return S.sts_flagged(_restricted(spark, sf_dir))


@query(f"""{STS}, {_rounds(5)} SELECT array_to_string(list_sort(list_distinct(list(o.bm) || list(o.am))), '|') AS mmsi, o.am AS mmsi_, any_value(name) AS "shipName", any_value(al) AS length_m,
   round(avg(blon), 6) AS longitude, round(avg(blat), 6) AS latitude, strftime(any_value(ats) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS lcltime, 2000 AS radius,
   CASE WHEN any_value(al) = 0 OR bool_or(bl = 0) THEN '255,0,0,150' WHEN any_value(al) <= 68 OR bool_or(bl <= 68) THEN '66,247,255,150' ELSE '255,0,0,150' END AS color
 FROM own o JOIN flagged f ON f.mmsi = o.bm GROUP BY o.am HAVING NOT bool_or(f.first < o.oa) AND bool_and({AT} - o.bts >= INTERVAL 1 HOUR)""")
def sts_detections(spark, sf_dir):
    found = S.detect_sts(_restricted(spark, sf_dir), X.AS_OF)
    color = F.array_join(F.transform("color", lambda x: x.cast("string")), ",").alias("color")
    return found.select("mmsi", "mmsi_", "shipName", "length_m", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"), "lcltime", "radius", color)


# tracks --------------------------------------------------------------------------------------------------------------


@query(f"{WITH_P} SELECT event_id, ts, mmsi, longitude, latitude FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, event_id DESC) AS n FROM positions) WHERE n = 1")
def latest_positions(spark, sf_dir):
    return E.latest_positions(X.positions(spark, sf_dir)).select("event_id", "ts", "mmsi", "longitude", "latitude")


@query("""SELECT mmsi, ts, o_orderkey FROM (SELECT 533000000 + o_custkey AS mmsi, o_orderdate AS ts, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_static(spark, sf_dir):
    """The newest message of each sender; orders stand in for messages."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    messages = orders.select((F.col("o_custkey") + 533000000).alias("mmsi"), F.struct("o_orderdate", "o_orderkey").alias("ts"))
    return W.latest_static(messages).select("mmsi", F.col("ts.o_orderdate").alias("ts"), F.col("ts.o_orderkey").alias("o_orderkey"))


INDEXED = f"{WITH_P}, ix AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY mmsi) AS n FROM positions)"


@query(f"{INDEXED} SELECT event_id, mmsi, idx FROM ix")
def track_index(spark, sf_dir):
    return W.track_index(X.positions(spark, sf_dir)).select("event_id", "mmsi", F.col("idx").cast("bigint").alias("idx"))


@query(f"{INDEXED} SELECT event_id, mmsi FROM ix WHERE (idx + 1) % 20 = 0")
def every_20th(spark, sf_dir):
    return W.every_nth(X.positions(spark, sf_dir), 20).select("event_id", "mmsi")


@query(f"""{INDEXED} SELECT mmsi, max(n) AS samples, max(ts) FILTER (WHERE idx = 0) AS first_ts, max(ts) FILTER (WHERE idx = ceil((n - 1) / 2e0)) AS middle_ts, max(ts) FILTER (WHERE idx = n - 1) AS last_ts,
 max(longitude) FILTER (WHERE idx = ceil((n - 1) / 2e0)) AS middle_longitude FROM ix GROUP BY mmsi""")
def track_markers(spark, sf_dir):
    return W.track_markers(X.positions(spark, sf_dir)).select("mmsi", "samples", "first_ts", "middle_ts", "last_ts", "middle_longitude")


@query(f"""{INDEXED}, pieces AS (SELECT *, idx // 50 AS piece FROM ix UNION ALL SELECT *, idx // 50 - 1 FROM ix WHERE idx > 0 AND idx % 50 = 0)
 SELECT mmsi, CAST(piece AS BIGINT) AS piece, string_agg('[' || longitude || ',' || latitude || ']', ',' ORDER BY idx) AS points FROM pieces GROUP BY mmsi, piece""")
def track_pieces(spark, sf_dir):
    """Tracks in pieces of fifty points, each with the first point of the next."""
    text = F.array_join(F.transform("points", lambda p: F.concat(F.lit("["), p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit("]"))), ",")
    return W.track_pieces(X.positions(spark, sf_dir), 50).select("mmsi", "piece", text.alias("points"))


ARRIVALS = "SELECT event_id, date_trunc('month', ts) AS ts, 533000000 + CAST(FLOOR(event_id / 3) AS BIGINT) % 5 AS mmsi FROM events"


@query(f"SELECT event_id, mmsi FROM (SELECT *, lag(ts) OVER w AS t, lag(mmsi) OVER w AS m FROM ({ARRIVALS}) WINDOW w AS (ORDER BY event_id)) WHERE t IS NULL OR t <> ts OR m <> mmsi")
def consecutive_dedup(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    arrivals = events.select("event_id", F.date_trunc("month", "ts").alias("ts"), (F.lit(533000000) + F.floor(F.col("event_id") / 3) % 5).alias("mmsi"))
    return W.drop_consecutive_repeats(arrivals).select("event_id", "mmsi")


# the same text as Spark writes it: no spaces, shortest numbers
def _line_json(lon: str = "longitude", lat: str = "latitude") -> str:
    return f"""'{{"payload":"playback-data-geojson","mmsi":"' || mmsi || '","geoSourceData":{{"type":"geojson","data":{{"type":"Feature","properties":{{}},"geometry":{{"type":"LineString","coordinates":['
 || string_agg('[' || {lon} || ',' || {lat} || ']', ',' ORDER BY ts, event_id) || ']}}}}}}}}'"""


GEOJSON = _line_json()
TRACK_JSON = """'{"m_ts":"' || strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') || '","m_mmsi":"' || mmsi || '","m_long":' || longitude || ',"m_lat":' || latitude
 || ',"m_sog":' || sog || ',"m_cog":' || cog || ',"cmap":0,"payload":"playback"}'"""
GPS_JSON = """'{"m_ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","m_mmsi":"' || mmsi || '","m_long":' || longitude || ',"m_lat":' || latitude
 || ',"m_rot":' || rot || ',"m_cog":' || cog || ',"cmap":0,"payload":"playback"}'"""
ALL_JSON = """'{"m_ts":"' || strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') || '","m_mmsi":"' || mmsi || '","m_long":' || longitude || ',"m_lat":' || latitude
 || ',"m_cog":' || cog || ',"payload":"all-vessel"}'"""
INFO_JSON = """'{"m_ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","m_mmsi":"' || mmsi || '","m_shiptype":"' || "shipType" || '","m_shipname":"' || "shipName" || '","m_imo":"' || imo || '","m_callsign":"' || callsign
 || '","m_toStarboard":"' || to_starboard || '","m_toPort":"' || to_port || '","m_toStern":"' || to_stern || '","m_toBow":"' || to_bow || '","payload":"vessel-info"}'"""


@query(f"{WITH_P} SELECT mmsi, {GEOJSON} AS value FROM positions GROUP BY mmsi")
def track_geojson(spark, sf_dir):
    return io.to_geojson(W.track_linestring(X.positions(spark, sf_dir)), "playback-data-geojson")


@query(f"{WITH_P} SELECT mmsi, count(*) AS n, round(arg_min(longitude, (ts, event_id)), 6) AS first_lon, round(arg_max(latitude, (ts, event_id)), 6) AS last_lat FROM positions GROUP BY mmsi")
def track_points(spark, sf_dir):
    lines = W.track_linestring(X.positions(spark, sf_dir))
    return lines.select("mmsi", F.size("points").cast("bigint").alias("n"), F.round(F.get("points", 0)["lon"], 6).alias("first_lon"), F.round(F.element_at("points", -1)["lat"], 6).alias("last_lat"))


@query(f"{WITH_P} SELECT {TRACK_JSON} AS value FROM positions")
def json_records(spark, sf_dir):
    return io.to_json_records(W.playback_records(X.positions(spark, sf_dir)).drop("payload"), "playback")


PLACE = "CAST(mmsi AS VARCHAR) AS m_mmsi, longitude AS m_long, latitude AS m_lat"
LOCAL = "strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS m_ts"
NEWEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, event_id DESC) AS n FROM positions WHERE mmsi > 0) WHERE n = 1)"


@query(f"{WITH_P} SELECT {LOCAL}, {PLACE}, sog AS m_sog, cog AS m_cog, 0 AS cmap, 'playback' AS payload FROM positions")
def playback_records(spark, sf_dir):
    return W.playback_records(X.positions(spark, sf_dir))


@query(f"{WITH_P} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS m_ts, {PLACE}, rot AS m_rot, cog AS m_cog, 0 AS cmap, 'playback' AS payload FROM positions WHERE sog <> 0")
def gps_records(spark, sf_dir):
    return W.gps_records(X.gps_positions(spark, sf_dir))


@query(f"{WITH_P} SELECT {LOCAL}, {PLACE}, cog AS m_cog, 'all-vessel' AS payload FROM {NEWEST}")
def every_vessel_latest(spark, sf_dir):
    return W.all_vessel_latest(X.positions(spark, sf_dir))


INFO = f"""{X.ORACLE_STATIC}, {X.ORACLE_MESSAGES}, info AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, message_id DESC) AS n FROM static_messages) WHERE n = 1)"""


@query(f"""WITH {INFO} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS m_ts, CAST(mmsi AS VARCHAR) AS m_mmsi, CAST("shipType" AS VARCHAR) AS m_shiptype, "shipName" AS m_shipname, CAST(imo AS VARCHAR) AS m_imo, callsign AS m_callsign,
  CAST(to_starboard AS VARCHAR) AS "m_toStarboard", CAST(to_port AS VARCHAR) AS "m_toPort", CAST(to_stern AS VARCHAR) AS "m_toStern", CAST(to_bow AS VARCHAR) AS "m_toBow", 'vessel-info' AS payload FROM info""")
def vessel_info(spark, sf_dir):
    """The newest static message of each vessel; messages come at the times of orders."""
    return W.vessel_info(X.static_messages(spark, sf_dir))


ANSWERS = f"""{WITH_P}, {INFO}, heard AS (SELECT * FROM positions WHERE mmsi IN (SELECT mmsi FROM vessel_static)), moving AS (SELECT * FROM heard WHERE sog <> 0),
 answers AS (
  SELECT 'playback:' || mmsi AS request, row_number() OVER (PARTITION BY mmsi ORDER BY ts, event_id) AS ord, {TRACK_JSON} AS message FROM heard
  UNION ALL SELECT 'playback:' || mmsi, count(*) + 1, 'playback-data-done' FROM heard GROUP BY mmsi
  UNION ALL SELECT 'playback:' || mmsi, count(*) + 2, {_line_json()} FROM heard GROUP BY mmsi
  UNION ALL SELECT 'playbackGps:' || mmsi, row_number() OVER (PARTITION BY mmsi ORDER BY ts, event_id), {GPS_JSON} FROM moving
  UNION ALL SELECT 'playbackGps:' || mmsi, count(*) + 1, 'playback-data-done' FROM moving GROUP BY mmsi
  UNION ALL SELECT 'playbackGps:' || mmsi, count(*) + 2, {_line_json()} FROM moving GROUP BY mmsi
  UNION ALL SELECT 'vessel-info:' || mmsi, 1, {INFO_JSON} FROM info
  UNION ALL SELECT 'all-vessel', mmsi, {ALL_JSON} FROM {NEWEST}
  UNION ALL SELECT 'all-vessel', 9223372036854775807, 'all-vessel-data-done')"""


def _histories(spark, sf_dir) -> R.Histories:
    return R.Histories(X.positions(spark, sf_dir), X.gps_positions(spark, sf_dir), X.static_messages(spark, sf_dir))


@query(f"{ANSWERS} SELECT request, ord, message FROM answers")
def request_answers(spark, sf_dir):
    """All messages that answer lines of the four verbs for every vessel."""
    return R.answers(X.verb_requests(spark, sf_dir), _histories(spark, sf_dir))


@query(f"{ANSWERS} SELECT request, ord, message FROM answers")
def stream_answers(spark, sf_dir):
    """The same from lines that arrive as a stream of text in two batches."""
    path, lines, checkpoint = (fresh_path(spark, n) for n in ("answers", "requests", "stream"))
    write = T.answer_sink(_histories(spark, sf_dir), path)
    half = F.pmod(F.xxhash64("value"), F.lit(2)) == 0
    for rows in (X.verb_requests(spark, sf_dir).where(half & ~F.col("value").startswith("all-vessel")), X.verb_requests(spark, sf_dir).where(~half | F.col("value").startswith("all-vessel"))):
        rows.write.mode("append").text(lines)
        T.run_available(spark.readStream.text(lines), checkpoint, write, "append")
    return spark.read.parquet(path).select("request", "ord", "message")


@query(f"{WITH_P} SELECT date_trunc('second', ts) AS ts, mmsi, longitude, latitude, rot, cog FROM positions WHERE sog <> 0")
def playback_gps(spark, sf_dir):
    return W.playback_gps(X.gps_positions(spark, sf_dir))


@query(f"{WITH_PS} SELECT 'playback:' || p.mmsi AS value, p.event_id, p.mmsi FROM positions p JOIN vessel_static s ON s.mmsi = p.mmsi")
def every_playback_request(spark, sf_dir):
    return W.tracks_for_requests(X.requests(spark, sf_dir, 1), X.positions(spark, sf_dir)).select("value", "event_id", "mmsi")


@query(f"{WITH_P} SELECT event_id, mmsi, sog FROM positions WHERE sog <> 0")
def moving_positions(spark, sf_dir):
    return P.moving(X.positions(spark, sf_dir)).select("event_id", "mmsi", "sog")


@query(f"{WITH_P} SELECT event_id, mmsi FROM positions WHERE CAST(mmsi AS VARCHAR) LIKE '53300001%'")
def mmsi_prefix(spark, sf_dir):
    return P.by_mmsi_prefix(X.positions(spark, sf_dir), "53300001").select("event_id", "mmsi")


@query(f"{WITH_P} SELECT event_id, ts FROM positions WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'")
def time_range(spark, sf_dir):
    return P.time_range(X.positions(spark, sf_dir), datetime(2024, 1, 10), datetime(2024, 1, 12)).select("event_id", "ts")


@query(f"{WITH_P} SELECT event_id, ts FROM positions WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' AND mmsi = 533000003")
def since(spark, sf_dir):
    return P.since(X.positions(spark, sf_dir), "2024-01-20%2012:00:00", 533000003).select("event_id", "ts")


@query(f"{WITH_P} SELECT event_id, ts, mmsi FROM positions ORDER BY ts DESC, event_id DESC LIMIT 10")
def top10_latest(spark, sf_dir):
    return X.positions(spark, sf_dir).select("event_id", "ts", "mmsi").orderBy(F.desc("ts"), F.desc("event_id")).limit(10)


@query(f"{WITH_P} SELECT event_id, ts, mmsi FROM positions WHERE mmsi > 0 AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN 0 AND 180 AND ts >= {AT} - INTERVAL 96 HOUR AND sog <= 7e-1")
def recent_slow_positions(spark, sf_dir):
    rows = P.valid_longitude(P.valid_latitude(P.valid_mmsi(X.positions(spark, sf_dir), positive=True)))
    return P.slow(P.lookback(rows, X.AS_OF, 96)).select("event_id", "ts", "mmsi")


@query(f"{WITH_P} SELECT ts, mmsi, sog, cog, rot, \"trueHeading\", latitude, longitude FROM positions WHERE mmsi = 533000007 AND longitude BETWEEN 0 AND 180 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'")
def extract_history(spark, sf_dir):
    return W.extract_history(X.positions(spark, sf_dir), 533000007, datetime(2024, 1, 5), datetime(2024, 1, 25))


@query(f"{WITH_P} SELECT mmsi, ts, latitude FROM positions WHERE mmsi = 533000005")
def history_round_trip(spark, sf_dir):
    """Histories of all vessels written by bucket, and one vessel's read again."""
    path = fresh_path(spark, "history")
    io.write_history(X.positions(spark, sf_dir).select("ts", "mmsi", "sog", "cog", "rot", "trueHeading", "latitude", "longitude"), path)
    return io.read_history(spark, path, 533000005).select("mmsi", "ts", "latitude")


# tables written and read back -----------------------------------------------------------------------------------------


@query(f"{WITH_P} SELECT coalesce(CASE WHEN event_id % 3 > 0 THEN feed END, 'C') AS feed, event_id, ts, mmsi, CASE WHEN event_id % 7 > 0 THEN cog END AS cog, longitude FROM positions")
def positions_read_back(spark, sf_dir):
    """Reports whose feed is partly unnamed and whose courses are partly NaN."""
    path = fresh_path(spark, "positions")
    odd = {"feed": F.when(F.col("event_id") % 3 > 0, F.col("feed")), "cog": F.when(F.col("event_id") % 7 > 0, F.col("cog")).otherwise(F.lit(float("nan")))}
    X.positions(spark, sf_dir).withColumns(odd).to(POSITION).write.parquet(path)
    return io.read_positions(spark, path, "C").select("feed", "event_id", "ts", "mmsi", "cog", "longitude")


@query(f'WITH {X.ORACLE_STATIC} SELECT feed, mmsi, "shipType", coalesce("shipTypeDesc", \'Not Available\') AS "shipTypeDesc", "shipName", imo, to_bow, destination FROM vessel_static')
def static_read_back(spark, sf_dir):
    path = fresh_path(spark, "static")
    X.vessel_static(spark, sf_dir).write.parquet(path)
    return io.read_static(spark, path).withColumn("shipTypeDesc", V.default_text(F.col("shipTypeDesc"))).select("feed", "mmsi", "shipType", "shipTypeDesc", "shipName", "imo", "to_bow", "destination")


@query(f'{WITH_P}, {X.oracle_episodes(ALL_ZONES)} SELECT {EPISODE_LIST} FROM episodes WHERE "tsOut" IS NULL')
def episodes_read_back(spark, sf_dir):
    """Open episodes of a stored table; the filter reaches the scan."""
    path = fresh_path(spark, "episodes")
    _episodes(spark, sf_dir).write.parquet(path)
    return P.open_episodes(io.read_episodes(spark, path)).select(EPISODE_COLUMNS)


def _rings(spark, sf_dir) -> DataFrame:
    """A square around the newest place of each vessel as GeoJSON, made of (lat, lon) points with their axes swapped."""
    at = E.latest_positions(X.positions(spark, sf_dir))
    corner = lambda y, x: F.array(F.col("latitude") + F.lit(y), F.col("longitude") + F.lit(x))
    ring = F.array(*[corner(y, x) for y, x in ((-0.01, -0.02), (-0.01, 0.02), (0.01, 0.02), (0.01, -0.02), (-0.01, -0.02))])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(swap_axes(ring)).alias("coordinates"))
    return at.select((F.col("mmsi") - 533000000).cast("int").alias("zone"), F.concat(F.lit("around "), F.col("mmsi").cast("string")).alias("name"), F.lit("vessel").alias("kind"), geometry.alias("geometry"))


@query(f"""{WITH_P}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, event_id DESC) AS n FROM positions) WHERE n = 1)
 SELECT CAST(mmsi - 533000000 AS INTEGER) AS zone, 'around ' || mmsi AS name, 'vessel' AS kind, CAST(4 AS INTEGER) AS edges,
        round(longitude - 2e-2, 6) AS min_lon, round(latitude - 1e-2, 6) AS min_lat, round(longitude + 2e-2, 6) AS max_lon, round(latitude + 1e-2, 6) AS max_lat FROM newest""")
def geojson_zones(spark, sf_dir):
    """Zones read from JSON lines, with the edges and envelopes of their rings."""
    path = fresh_path(spark, "zones")
    _rings(spark, sf_dir).write.json(path)
    zones = read_geojson_zones(spark, path)
    return zones.select("zone", "name", "kind", F.size("edges").alias("edges"), *[F.round(f"bbox.{c}", 6).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


@query(f"{WITH_P} SELECT event_id, CASE WHEN event_id % 5 > 0 THEN ts END AS ts FROM positions")
def parsed_times(spark, sf_dir):
    """Times from text; every fifth is none."""
    text = F.when(F.col("event_id") % 5 > 0, F.col("ts").cast("string")).otherwise(F.concat(F.lit("at "), F.col("ts").cast("string")))
    return X.positions(spark, sf_dir).select("event_id", V.parse_ts(text).alias("ts"))


@query(f"{WITH_P}, {X.oracle_tags(ALL_ZONES)} SELECT substr(CASE WHEN zone = 0 THEN 'restricted-limit' WHEN zone = 10 THEN 'TSS-Northbound' WHEN zone = 11 THEN 'TSS-Southbound' ELSE 'sector' || zone || '-limit' END, 1, 5) AS lane, count(*) AS hits FROM tags GROUP BY 1")
def lane_names(spark, sf_dir):
    """Reports by the short names of their zones."""
    named = F.broadcast(zone_catalog(spark).select("zone", V.lane_short_name(F.col("name")).alias("lane")))
    return zone_hit_counts(spark, sf_dir).join(named, "zone").groupBy("lane").agg(F.sum("hits").alias("hits"))


@query(f"{WITH_P}, {X.oracle_tags((10,))} SELECT event_id, mmsi, longitude, latitude FROM positions JOIN tags USING (event_id)")
def ring_region_filter(spark, sf_dir):
    """Reports inside a lane, by its ring of 58 edges behind its envelope."""
    return P.within_region(X.positions(spark, sf_dir), zone_rings()[10][2]).select("event_id", "mmsi", "longitude", "latitude")


@query(f"""{WITH_P}, {X.oracle_tags((0,), "positions")}, {_corner(0.0, 2.0, 'f')} SELECT event_id, f.lon AS front_lon, f.lat AS front_lat, event_id IN (SELECT event_id FROM tags) AS inside FROM f""")
def view_triangles(spark, sf_dir):
    """The vessel view with its triangles, and whether each report lies in the restricted area (zones without a join)."""
    merged = T.zones_of(X.positions(spark, sf_dir), (0,)).withColumn("shipcatagory", F.lit("others"))
    view = W.vessel_view(merged, merged.select("mmsi").limit(0), triangle_km=2)
    front = F.get("triangle", 0)
    return view.select("event_id", F.round(front[0], 6).alias("front_lon"), F.round(front[1], 6).alias("front_lat"), (F.size("inside") > 0).alias("inside"))


# streams -------------------------------------------------------------------------------------------------------------


def _in_batches(spark, rows: DataFrame, run, batches: int = 3) -> None:
    """Positions that arrive in time ranges, each of as many files as it has partitions; run takes the stream after each."""
    path = fresh_path(spark, "positions")
    rows = rows.to(POSITION)
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    for k in range(batches if first else 1):
        part = rows.where((F.col("ts") >= first + k * (last - first) / batches) & ((F.col("ts") < first + (k + 1) * (last - first) / batches) | F.lit(k == batches - 1))) if first else rows
        part.write.mode("append").parquet(path)
        run(io.stream_positions(spark, path))


def _whole_stream(spark, sf_dir) -> DataFrame:
    """All positions as one stream of as many files as they have partitions."""
    path = fresh_path(spark, "positions")
    X.positions(spark, sf_dir).to(POSITION).write.parquet(path)
    return io.stream_positions(spark, path)


@query(f"{WITH_P}, {X.oracle_episodes(ALL_ZONES)} SELECT {EPISODE_LIST} FROM episodes")
def stream_episodes(spark, sf_dir):
    """Episodes of three micro-batches, with open ones and last reports carried from each to the next."""
    log, write = T.episode_sink(spark, fresh_path(spark, "episodes"), ALL_ZONES)
    checkpoint = fresh_path(spark, "stream")
    _in_batches(spark, X.positions(spark, sf_dir), lambda stream: T.run_available(stream, checkpoint, write, "append"))
    return log.read().select(EPISODE_COLUMNS)


@query(f"{WITH_P} SELECT event_id, ts, mmsi FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, event_id DESC) AS n FROM positions) WHERE n = 1")
def stream_latest(spark, sf_dir):
    path = fresh_path(spark, "latest")
    checkpoint = fresh_path(spark, "stream")
    keep = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/n={n}")
    _in_batches(spark, X.positions(spark, sf_dir), lambda stream: T.run_available(T.latest_position_stream(stream), checkpoint, keep), 2)
    rows = spark.read.parquet(path)
    newest = rows.groupBy("mmsi").agg(F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("x"))
    return newest.select("x.event_id", F.col("x.ts").cast("timestamp_ntz").alias("ts"), "mmsi")


@query(f"{WITH_P} SELECT DISTINCT mmsi, ts FROM positions")
def stream_dedup(spark, sf_dir):
    """Positions of which each comes twice in its poll, and those of the first poll again in the second."""
    path, checkpoint = fresh_path(spark, "dedup"), fresh_path(spark, "stream")
    keep = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/n={n}")
    rows = X.positions(spark, sf_dir).to(POSITION)
    polls = fresh_path(spark, "positions")
    for poll in (rows.where("day(ts) <= 15").union(rows.where("day(ts) <= 15")), rows):
        poll.write.mode("append").parquet(polls)
        T.run_available(T.dedup_stream(io.stream_positions(spark, polls), "2000 hours"), checkpoint, keep, "append")
    return spark.read.parquet(path).select("mmsi", F.col("ts").cast("timestamp_ntz").alias("ts"))


def _answered(spark, sf_dir, every: int) -> DataFrame:
    """Request lines that arrive as text, answered from a static history."""
    path, lines = fresh_path(spark, "answers"), fresh_path(spark, "requests")
    X.requests(spark, sf_dir, every).write.text(lines)
    answers = T.request_stream(spark.readStream.text(lines), X.positions(spark, sf_dir))
    T.run_available(answers, fresh_path(spark, "stream"), lambda df, n: df.write.mode("overwrite").parquet(f"{path}/n={n}"), "append")
    return spark.read.parquet(path).select(F.concat(F.lit("playback:"), F.col("mmsi").cast("string")).alias("value"), "event_id", "mmsi")


@query(f"{WITH_PS} SELECT 'playback:' || p.mmsi AS value, p.event_id, p.mmsi FROM positions p JOIN vessel_static s ON s.mmsi = p.mmsi")
def every_stream_request(spark, sf_dir):
    return _answered(spark, sf_dir, 1)


@query(f"{WITH_P} SELECT feed, count(*) AS n, count(DISTINCT mmsi) AS vessels FROM positions GROUP BY feed")
def stream_union(spark, sf_dir):
    """Two feeds as one stream."""
    path = fresh_path(spark, "union")
    feeds = []
    for f in ("A", "B"):
        at = fresh_path(spark, f"feed-{f}")
        X.positions(spark, sf_dir).where(F.col("feed") == f).to(POSITION).write.parquet(at)
        feeds.append(io.stream_positions(spark, at))
    T.run_available(T.union_feed_stream(*feeds), fresh_path(spark, "stream"), lambda df, n: df.write.mode("overwrite").parquet(f"{path}/n={n}"), "append")
    return spark.read.parquet(path).groupBy("feed").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mmsi").alias("vessels"))


@query(f"{WITH_P}, {X.oracle_episodes(ALL_ZONES)} SELECT {EPISODE_LIST} FROM episodes")
def stream_union_episodes(spark, sf_dir):
    """Two feeds as one stream into one tracker, in two batches that hold reports of both."""
    log, write = T.episode_sink(spark, fresh_path(spark, "episodes"), ALL_ZONES)
    paths, checkpoint = {f: fresh_path(spark, f"feed-{f}") for f in ("A", "B")}, fresh_path(spark, "stream")
    rows = X.positions(spark, sf_dir).to(POSITION)
    for half in (rows.where("day(ts) <= 15"), rows.where("day(ts) > 15")):
        for f, path in paths.items():
            half.where(F.col("feed") == f).write.mode("append").parquet(path)
        T.run_available(T.union_feed_stream(*[io.stream_positions(spark, path) for path in paths.values()]), checkpoint, write, "append")
    return log.read().select(EPISODE_COLUMNS)


@query(BOARD_ROW)
def refreshed_board(spark, sf_dir):
    """The board as the second of two refreshes leaves it, each on all positions that have arrived."""
    path, seen, boards, checkpoint = (fresh_path(spark, n) for n in ("positions", "seen", "boards", "stream"))

    def refresh(batch: DataFrame, n: int) -> None:
        batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.mode("overwrite").parquet(f"{seen}/n={n}")
        so_far = spark.read.schema(POSITION).parquet(seen)
        B.summary_board(E.zone_episodes(so_far, zone_catalog(spark, MOVING_ZONES))).write.mode("overwrite").parquet(f"{boards}/n={n}")

    rows = X.positions(spark, sf_dir).to(POSITION)
    for half in (rows.where("day(ts) <= 15"), rows.where("day(ts) > 15")):
        half.write.mode("append").parquet(path)
        running = T.board_refresh(io.stream_positions(spark, path), refresh, checkpoint, "0 seconds")
        running.processAllAvailable()
        running.stop()
    found = spark.read.parquet(boards)
    return found.where(F.col("n") == found.agg(F.max("n")).first()[0]).drop("n")


@query(f"{BOARD} SELECT sector, lane, count(*) AS vessels FROM pairs GROUP BY sector, lane")
def stream_board(spark, sf_dir):
    """Counts by sector and lane kept by signed changes over three micro-batches."""
    board, change = T.board_keeper(spark, fresh_path(spark, "board"))
    _, write = T.episode_sink(spark, fresh_path(spark, "episodes"), MOVING_ZONES, change)
    checkpoint = fresh_path(spark, "stream")
    _in_batches(spark, X.positions(spark, sf_dir), lambda stream: T.run_available(stream, checkpoint, write, "append"))
    return board.read()


@query(f"{STS}, {_rounds(5)} SELECT array_to_string(list_sort(list_distinct(list(o.bm) || list(o.am))), '|') AS mmsi, o.am AS mmsi_, any_value(name) AS \"shipName\" FROM own o JOIN flagged f ON f.mmsi = o.bm GROUP BY o.am HAVING NOT bool_or(f.first < o.oa) AND bool_and({AT} - o.bts >= INTERVAL 1 HOUR)")
def stream_transfers(spark, sf_dir):
    """Transfers from the open episodes that two micro-batches leave, as a refresh finds them."""
    log, write = T.episode_sink(spark, fresh_path(spark, "episodes"), (0,))
    checkpoint = fresh_path(spark, "stream")
    _in_batches(spark, X.positions(spark, sf_dir), lambda stream: T.run_available(stream, checkpoint, write, "append"), 2)
    return T.transfers_now(log, X.vessel_static(spark, sf_dir), X.AS_OF).select("mmsi", "mmsi_", "shipName")


@query(f"""{STALE} SELECT mmsi, zone, "tsDetected",
  CASE WHEN "tsOut" IS NULL AND "tsDetected" < (SELECT max(ts) FROM positions) - INTERVAL 5 DAY AND mmsi IN (SELECT mmsi FROM gone) THEN (SELECT max(ts) FROM positions) ELSE "tsOut" END AS "tsOut" FROM episodes""")
def stream_stale_close(spark, sf_dir):
    """Stale episodes closed from a stream of newest positions, by the stream's own clock."""
    log, write = T.stale_sink(spark, fresh_path(spark, "episodes"), BOX)
    log.write(-1, E.zone_episodes(P.within_box(X.positions(spark, sf_dir), BOX), zone_catalog(spark, (0,))))
    T.run_available(T.latest_position_stream(_whole_stream(spark, sf_dir)), fresh_path(spark, "stream"), write)
    return log.read().select("mmsi", "zone", "tsDetected", "tsOut")


DUE = '"tsDetected" + INTERVAL 5 DAY'


@query(f"""{NEAR}, {X.oracle_episodes((0,), 'near')}, ended AS (SELECT max(ts) AS ended FROM positions), places AS (SELECT mmsi, ts, event_id, NOT ({IN_BOX}) AS outside FROM positions),
 judged AS (SELECT e.mmsi, e.zone, e."tsDetected", e."tsOut", (SELECT arg_max(p.outside, (p.ts, p.event_id)) FROM places p WHERE p.mmsi = e.mmsi AND p.ts <= e.{DUE}) AS gone,
   (SELECT min(p.ts) FROM places p WHERE p.mmsi = e.mmsi AND p.ts > e.{DUE} AND p.outside) AS later FROM episodes e)
 SELECT mmsi, zone, "tsDetected", least("tsOut", CASE WHEN gone AND {DUE} <= (SELECT ended FROM ended) THEN {DUE} WHEN NOT gone THEN later END) AS "tsOut" FROM judged""")
def stream_stale_timers(spark, sf_dir):
    """Episodes closed as they fall due in four micro-batches, though their vessels may say nothing more."""
    seen, tracked, closings, checkpoint = (fresh_path(spark, n) for n in ("positions", "episodes", "closings", "stream"))
    positions = X.positions(spark, sf_dir).to(POSITION)
    episodes = stored(E.zone_episodes(P.within_box(positions, BOX), zone_catalog(spark, (0,))), "episodes")
    first, last = positions.agg(F.min("ts"), F.max("ts")).first()
    keep = lambda df, n: df.write.mode("overwrite").parquet(f"{closings}/n={n}")
    for k in range(4):
        between = lambda c, k=k: (F.col(c) >= first + k * (last - first) / 4) & ((F.col(c) < first + (k + 1) * (last - first) / 4) | F.lit(k == 3))
        positions.where(between("ts")).write.mode("append").parquet(seen)
        # the tracker tells of an episode when it begins and again when it ends
        begun = episodes.where(between("tsDetected")).withColumn("tsOut", F.lit(None).cast("timestamp_ntz"))
        begun.union(episodes.where(between("tsOut"))).write.mode("append").parquet(tracked)
        found = Z.stale_closings(io.stream_positions(spark, seen), spark.readStream.schema(EPISODE).parquet(tracked), BOX)
        with Z.rocksdb(spark):
            T.run_available(found, checkpoint, keep, "append")
    return Z.with_closings(episodes, spark.read.parquet(closings)).select("mmsi", "zone", "tsDetected", "tsOut")


@query(f"{WITH_P} SELECT event_id, ts, mmsi, longitude FROM positions")
def stream_repolled(spark, sf_dir):
    """All positions from a table that grows between three runs; each run goes on after the newest report of the last."""
    table, out, checkpoint = (fresh_path(spark, n) for n in ("table", "polled", "stream"))
    keep = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/n={n}")

    rows = X.positions(spark, sf_dir).to(POSITION)
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    for k in range(3):
        rows.where((F.col("ts") >= first + k * (last - first) / 3) & ((F.col("ts") < first + (k + 1) * (last - first) / 3) | F.lit(k == 2))).write.mode("append").parquet(table)
        T.run_available(repoll_positions(spark, table), checkpoint, keep, "append")
    return spark.read.parquet(out).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "mmsi", "longitude")
