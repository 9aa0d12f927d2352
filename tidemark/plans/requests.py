"""Answers to the player's request lines, as the messages that it understands.

A line is `verb:mmsi`: `playback` asks for a vessel's history, `playbackGps` for its GPS samples, `vessel-info` for its
newest static message, and `all-vessel` for the newest position of every vessel. One plan routes all lines of a table to
the four histories; each history is read once, and only vessels that are asked for are shuffled further.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vessels as V
from ..operators import filters as P
from ..sources.io import to_geojson, to_json_records
from ..sources.store import stored
from .views import all_vessel_latest, gps_records, playback_records, track_linestring, vessel_info

#: Verbs, payload tags and end marks of the player's messages.
TRACK, GPS, INFO, ALL = "playback", "playbackGps", "vessel-info", "all-vessel"
LINE, TRACK_DONE, ALL_DONE = "playback-data-geojson", "playback-data-done", "all-vessel-data-done"
#: Place of the mark that ends an answer whose records are placed by mmsi.
LAST = (1 << 63) - 1


@dataclass
class Histories:
    """What requests are answered from: positions (ts, event_id), GPS samples (ts in epoch ms, event_id), static messages (ts in epoch ms, message_id)."""

    positions: DataFrame
    gps: DataFrame
    static: DataFrame


def asked(requests: DataFrame) -> DataFrame:
    """verb and mmsi of well-formed lines, each once; `all-vessel` needs no mmsi, other verbs without one ask for nothing."""
    verb, mmsi = V.split_command(F.col("value"))
    rows = requests.select(verb.alias("verb"), mmsi.alias("mmsi"))
    alone = F.when(F.col("verb") == ALL, F.lit(None)).otherwise(F.col("mmsi")).cast("bigint")
    known = F.col("verb").isin(TRACK, GPS, INFO) & F.col("mmsi").isNotNull() | (F.col("verb") == ALL)
    return rows.where(known).select("verb", alone.alias("mmsi")).distinct()


def _of(history: DataFrame, lines: DataFrame, verb: str) -> DataFrame:
    return history.join(lines.where(F.col("verb") == verb).select("mmsi"), "mmsi", "left_semi")


def _named(verb: str) -> Column:
    return F.concat(F.lit(f"{verb}:"), F.col("mmsi").cast("string")).alias("request")


def _track(rows: DataFrame, records: DataFrame, verb: str, longitude: str, latitude: str) -> DataFrame:
    """A record for each sample in time order, the end mark, and the line as GeoJSON."""
    order = Window.partitionBy("mmsi").orderBy("ts", "event_id")
    text = to_json_records(records, TRACK, [c for c in records.columns if c not in ("mmsi", "ts", "event_id", "payload")], keep=("mmsi", "ts", "event_id"))
    samples = text.select(_named(verb), F.row_number().over(order).cast("bigint").alias("ord"), F.col("value").alias("message"))
    ends = rows.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n")).select(_named(verb), (F.col("n") + 1).alias("ord"), F.lit(TRACK_DONE).alias("message"))
    places = track_linestring(rows.select("mmsi", "ts", "event_id", F.col(longitude).alias("longitude"), F.col(latitude).alias("latitude")))
    lines = to_geojson(places.withColumn("n", F.size("points").cast("bigint")), LINE, keep=("n",)).select(_named(verb), (F.col("n") + 2).alias("ord"), F.col("value").alias("message"))
    return samples.unionByName(ends).unionByName(lines)


def answers(requests: DataFrame, histories: Histories) -> DataFrame:
    """request, ord and message: each distinct well-formed line's messages, numbered in the order in which they are sent.

    Lines that no rule knows, and vessels without rows, have no messages. `all-vessel` lines are one request, whatever
    follows the verb; its records are placed by mmsi, and the mark that ends them comes last.
    """
    lines = stored(asked(requests), "asked-lines")
    positions, gps = _of(histories.positions, lines, TRACK), _of(P.moving(histories.gps), lines, GPS)
    out = _track(positions, playback_records(positions, keep=("mmsi", "ts", "event_id")), TRACK, "longitude", "latitude")
    out = out.unionByName(_track(gps, gps_records(gps, keep=("mmsi", "ts", "event_id")), GPS, "lng", "lat"))
    info = vessel_info(_of(histories.static, lines, INFO), keep=("mmsi",))
    text = to_json_records(info, INFO, [c for c in info.columns if c not in ("mmsi", "payload")], keep=("mmsi",))
    out = out.unionByName(text.select(_named(INFO), F.lit(1).cast("bigint").alias("ord"), F.col("value").alias("message")))
    if lines.where(F.col("verb") == ALL).isEmpty():
        return out
    latest = all_vessel_latest(histories.positions, keep=("mmsi",))
    text = to_json_records(latest, ALL, [c for c in latest.columns if c not in ("mmsi", "payload")], keep=("mmsi",))
    out = out.unionByName(text.select(F.lit(ALL).alias("request"), F.col("mmsi").alias("ord"), F.col("value").alias("message")))
    end = lines.where(F.col("verb") == ALL).select(F.lit(ALL).alias("request"), F.lit(LAST).alias("ord"), F.lit(ALL_DONE).alias("message"))
    return out.unionByName(end)
