"""The merged vessel view, playback and the zone monitor."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vessels as V
from ..functions.geo import heading_triangle
from ..operators import filters as P
from ..operators.episodes import close_stale, latest_positions, newest_open, zone_episodes
from ..sources.io import upsert_episodes
from ..sources.zones import region_box
from .sts import with_static

LIVE_KEYS = ("ts", "mmsi")


def merged_feeds(pos_a: DataFrame, static_a: DataFrame, pos_b: DataFrame, static_b: DataFrame, as_of: datetime, hours: float | None = 240) -> DataFrame:
    """Valid positions of both feeds with their own static data; only feed A is limited to the look-back."""
    a, b = (P.valid_mmsi(P.valid_latitude(p)) for p in (pos_a, pos_b))
    a = P.lookback(a, as_of, hours) if hours is not None else a
    rows = with_static(a, static_a).unionByName(with_static(b, static_b))
    length, beam = V.hull_dims(F.col("to_bow"), F.col("to_stern"), F.col("to_port"), F.col("to_starboard"))
    return rows.withColumns({"shipcatagory": V.ship_category(F.col("shipType")), "length_m": length, "beam_m": beam})


def vessel_view(merged: DataFrame, flagged: DataFrame, triangle_km: float | None = 2, compat_alpha: bool = False) -> DataFrame:
    """Merged positions with colours, times, a flag for vessels in flagged (column mmsi) and the heading triangle."""
    view = merged.join(flagged.select("mmsi").distinct().withColumn("__flag", F.lit(1)), "mmsi", "left")
    view = view.withColumn("area_loc", F.coalesce("__flag", F.lit(0))).drop("__flag")
    view = view.withColumn("shipcolor", V.category_color(F.col("shipcatagory")))
    view = view.withColumns({"shipcolor2": V.highlight(F.col("shipcolor"), F.col("area_loc"), compat_alpha), "lcltime": V.local_time(F.col("ts")), "utctime": V.utc_time(F.col("ts"))})
    if triangle_km is not None:
        corners = heading_triangle(F.col("latitude"), F.col("longitude"), F.col("cog"), triangle_km)
        view = view.withColumn("triangle", F.array(*[F.array(lon, lat) for lon, lat in corners]))
    return view


def track_index(df: DataFrame, tie: str = "event_id") -> DataFrame:
    """Samples of each vessel numbered from 0 in time order."""
    return df.withColumn("idx", F.row_number().over(Window.partitionBy("mmsi").orderBy("ts", tie)) - 1)


def every_nth(df: DataFrame, n: int = 20, tie: str = "event_id") -> DataFrame:
    return track_index(df, tie).where((F.col("idx") + 1) % n == 0)


def track_markers(df: DataFrame, tie: str = "event_id") -> DataFrame:
    """mmsi, samples, and time and place of the first, middle (index ceil((n - 1) / 2)) and last sample."""
    rows = track_index(df, tie).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("mmsi")))
    at = {"first": F.lit(0), "middle": F.ceil((F.col("n") - 1) / 2), "last": F.col("n") - 1}
    picks = [F.max(F.when(F.col("idx") == i, F.col(c))).alias(f"{m}_{c}") for m, i in at.items() for c in ("ts", "longitude", "latitude")]
    return rows.groupBy("mmsi").agg(F.max("n").alias("samples"), *picks)


def track_linestring(df: DataFrame, tie: str = "event_id") -> DataFrame:
    """mmsi and points, the vessel's places in time order."""
    ordered = F.sort_array(F.collect_list(F.struct("ts", tie, "longitude", "latitude")))
    return df.groupBy("mmsi").agg(F.transform(ordered, lambda p: F.struct(p["longitude"].alias("lon"), p["latitude"].alias("lat"))).alias("points"))


def track_pieces(df: DataFrame, most: int = 1_000, tie: str = "event_id") -> DataFrame:
    """mmsi, piece (from 0) and points: tracks of any length in pieces of at most `most` points and the first of the next.

    No row grows with its vessel's reports; joined end to end, without the repeated points, the pieces are track_linestring.
    """
    rows = track_index(df, tie).withColumn("piece", F.floor(F.col("idx") / most).cast("long"))
    # the first point of a piece ends the one before it too
    at = F.when((F.col("idx") > 0) & (F.col("idx") % most == 0), F.array(F.col("piece") - 1, F.col("piece"))).otherwise(F.array("piece"))
    parts = rows.select("mmsi", F.explode(at).alias("piece"), F.struct("idx", "longitude", "latitude").alias("p")).groupBy("mmsi", "piece").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return parts.select("mmsi", "piece", F.transform("p", lambda p: F.struct(p["longitude"].alias("lon"), p["latitude"].alias("lat"))).alias("points"))


def drop_consecutive_repeats(df: DataFrame, order: str = "event_id") -> DataFrame:
    """Rows but those equal in (ts, mmsi) to the row that arrived just before them.

    order numbers the arrivals without gaps, so that a row's predecessor is known within its own (ts, mmsi) and no
    window over all rows is needed.
    """
    before = F.lag(order).over(Window.partitionBy(*LIVE_KEYS).orderBy(order))
    return df.withColumn("__b", before).where(F.col("__b").isNull() | (F.col(order) - F.col("__b") != 1)).drop("__b")


def _sample(ts: Column, longitude: str, latitude: str, *more: Column) -> list[Column]:
    return [ts.alias("m_ts"), F.col("mmsi").cast("string").alias("m_mmsi"), F.col(longitude).alias("m_long"), F.col(latitude).alias("m_lat"), *more]


def playback_records(history: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Track samples with the names that the player expects; times are local. keep: columns to go along."""
    more = F.col("sog").alias("m_sog"), F.col("cog").alias("m_cog"), F.lit(0).alias("cmap"), F.lit("playback").alias("payload")
    return history.select(*keep, *_sample(V.local_time(F.col("ts")), "longitude", "latitude", *more))


def playback_gps(gps: DataFrame) -> DataFrame:
    """Moving GPS samples as positions: epoch milliseconds become UTC times."""
    rows = P.moving(gps)
    more = ["rot"] if "rot" in rows.columns else []
    return rows.select(V.epoch_ms_to_ts(F.col("ts")).alias("ts"), "mmsi", F.col("lng").alias("longitude"), F.col("lat").alias("latitude"), *more, "cog")


def gps_records(gps: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Moving GPS samples with the names that the player expects: UTC times, and the rate of turn instead of the speed."""
    more = F.col("rot").alias("m_rot"), F.col("cog").alias("m_cog"), F.lit(0).alias("cmap"), F.lit("playback").alias("payload")
    return P.moving(gps).select(*keep, *_sample(V.time_text(V.epoch_ms_to_ts(F.col("ts"))), "lng", "lat", *more))


def tracks_for_requests(requests: DataFrame, history: DataFrame) -> DataFrame:
    """History of the vessel that each `playback:<mmsi>` line asks for; malformed lines ask for nothing."""
    verb, mmsi = V.split_command(F.col("value"))
    asked = requests.select("value", verb.alias("verb"), mmsi.alias("mmsi")).where((F.col("verb") == "playback") & F.col("mmsi").isNotNull())
    return history.join(asked, "mmsi")


def all_vessel_latest(positions: DataFrame, prefix: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each vessel's newest position as records."""
    latest = latest_positions(P.valid_mmsi(positions, positive=True))
    latest = P.by_mmsi_prefix(latest, prefix) if prefix else latest
    return latest.select(*keep, *_sample(V.local_time(F.col("ts")), "longitude", "latitude", F.col("cog").alias("m_cog"), F.lit("all-vessel").alias("payload")))


def latest_static(messages: DataFrame, mmsi: int | None = None, tie: str | None = None) -> DataFrame:
    """The newest static message of each vessel, by ts and then by tie."""
    rows = P.by_mmsi(messages, mmsi) if mmsi is not None else messages
    newest = F.struct("ts", tie) if tie else F.col("ts")
    return rows.groupBy("mmsi").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "mmsi"]), newest).alias("x")).select("mmsi", "x.*")


#: Names of the static record, and the fields that they hold as text.
INFO_FIELDS = {
    "m_mmsi": "mmsi", "m_shiptype": "shipType", "m_shipname": "shipName", "m_imo": "imo", "m_callsign": "callsign",
    "m_toStarboard": "to_starboard", "m_toPort": "to_port", "m_toStern": "to_stern", "m_toBow": "to_bow",
}


def vessel_info(messages: DataFrame, tie: str = "message_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The newest static message (ts in epoch ms) of each vessel as records; what a message doesn't say is null."""
    fields = [F.col(c).cast("string").alias(n) for n, c in INFO_FIELDS.items()]
    return latest_static(messages, tie=tie).select(*keep, V.time_text(V.epoch_ms_to_ts(F.col("ts"))).alias("m_ts"), *fields, F.lit("vessel-info").alias("payload"))


def extract_history(source: DataFrame, mmsi: int, start: datetime, end: datetime) -> DataFrame:
    """One vessel's track columns in a time range, in time order."""
    rows = P.time_range(P.valid_longitude(P.by_mmsi(source, mmsi)), start, end)
    return P.select_track_columns(rows).orderBy("ts")


def monitor_zone(positions: DataFrame, episodes: DataFrame, zones: DataFrame, as_of: datetime, hours: float | None = 96, region: str = "restricted") -> DataFrame:
    """Episodes after one cycle: recent positions inside the outer envelope extend, close or open episodes; stale ones close.

    The open episode of a vessel and zone goes on if its vessel's first new reports lie in the zone, and ends at the
    first new report outside it; reports already counted (up to tsCurrent) change nothing, so cycles can be repeated.
    """
    box = region_box(region)
    recent = P.valid_latitude(positions)
    recent = P.lookback(recent, as_of, hours) if hours is not None else recent
    near = P.within_box(recent, box)
    opened = newest_open(episodes)
    # an open episode stands in as a report at its last known place and time
    carried = opened.select(*[F.col(c) for c in opened.columns if c in near.columns and c not in ("ts", "event_id", "feed")], F.col("tsCurrent").alias("ts"))
    seen = near.join(opened.groupBy("mmsi").agg(F.max("tsCurrent").alias("__seen")), "mmsi", "left").where("__seen IS NULL OR ts > __seen").drop("__seen")
    rows = seen.unionByName(carried.withColumn("event_id", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    found = zone_episodes(rows, zones)
    was = opened.select(F.col("mmsi").alias("__mmsi"), F.col("zone").alias("__zone"), F.col("id").alias("__id"), F.col("tsDetected").alias("__since"), F.col("tsCurrent").alias("__at"), F.col("navStatus").alias("__ns"), F.col("navStatusDesc").alias("__nd"))
    # the island that begins at the carried report is the open episode itself
    joined = found.join(was, (F.col("mmsi") == F.col("__mmsi")) & (F.col("zone") == F.col("__zone")) & (F.col("tsDetected") == F.col("__at")), "left")
    keep = lambda new, old: F.when(F.col("__since").isNotNull(), F.col(old)).otherwise(F.col(new))
    changes = joined.withColumns({"navStatus": keep("navStatus", "__ns"), "navStatusDesc": keep("navStatusDesc", "__nd"), "id": keep("id", "__id"), "tsDetected": keep("tsDetected", "__since")}).select(*episodes.columns)
    return close_stale(recent, upsert_episodes(episodes, changes), as_of, box)
