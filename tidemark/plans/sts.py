"""Suspected ship-to-ship transfers among slow vessels that stay in the restricted zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vessels as V
from ..operators.episodes import newest_open
from ..operators.filters import dwell_longer_than, slow, valid_latitude
from ..operators.proximity import near_pairs
from ..sources.store import stored

#: Above the largest threshold that report fields allow (two 126 m beams, a 511 m stern, 50 m margin).
MOST_METRES = 700.0


def with_static(left: DataFrame, static: DataFrame) -> DataFrame:
    """left with the static attributes of its vessel, null where there are none."""
    return left.join(static.drop("feed"), "mmsi", "left")


def restrict_view(episodes: DataFrame, static: DataFrame, as_of: datetime, hours: float = 0.5, max_sog: float = 0.7) -> DataFrame:
    """Newest open slow episodes last reported more than `hours` ago, with static data and detection limits."""
    view = slow(dwell_longer_than(valid_latitude(newest_open(episodes)), as_of, hours, "tsCurrent"), max_sog)
    view = with_static(view, static)
    length, beam = V.hull_dims(F.col("to_bow"), F.col("to_stern"), F.col("to_port"), F.col("to_starboard"))
    return view.withColumns({
        "shipcatagory": V.ship_category(F.col("shipType")), "cog_v": V.normalize_cog(F.col("cog")), "length_m": length, "beam_m": beam,
        "ts_margin": V.time_margin(as_of, F.col("tsCurrent")), "ts_sog": V.time_sog_limit(as_of, F.col("tsCurrent")),
    })


def sts_pairs(view: DataFrame, max_metres: float = MOST_METRES) -> DataFrame:
    """Directed pairs (structs a, the tanker, and b, its partner; dist) within the pair's own threshold."""
    a, b = F.col("a"), F.col("b")
    limit = V.sts_threshold_m(V.heading_diff(b["cog_v"], a["cog_v"]), b["beam_m"], a["beam_m"], a["to_stern"], b["ts_margin"])
    condition = (a["mmsi"] != b["mmsi"]) & (b["mmsi"] != 0) & (b["sog"] <= b["ts_sog"]) & (F.col("dist") <= limit)
    return near_pairs(view.where(V.is_tanker(F.col("shipType"))), view, max_metres, condition)


def fired_anchors(pairs: DataFrame) -> DataFrame:
    """Anchors that fire when visited by (tsDetected, mmsi), each skipped if an earlier fired one has flagged it.

    pairs: a, b (mmsi) and oa (the anchor's place: tsDetected, mmsi). Every round fires the undecided anchors at which
    no undecided earlier one points, and suppresses their later partners; what is left shrinks, and is stored.
    """
    pending = stored(pairs.select("a", "oa").distinct(), "sts-anchors")
    later = pairs.select("a", "oa", "b").join(pending.select(F.col("a").alias("b"), F.col("oa").alias("ob")), "b").where("oa < ob").select("a", "b").distinct()
    edges = stored(later, "sts-edges")
    fired = None
    while True:
        blocked = edges.select(F.col("b").alias("a")).distinct()
        now = stored(pending.join(blocked, "a", "left_anti"), "sts-fired")
        fired = now if fired is None else fired.union(now)
        hit = edges.join(now.select("a"), "a", "left_semi").select(F.col("b").alias("a")).distinct()
        rest = pending.join(now.select("a"), "a", "left_anti").join(hit, "a", "left_anti")
        pending = stored(rest, "sts-anchors")
        if pending.isEmpty():
            return fired.select("a", "oa")
        left = pending.select("a")
        edges = stored(edges.join(left, "a", "left_semi").join(left.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"), "sts-edges")


def _flags(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of fired anchors, and each flagged vessel with the place of the first anchor that flagged it."""
    named = pairs.select("*", F.col("a.mmsi").alias("am"), F.col("b.mmsi").alias("bm"), F.struct(F.col("a.tsDetected").alias("t"), F.col("a.mmsi").alias("m")).alias("oa"))
    named = stored(named, "sts-pairs")
    fired = fired_anchors(named.select(F.col("am").alias("a"), "oa", F.col("bm").alias("b")))
    own = stored(named.join(fired.select(F.col("a").alias("am")), "am", "left_semi"), "sts-fired-pairs")
    flagged = own.select(F.explode(F.array("am", "bm")).alias("mmsi"), "oa").groupBy("mmsi").agg(F.min("oa").alias("first"))
    return own, flagged


def sts_flagged(view: DataFrame) -> DataFrame:
    """Vessels involved: all fired anchors and their partners."""
    return _flags(sts_pairs(view))[1].select("mmsi")


def detect_sts(view: DataFrame, as_of: datetime, least_seconds: int = 3600, radius: int = 2000) -> DataFrame:
    """One row for each fired anchor none of whose partners was flagged before and all of which have stayed long enough."""
    own, flagged = _flags(sts_pairs(view))
    joined = own.join(flagged.select(F.col("mmsi").alias("bm"), "first"), "bm")
    yes = lambda c: F.max(F.coalesce(c, F.lit(False)))
    groups = joined.groupBy("am").agg(
        F.first("a").alias("a"), F.collect_set("bm").alias("partners"), F.avg("b.longitude").alias("longitude"), F.avg("b.latitude").alias("latitude"),
        F.max(F.col("first") < F.col("oa")).alias("known"), F.min(V.elapsed_seconds(as_of, F.col("b.tsDetected")) >= least_seconds).alias("old"),
        yes(F.col("b.length_m") == 0).alias("zero"), yes(F.col("b.length_m") <= 68).alias("short"),
    ).where(~F.col("known") & F.coalesce("old", F.lit(False)))
    key = F.array_join(F.transform(F.array_sort(F.array_union("partners", F.array("am"))), lambda x: x.cast("string")), "|")
    return groups.select(
        key.alias("mmsi"), F.col("am").alias("mmsi_"), "a.shipName", F.col("a.shipcatagory").alias("shipType"), "a.shipTypeDesc", "a.navStatusDesc", "a.imo", "a.callsign",
        "a.length_m", "a.beam_m", "a.sog", "a.cog", "longitude", "latitude", "a.destination", V.local_time(F.col("a.tsDetected")).alias("lcltime"),
        V.utc_time(F.col("a.tsDetected")).alias("utctime"), V.severity_color(F.col("a.length_m"), F.col("zero"), F.col("short")).alias("color"), F.lit(radius).alias("radius"),
    )


def dwell_report(episodes: DataFrame, static: DataFrame, as_of: datetime, hours: float, max_sog: float = 0.7) -> DataFrame:
    """Open slow episodes detected more than `hours` ago with static data and category, by detection time."""
    view = slow(dwell_longer_than(newest_open(episodes), as_of, hours, "tsDetected"), max_sog)
    return with_static(view, static).withColumn("shipcatagory", V.ship_category(F.col("shipType"))).orderBy("tsDetected", "mmsi")
