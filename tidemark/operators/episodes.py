"""Zone tags and enter / stay / exit episodes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import in_box, within
from ..functions.vessels import as_time, older_than
from ..sources.schemas import EPISODE
from .filters import open_episodes

KINEMATICS = ("longitude", "latitude", "rot", "cog", "sog", "trueHeading")
FIRST = ("navStatus", "navStatusDesc")


def located(positions: DataFrame) -> DataFrame:
    """Rows with both coordinates."""
    return positions.where("longitude IS NOT NULL AND latitude IS NOT NULL AND NOT isnan(longitude) AND NOT isnan(latitude)")


def tag_zones(positions: DataFrame, zones: DataFrame) -> DataFrame:
    """One row for each position and zone that strictly holds it, by the grid cells that cover the zones.

    zones: a catalogue of any number of rings (zone, edges, bbox), each zone once. Each zone is covered by cells of a
    size that suits its own (zone_cells); positions are joined to the cells they lie in, once for each size there is. A
    cell within a zone needs no test, one on its boundary brings the zone's edges. Positions without coordinates lie in
    no zone.
    """
    cells = zone_cells(zones)
    found = cells.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size("edges"), F.lit(0))).alias("edges")).collect()
    levels = sorted(r.level for r in found)
    small = sum(60 * r.n + 40 * max(r.edges, 0) for r in found) <= SENT
    cells = F.broadcast(cells) if small else cells.hint("merge")
    rows = located(positions)
    if not levels:
        return rows.withColumn("zone", F.lit(None).cast("int")).limit(0)
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), *[_cell(F.col(c), k).alias(n) for c, n in (("longitude", "cx"), ("latitude", "cy"))]) for k in levels]))
    met = rows.withColumn("__at", at).select("*", "__at.*").drop("__at").join(cells, ["level", "cx", "cy"]).drop("level", "cx", "cy")
    held = F.col("edges").isNull() | within(F.col("longitude"), F.col("latitude"), F.col("edges"))
    return met.where(held).drop("edges")


#: Cells of a zone along the longer side of its envelope: from half as many to this number, and one more.
CELLS = 16
#: Bytes of cells, at 60 each and 40 for each edge, up to which they are sent to all tasks; more are joined by a shuffle.
SENT = 16 << 20
#: Cell sizes are powers of two from the first to the last of these exponents, in degrees.
FINEST, COARSEST = -20, 5


def _cell(x: Column, level: Column | int) -> Column:
    return F.floor(x / (F.lit(2.0**level) if isinstance(level, int) else F.pow(F.lit(2.0), level))).cast("long")


def zone_cells(zones: DataFrame) -> DataFrame:
    """zone, level, cx, cy and edges of the grid cells that hold some of a zone; edges are null where no ring crosses the cell.

    A cell is 2 ** level degrees wide. The cell's four corners and centre lie on the same side of each edge that doesn't
    cross it, so an uncrossed cell lies within the zone if its centre does, and is left out if not.
    """
    box = F.col("bbox")
    extent = F.greatest(box["max_lon"] - box["min_lon"], box["max_lat"] - box["min_lat"])
    level = F.when(extent > 0, F.ceil(F.log2(extent / CELLS)).cast("int")).otherwise(F.lit(FINEST))
    rows = zones.select("zone", "edges", "bbox", F.least(F.greatest(level, F.lit(FINEST)), F.lit(COARSEST)).alias("level"))
    span = lambda low, high: F.explode(F.sequence(_cell(box[low], F.col("level")), _cell(box[high], F.col("level"))))
    rows = rows.withColumn("cx", span("min_lon", "max_lon")).withColumn("cy", span("min_lat", "max_lat"))
    size = F.pow(F.lit(2.0), F.col("level"))
    west, south = F.col("cx") * size, F.col("cy") * size
    east, north = west + size, south + size

    def crosses(e: Column) -> Column:
        """Does the edge meet the closed cell? The envelopes overlap and not all corners lie strictly on one side of the line."""
        apart = (F.least(e["x1"], e["x2"]) > east) | (F.greatest(e["x1"], e["x2"]) < west) | (F.least(e["y1"], e["y2"]) > north) | (F.greatest(e["y1"], e["y2"]) < south)
        side = [(e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]) for x in (west, east) for y in (south, north)]
        # an edge this near counts as crossing, so that rounding never does away with a test
        near = (F.abs(e["x2"] - e["x1"]) + F.abs(e["y2"] - e["y1"])) * (size * 1e-9 + 1e-12)
        return ~apart & ~((F.least(*side) > near) | (F.greatest(*side) < -near))

    rows = rows.withColumn("crossed", F.exists("edges", crosses))
    inner = within((west + east) / 2, (south + north) / 2, F.col("edges"))
    return rows.where(F.col("crossed") | inner).select("zone", "level", "cx", "cy", F.when(F.col("crossed"), F.col("edges")).alias("edges"))


def zone_episodes(positions: DataFrame, zones: DataFrame, tie: str = "event_id") -> DataFrame:
    """Episodes of every vessel and zone: consecutive reports inside, in (ts, tie) order over all reports given.

    First report: tsDetected and navigation status; last report: tsCurrent and kinematics; the vessel's next report,
    if there is one, gives tsOut. One shuffle, by vessel. An envelope filter belongs before this.
    """
    by_vessel = Window.partitionBy("mmsi").orderBy("ts", tie)
    rows = located(positions).withColumn("rn", F.row_number().over(by_vessel)).withColumn("nxt", F.lead("ts").over(by_vessel))
    tagged = tag_zones(rows, zones)
    island = F.col("rn") - F.row_number().over(Window.partitionBy("mmsi", "zone").orderBy("rn"))
    last = F.max(F.struct("rn", F.struct("ts", "nxt", *KINEMATICS).alias("x")))["x"]
    first = F.min(F.struct("rn", F.struct("ts", *FIRST).alias("x")))["x"]
    grouped = tagged.withColumn("island", island).groupBy("mmsi", "zone", "island").agg(first.alias("f"), last.alias("l"))
    return grouped.select(
        F.lit(None).cast("bigint").alias("id"), F.col("f.ts").alias("tsDetected"), F.col("l.ts").alias("tsCurrent"), F.col("l.nxt").alias("tsOut"), "mmsi",
        *[F.col(f"f.{c}") for c in FIRST], *[F.col(f"l.{c}") for c in KINEMATICS], "zone",
    ).select(*EPISODE.names)


def newest_open(episodes: DataFrame) -> DataFrame:
    """The newest open episode of each vessel and zone."""
    newest = Window.partitionBy("mmsi", "zone").orderBy(F.desc("tsDetected"), F.desc_nulls_last("id"))
    return open_episodes(episodes).withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def latest_positions(positions: DataFrame, tie: str = "event_id") -> DataFrame:
    """Each vessel's newest report."""
    newest = Window.partitionBy("mmsi").orderBy(F.desc("ts"), F.desc(tie))
    return positions.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def match_open_episode(positions: DataFrame, episodes: DataFrame) -> DataFrame:
    """Tagged positions with tsDetected of the open episode of their vessel and zone, or null."""
    known = newest_open(episodes).select("mmsi", "zone", F.col("tsDetected").alias("openSince"))
    return positions.join(known, ["mmsi", "zone"], "left")


def positions_of_stale(positions: DataFrame, episodes: DataFrame, as_of: datetime, days: float = 5) -> DataFrame:
    """Positions of vessels with an open episode detected more than `days` ago."""
    stale = open_episodes(episodes).where(older_than(as_of, F.col("tsDetected"), 24 * days)).select("mmsi")
    return positions.join(stale, "mmsi", "left_semi")


def close_episodes(episodes: DataFrame, vessels: DataFrame, as_of: datetime) -> DataFrame:
    """Open episodes of the given vessels (column mmsi) get tsOut = as_of; closed ones stay as they are."""
    flag = vessels.select("mmsi").distinct().withColumn("__close", F.lit(True))
    out = F.when(F.col("tsOut").isNull() & F.col("__close"), as_time(as_of)).otherwise(F.col("tsOut"))
    return episodes.join(flag, "mmsi", "left").withColumn("tsOut", out).drop("__close").select(*episodes.columns)


def stale_vessels(positions: DataFrame, episodes: DataFrame, as_of: datetime, box: tuple[float, float, float, float], days: float = 5) -> DataFrame:
    """Vessels with an episode open for more than `days` whose latest position lies outside the box."""
    latest = latest_positions(located(positions_of_stale(positions, episodes, as_of, days)))
    return latest.where(~in_box(F.col("longitude"), F.col("latitude"), box)).select("mmsi")


def close_stale(positions: DataFrame, episodes: DataFrame, as_of: datetime, box: tuple[float, float, float, float], days: float = 5) -> DataFrame:
    """Episodes where those open for more than `days` of vessels gone from the box are closed at as_of."""
    gone = stale_vessels(positions, episodes, as_of, box, days).withColumn("__gone", F.lit(True))
    old = F.col("tsOut").isNull() & older_than(as_of, F.col("tsDetected"), 24 * days) & F.coalesce("__gone", F.lit(False))
    return episodes.join(gone, "mmsi", "left").withColumn("tsOut", F.when(old, as_time(as_of)).otherwise(F.col("tsOut"))).select(*episodes.columns)
