"""Boards: open vessels by sector, lane and ship type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vessels import default_text
from ..operators.filters import in_zones, open_episodes
from ..sources.zones import LANE_IDS, SECTORS

BOARD_SECTORS = (1, 2, 3, 4, 5, 6)
_SHORT = {10: "North", 11: "South"}


def sector_lane_rows(episodes: DataFrame, sectors=SECTORS, lanes=LANE_IDS) -> DataFrame:
    """Open lane episodes of vessels that are open in a sector, once for each such sector, with sector and lane.

    One pass: a vessel's open episodes in the few zones asked for meet in one row, so episodes are worked out once.
    """
    opened = in_zones(open_episodes(episodes), [*sectors, *lanes])
    fields = [c for c in opened.columns if c not in ("mmsi", "zone")]
    in_sector, in_lane = F.col("zone").isin(*sectors) if sectors else F.lit(False), F.col("zone").isin(*lanes) if lanes else F.lit(False)
    vessels = opened.groupBy("mmsi").agg(F.collect_set(F.when(in_sector, F.col("zone"))).alias("sectors"), F.collect_list(F.when(in_lane, F.struct(F.col("zone").alias("lane"), *fields))).alias("rows"))
    return vessels.select("mmsi", "sectors", F.explode("rows").alias("x")).select("mmsi", "x.*", F.explode("sectors").alias("sector"))


def in_sector_and_lane(episodes: DataFrame, sector: int, lane: int) -> DataFrame:
    """Open lane episodes of vessels that are also open in the sector."""
    opened = open_episodes(episodes)
    return in_zones(opened, (lane,)).join(in_zones(opened, (sector,)).select("mmsi"), "mmsi", "left_semi")


def sector_lane_counts(episodes: DataFrame, sectors=SECTORS, lanes=LANE_IDS) -> DataFrame:
    """sector, lane and the number of rows, for pairs that have any."""
    return sector_lane_rows(episodes, sectors, lanes).groupBy("sector", "lane").agg(F.count(F.lit(1)).alias("vessels"))


def summary_board(episodes: DataFrame, sectors=BOARD_SECTORS, lanes=LANE_IDS) -> DataFrame:
    """One wide row: a count for each sector 1 to 6 and lane, totals by sector, by lane and of all; 0 if not selected."""
    rows = sector_lane_rows(episodes, [s for s in sectors if s in BOARD_SECTORS], lanes)
    name = lambda s, k: f"Sector{s}_{_SHORT[k]}"
    cells = {name(s, k): F.count(F.when((F.col("sector") == s) & (F.col("lane") == k), 1)) for s in BOARD_SECTORS for k in LANE_IDS}
    board = rows.agg(*[c.alias(n) for n, c in cells.items()])
    add = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0]))
    totals = {f"total_sector{s}": add([name(s, k) for k in LANE_IDS]) for s in BOARD_SECTORS}
    totals |= {f"total_tss_{_SHORT[k].lower()}": add([name(s, k) for s in BOARD_SECTORS]) for k in LANE_IDS}
    return board.withColumns(totals | {"total": add(list(cells))})


def board_long(board: DataFrame) -> DataFrame:
    """metric and Total, the board's columns from the last to the first."""
    names = board.columns
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    return board.unpivot([], names, "metric", "Total").withColumn("ordinal", place[F.col("metric")]).orderBy(F.desc("ordinal"))


def ship_type_breakdown(episodes: DataFrame, static: DataFrame, sectors=SECTORS, lanes=LANE_IDS, compat_distinct: bool = False) -> DataFrame:
    """Rows by sector, lane and ship type: Count, ShipTypeNo, ShipType.

    compat_distinct drops sector and lane and then repeated rows, as a union of branches does, which under-counts.
    """
    rows = sector_lane_rows(episodes, sectors, lanes).join(static.select("mmsi", "shipType", "shipTypeDesc"), "mmsi", "left")
    grouped = rows.groupBy("sector", "lane", "shipType", "shipTypeDesc").agg(F.count(F.lit(1)).alias("Count"))
    out = grouped.select("sector", "lane", "Count", F.col("shipType").alias("ShipTypeNo"), default_text(F.col("shipTypeDesc")).alias("ShipType"))
    return (out.select("Count", "ShipTypeNo", "ShipType").distinct() if compat_distinct else out).orderBy("ShipType")


def bar_totals(breakdown: DataFrame) -> DataFrame:
    return breakdown.groupBy("ShipType").agg(F.sum("Count").alias("Total")).orderBy("ShipType")


#: Registers of a vessel sketch, as a power of two: a standard error of 1.04 / sqrt(2 ** SKETCH), 0.8 %.
SKETCH = 14


def vessel_sketches(tagged: DataFrame) -> DataFrame:
    """zone, day and vessels, a HyperLogLog sketch of the vessels with reports in a zone on a day: what boards merge."""
    return tagged.groupBy("zone", F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("mmsi", SKETCH).alias("vessels"))


def merged_vessels(sketches: DataFrame, *by: str) -> DataFrame:
    """The estimated number of distinct vessels over all sketches of each group; the order of merging doesn't matter."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("vessels")).alias("vessels"))
