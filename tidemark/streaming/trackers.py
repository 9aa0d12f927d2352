"""Structured Streaming forms of the trackers."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import in_box, within
from ..functions.vessels import split_command
from ..operators.episodes import FIRST, close_stale, latest_positions, located, zone_episodes
from ..plans.boards import sector_lane_counts
from ..plans.requests import Histories, answers
from ..plans.sts import detect_sts, restrict_view
from ..sources.schemas import BOARD, EPISODE, POSITION
from ..sources.store import EpisodeLog, SnapshotStore, fresh_path, stored
from ..sources.zones import RESTRICTED, zone_catalog, zone_rings, zone_row


def union_feed_stream(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both feeds as one stream, so that one tracker writes the episodes."""
    return a.unionByName(b)


def zones_of(df: DataFrame, zones) -> DataFrame:
    """df with inside, the ids of the given fixed zones that strictly hold the position; no join, so fit for streams."""
    rings = zone_rings()

    def literal(row: tuple) -> F.Column:
        zone, _, _, _, edges, box = row
        as_edge = lambda e: F.struct(*[F.lit(v).alias(n) for v, n in zip(e, ("x1", "y1", "x2", "y2"), strict=True)])
        as_box = F.struct(*[F.lit(v).alias(n) for v, n in zip(box, ("min_lon", "min_lat", "max_lon", "max_lat"), strict=True)])
        return F.struct(F.lit(zone).alias("zone"), F.array(*map(as_edge, edges)).alias("edges"), as_box.alias("bbox"))

    catalogue = F.array(*[literal(zone_row(z, *rings[z])) for z in zones])
    lon, lat = F.col("longitude"), F.col("latitude")
    return df.withColumn("inside", F.transform(F.filter(catalogue, lambda z: in_box(lon, lat, z["bbox"]) & within(lon, lat, z["edges"])), lambda z: z["zone"]))


def new_reports(batch: DataFrame, last: DataFrame) -> DataFrame:
    """Located reports of a batch that are later than their vessel's last one; repeated and late ones change nothing."""
    at = F.struct("ts", "event_id")
    seen = last.select("mmsi", at.alias("__at"))
    return located(batch).join(seen, "mmsi", "left").where(F.col("__at").isNull() | (at > F.col("__at"))).select(*POSITION.names)


def advance(fresh: DataFrame, last: DataFrame, opened: DataFrame, zones: DataFrame) -> DataFrame:
    """Changed and new episodes after a batch of new reports.

    last: one report of each vessel so far. It stands in front of the new ones, so the island that begins at it is the
    open episode of its vessel and zone, which goes on or ends.
    """
    found = zone_episodes(last.join(fresh.select("mmsi").distinct(), "mmsi", "left_semi").unionByName(fresh), zones)
    # reports at one time are told apart by their ids, and so may be islands that begin at it
    first = F.row_number().over(Window.partitionBy("mmsi", "zone").orderBy("tsDetected", "tsCurrent", F.asc_nulls_last("tsOut"))) == 1
    was = opened.select("mmsi", "zone", *[F.col(c).alias(f"__{c}") for c in ("id", "tsDetected", *FIRST)])
    joined = found.withColumn("__first", first).join(was, ["mmsi", "zone"], "left")
    goes_on = F.col("__first") & F.col("__tsDetected").isNotNull()
    kept = {c: F.when(goes_on, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("id", "tsDetected", *FIRST)}
    return joined.withColumns(kept).select(*EPISODE.names)


def _arrived(spark: SparkSession, batch: DataFrame) -> DataFrame:
    """A batch as a stored table of the given session.

    A stream plans in a session of its own without adaptive execution, where each shuffle has as many tasks as are set
    however few rows a batch brings, and what is joined to a batch there follows.
    """
    path = fresh_path(spark, "reports")
    batch.write.parquet(path)
    return spark.read.schema(batch.schema).parquet(path)


#: What a sink is told of a batch: the open episodes of the vessels that changed, before and after it, and its number.
Changed = Callable[[DataFrame, DataFrame, int], None]


def episode_sink(spark: SparkSession, path: str, zones, changed: Changed | None = None) -> tuple[EpisodeLog, Callable[[DataFrame, int], None]]:
    """A log of episodes and the foreachBatch function for reports (ts as a timestamp) that keeps it; repeated batches change nothing."""
    log, catalogue = EpisodeLog(spark, path), zone_catalog(spark, tuple(zones))

    def write(reports: DataFrame, batch: int) -> None:
        opened, last = log.open.previous(batch), log.last.previous(batch)
        # stored and not cached: the plan of a cached table keeps all its shuffle tasks
        fresh = stored(new_reports(_arrived(spark, reports.withColumn("ts", F.col("ts").cast("timestamp_ntz"))), last), "new-reports")
        changes = stored(advance(fresh, last, opened, catalogue), "changed-episodes")
        others = opened.join(changes.select("mmsi", "zone").distinct(), ["mmsi", "zone"], "left_anti")
        if changed:
            vessels = changes.select("mmsi").distinct()
            of = lambda episodes: episodes.where("tsOut IS NULL").join(vessels, "mmsi", "left_semi")
            changed(of(opened), of(others.unionByName(changes)), batch)
        log.write(batch, others.unionByName(changes), latest_positions(last.unionByName(fresh)))

    return log, write


def board_keeper(spark: SparkSession, path: str) -> tuple[SnapshotStore, Changed]:
    """A store of the counts by sector and lane, and what keeps it by signed changes, to be given to episode_sink.

    A batch costs the vessels that it changes: their rows before are taken off and those after are added. The board has
    a row for each sector and lane with vessels; two snapshots are kept. A batch that runs again begins at the same one.
    """
    store = SnapshotStore(spark, path, BOARD)

    def change(before: DataFrame, after: DataFrame, batch: int) -> None:
        less = sector_lane_counts(before).withColumn("vessels", -F.col("vessels"))
        cells = store.previous(batch).unionByName(sector_lane_counts(after)).unionByName(less)
        store.write(cells.groupBy("sector", "lane").agg(F.sum("vessels").alias("vessels")).where("vessels <> 0"), batch)

    return store, change


def transfers_now(log: EpisodeLog, static: DataFrame, as_of: datetime) -> DataFrame:
    """Transfers among the vessels that are open in the restricted zone now: the snapshot of open episodes is read, not their history."""
    return detect_sts(stored(restrict_view(log.open.read().where(F.col("zone").isin(*RESTRICTED)), static, as_of), "restrict-view"), as_of)


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Runs a stream over what is there now and waits for its end."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def dedup_stream(positions: DataFrame, lateness: str = "96 hours") -> DataFrame:
    """Positions without repeats of (mmsi, ts)."""
    return positions.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["mmsi", "ts"])


def latest_position_stream(positions: DataFrame, mmsi: int | None = None) -> DataFrame:
    """The newest report of each vessel so far (update mode)."""
    rows = positions if mmsi is None else positions.where(F.col("mmsi") == mmsi)
    fields = [c for c in rows.columns if c != "mmsi"]
    return rows.groupBy("mmsi").agg(F.max_by(F.struct(*fields), F.struct("ts", "event_id")).alias("x")).select("mmsi", "x.*")


def request_stream(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Answers to `playback:<mmsi>` lines from a static history."""
    verb, mmsi = split_command(F.col("value"))
    asked = requests.select(verb.alias("verb"), mmsi.alias("mmsi")).where("verb = 'playback' AND mmsi IS NOT NULL")
    return asked.join(history, "mmsi")


def answer_sink(histories: Histories, path: str) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function that answers the request lines (value) of a batch, of all verbs, into a folder of its own."""

    def write(requests: DataFrame, batch: int) -> None:
        answers(requests, histories).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def stale_sink(spark: SparkSession, path: str, box: tuple[float, float, float, float], days: float = 5) -> tuple[EpisodeLog, Callable[[DataFrame, int], None]]:
    """A log of episodes and the foreachBatch function for newest positions that closes stale ones in it.

    Positions come from latest_position_stream; the newest time so far is the clock, so a run can be repeated. The log
    keeps the last position of each vessel, so those that a batch doesn't mention are judged too. stale.stale_closings
    does the same by timers, at the time when an episode falls due and not at that of the next batch.
    """
    log = EpisodeLog(spark, path)

    def write(latest: DataFrame, batch: int) -> None:
        rows = latest.withColumn("ts", F.col("ts").cast("timestamp_ntz")).to(POSITION)
        known = latest_positions(log.last.previous(batch).unionByName(rows)).persist()
        now = known.agg(F.max("ts")).first()[0]
        if now is not None:
            log.write(batch, close_stale(known, log.open.previous(batch), now, box, days), known)
        known.unpersist()

    return log, write


def board_refresh(positions: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, every: str = "100 seconds"):
    """Starts a query that calls refresh with each batch (to recompute boards on the current snapshot)."""
    return positions.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(refresh).start()
