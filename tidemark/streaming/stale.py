"""Closing stale episodes by event-time timers, so that a vessel that says nothing more is closed too.

Keyed state, of vessels by bucket, holds for each its last report (was it outside the box?) and its open episodes with the time when
each falls due. The rule depends on event time alone, not on how reports are cut into batches:

* an open episode is due `days` after it was detected; if the vessel's last report up to then lies outside the box, it
  closes at that time, by a report that is later or, where none comes, by a timer once the watermark has passed;
* a vessel inside the box at that time keeps its episode until its first report outside.

Episodes that their tracker closes, or that it opens again, arrive as events beside the reports.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.geo import in_box
from ..operators.episodes import located

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: What happened: order among events of one time, as a tracker opens at a report and closes at a later one.
CLOSED, REPORT, OPENED = 0, 1, 2
#: Groups of vessels; a checkpoint belongs to the number it was begun with.
BUCKETS = 512
CLOSINGS = "mmsi long, zone int, detected long, closed long"


def report_events(positions: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Located reports (ts as a timestamp) as events."""
    outside = ~in_box(F.col("longitude"), F.col("latitude"), box)
    none = F.lit(None)
    return located(positions).select("mmsi", "ts", F.lit(REPORT).alias("kind"), "event_id", outside.alias("outside"), none.cast("int").alias("zone"), none.cast("long").alias("detected"))


def episode_events(episodes: DataFrame) -> DataFrame:
    """Openings, at tsDetected, and closings, at tsOut, of a tracker's episodes as events."""
    detected = F.unix_micros(F.col("tsDetected").cast("timestamp"))
    both = F.explode(F.array(F.struct(F.lit(OPENED).alias("kind"), F.col("tsDetected").alias("ts")), F.struct(F.lit(CLOSED).alias("kind"), F.col("tsOut").alias("ts"))))
    rows = episodes.select("mmsi", "zone", detected.alias("detected"), both.alias("x")).where("x.ts IS NOT NULL")
    none = F.lit(None)
    return rows.select("mmsi", F.col("x.ts").cast("timestamp").alias("ts"), "x.kind", none.cast("long").alias("event_id"), none.cast("boolean").alias("outside"), "zone", "detected")


class StaleEpisodes(StatefulProcessor):
    """Closes the episodes of the vessels of one bucket.

    Times are microseconds; timers take milliseconds, rounded up so that none fires before its episode is due. A call and
    each access to its state cost far more than an event, so many vessels share them: a bucket's state is one row of
    columns, read once and written back once, and its timer is that of the episode that is due next.
    """

    def __init__(self, days: float):
        self.wait = int(days * 86_400_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "mmsi array<long>, at array<long>, id array<long>, outside array<boolean>, open array<long>, zone array<int>, detected array<long>, timer long")

    def _timer(self, detected: int) -> int:
        return -(-(detected + self.wait) // 1000)

    def _due(self, held: set, last: tuple | None, at: int, outside: bool | None) -> list[tuple[int, int, int]]:
        """Closes those of the held episodes that fall due up to a time, and at a report then those due before it."""
        out = []
        for zone, detected in held:
            due = detected + self.wait
            if due <= at and last is not None and last[2]:
                out.append((zone, detected, max(due, last[0])))
            elif due <= at and outside:
                out.append((zone, detected, at))
        held.difference_update((z, d) for z, d, _ in out)
        return out

    def _state(self) -> tuple[dict, dict, int | None]:
        """By vessel: its last report (at, id, outside) and its open episodes (zone, detected); and the timer."""
        if not self.kept.exists():
            return {}, {}, None
        vessels, at, ids, outside, opened, zones, detected, timer = self.kept.get()
        held: dict[int, set] = {}
        for m, z, d in zip(opened, zones, detected, strict=True):
            held.setdefault(m, set()).add((z, d))
        return dict(zip(vessels, zip(at, ids, outside, strict=True), strict=True)), held, timer

    def _write(self, last: dict, held: dict, timer: int | None, now: int) -> None:
        """Those due by now are judged already: if they are still open, a report closes them."""
        rows = [(m, z, d) for m, x in held.items() for z, d in x]
        nxt = min((t for t in (self._timer(d) for _, _, d in rows) if t > now), default=None)
        if nxt != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if nxt is not None:
                self.handle.registerTimer(nxt)
        reports = list(last.values())
        self.kept.update((list(last), *([x[i] for x in reports] for i in range(3)), *([x[i] for x in rows] for i in range(3)), nxt))

    def _judged(self, last: dict, held: dict, now: int) -> list[tuple[int, int, int, int]]:
        """Closes what fell due up to now (milliseconds)."""
        out = [(m, *c) for m, x in held.items() for c in self._due(x, last.get(m), now * 1000, None)]
        for m in {m for m, *_ in out if not held[m]}:
            del held[m]
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows).sort_values(["at", "kind", "id"])
        closings: list[tuple[int, int, int, int]] = []
        last, held, timer = self._state()
        for m, at, kind, i, outside, zone, detected in zip(*[events[c].tolist() for c in ("mmsi", "at", "kind", "id", "outside", "zone", "detected")], strict=True):
            was = last.get(m)
            if kind == REPORT:
                if was is None or (at, i) >= was[:2]:
                    if m in held:
                        closings += [(m, *c) for c in self._due(held[m], was, at, outside)]
                    last[m] = at, i, outside
            elif kind == OPENED:
                held.setdefault(m, set()).add((zone, detected))
            elif m in held:
                # what fell due before its tracker saw it leave was closed by then
                closings += [(m, *c) for c in self._due(held[m], was, at, None)]
                held[m].discard((zone, detected))
        now = timerValues.getCurrentWatermarkInMs()
        closings += self._judged(last, held, now)
        self._write(last, held, timer, now)
        yield self._frame(key, closings)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last, held, _ = self._state()
        closings = self._judged(last, held, now)
        # a timer that fired is gone
        self._write(last, held, None, now)
        yield self._frame(key, closings)

    def _frame(self, key, closings: list[tuple[int, int, int, int]]) -> pd.DataFrame:
        found = pd.DataFrame(closings, columns=["mmsi", "zone", "detected", "closed"])
        return found if key[1] else found.assign(mmsi=None)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def stale_closings(positions: DataFrame, episodes: DataFrame, box: tuple[float, float, float, float], days: float = 5, lateness: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """mmsi, zone, tsDetected and tsOut of episodes as they turn stale (append mode; start it inside rocksdb()).

    positions: a stream of reports (ts as a timestamp). episodes: a stream of a tracker's episodes, open ones when they
    begin and closed ones when they end. Reports that are older than their vessel's last one, or than the watermark,
    change nothing; repeated events neither. Of reports at one time that of the largest event_id is last. Rows without
    coordinates are no reports. buckets: groups that vessels are dealt to, whose state is held in memory one at a time.
    """
    events = report_events(positions, box).unionByName(episode_events(episodes)).withWatermark("ts", lateness)
    # no nulls, which pandas would keep as floats or objects
    filled = [F.coalesce(c, F.lit(v)).alias(n) for n, c, v in (("mmsi", "mmsi", 0), ("id", "event_id", 0), ("outside", "outside", False), ("zone", "zone", 0), ("detected", "detected", 0))]
    bucket = F.pmod(F.xxhash64("mmsi"), F.lit(buckets)).alias("bucket")
    events = events.select(bucket, F.col("mmsi").isNotNull().alias("named"), "ts", F.unix_micros("ts").alias("at"), "kind", *filled)
    found = events.groupBy("bucket", "named").transformWithStateInPandas(StaleEpisodes(days), CLOSINGS, "Append", "EventTime")
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.select("mmsi", "zone", time("detected").alias("tsDetected"), time("closed").alias("tsOut"))


def with_closings(episodes: DataFrame, closings: DataFrame) -> DataFrame:
    """episodes with the tsOut of their closing, where that is earlier than their own or they have none."""
    least = closings.groupBy("mmsi", "zone", "tsDetected").agg(F.min("tsOut").alias("__out"))
    joined = episodes.join(least, ["mmsi", "zone", "tsDetected"], "left")
    return joined.withColumn("tsOut", F.least("tsOut", "__out")).select(*episodes.columns)
