"""Stale episodes closed by timers, over several micro-batches and restarts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.sources import io
from tidemark.sources.schemas import EPISODE, POSITION
from tidemark.streaming import stale, trackers

BOX = (0.0, 0.0, 10.0, 10.0)
IN, OUT = (5.0, 5.0), (20.0, 5.0)
DAY0 = datetime(2024, 1, 1)


def day(d):
    return DAY0 + timedelta(days=d)


def report(spark, mmsi, d, place):
    return {"feed": "A", "event_id": int(d * 100), "ts": day(d), "mmsi": mmsi, "longitude": place[0], "latitude": place[1]}


def closings(spark, tmp_path, batches):
    """batches: lists of (reports, episodes as (mmsi, zone, detected, out))."""
    seen, tracked, out = (str(tmp_path / n) for n in ("seen", "tracked", "out"))
    for reports, episodes in batches:
        rows = [tuple(r.get(f.name) for f in POSITION) for r in reports]
        spark.createDataFrame(rows, POSITION).coalesce(1).write.mode("append").parquet(seen)
        rows = [tuple({"mmsi": m, "zone": z, "tsDetected": day(d), "tsOut": None if o is None else day(o)}.get(f.name) for f in EPISODE) for m, z, d, o in episodes]
        spark.createDataFrame(rows, EPISODE).coalesce(1).write.mode("append").parquet(tracked)
        found = stale.stale_closings(io.stream_positions(spark, seen), spark.readStream.schema(EPISODE).parquet(tracked), BOX)
        with stale.rocksdb(spark):
            trackers.run_available(found, str(tmp_path / "checkpoint"), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/n={n}"), "append")
    got = [(r.mmsi, r.zone, (r.tsDetected - DAY0) / timedelta(days=1), (r.tsOut - DAY0) / timedelta(days=1)) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_silent_vessel_closes(spark, tmp_path):
    """Vessel 1 leaves the box on day 2 and says nothing more; vessel 2 moves the clock. Each batch is a run of its own."""
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    r = lambda *a: report(spark, *a)
    batches = [
        ([r(1, 0, IN), r(2, 0, IN)], [(1, 0, 0, None)]),
        ([r(1, 2, OUT), r(2, 2.5, IN)], []),
        ([r(2, 6, IN)], []),
        ([r(2, 9, IN)], []),
    ]
    assert closings(spark, tmp_path, batches) == {(1, 0, 0, 5)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_rule_of_event_time(spark, tmp_path):
    r = lambda *a: report(spark, *a)
    batches = [
        (
            [r(m, 0, IN) for m in range(1, 8)] + [r(1, 1, OUT), r(2, 4, IN), r(3, 1, OUT)],
            [(m, 0, 0, None) for m in (1, 2, 3, 4, 5, 6)] + [(6, 1, 0.5, None)],
        ),
        # 1 comes back before it is due; 3 is closed by its tracker; 4 leaves after it was due; 5 stays; 6 has two episodes
        ([r(1, 4.5, IN), r(4, 4.9, IN), r(6, 5.2, OUT)], [(3, 0, 0, 4.8)]),
        # 2 goes after its time, with the report before inside; a late report of 6 changes nothing
        ([r(1, 7, IN), r(2, 8, OUT), r(4, 8.5, OUT), r(6, 8.6, OUT)], []),
        ([r(7, 20, IN)], [(7, 3, 12, None)]),
    ]
    assert closings(spark, tmp_path, batches) == {(2, 0, 0, 8), (4, 0, 0, 8.5), (6, 0, 0, 5.2), (6, 1, 0.5, 5.5)}


def test_reports_without_place(spark, tmp_path):
    """A report without coordinates is none: the vessel's last place is inside, so its episode stays open."""
    r = lambda *a: report(spark, *a)
    batches = [([r(1, 0, IN), r(1, 4, OUT) | {"longitude": None}, r(3, 1, OUT)], [(1, 0, 0, None), (3, 0, 0, None)]), ([r(2, 9, IN)], [])]
    assert closings(spark, tmp_path, batches) == {(3, 0, 0, 5)}


def test_with_closings(spark):
    rows = [(1, 0, day(0), None), (2, 0, day(0), day(1)), (3, 0, day(0), day(9)), (4, 0, day(0), None)]
    kind = "mmsi long, zone int, tsDetected timestamp_ntz, tsOut timestamp_ntz"
    closed = spark.createDataFrame([(m, 0, day(0), day(5)) for m in (1, 2, 3)] * 2, kind)
    found = {r.mmsi: r.tsOut for r in stale.with_closings(spark.createDataFrame(rows, kind), closed).collect()}
    assert found == {1: day(5), 2: day(1), 3: day(5), 4: None}


def test_log_of_last_positions_closes_silent_vessels(spark, tmp_path):
    """The sink for newest positions judges vessels that a batch doesn't mention."""
    log, write = trackers.stale_sink(spark, str(tmp_path), BOX)
    opened = [tuple({"mmsi": 1, "zone": 0, "tsDetected": day(0)}.get(f.name) for f in EPISODE)]
    log.write(-1, spark.createDataFrame(opened, EPISODE))
    batches = [[report(spark, 1, 0, IN), report(spark, 2, 0, IN)], [report(spark, 1, 2, OUT)], [report(spark, 2, 6, IN)], [report(spark, 2, 9, IN)]]
    for n, reports in enumerate(batches):
        write(spark.createDataFrame([tuple(x.get(f.name) for f in POSITION) for x in reports], POSITION), n)
    assert [(r.mmsi, r.tsOut) for r in log.read().where(F.col("zone") == 0).collect()] == [(1, day(6))]


def test_vessels_share_buckets(spark, tmp_path):
    """State has a row for each bucket and not for each vessel; of two reports at one time the larger event_id is last."""
    seen, tracked, out = (str(tmp_path / n) for n in ("seen", "tracked", "out"))
    places = [(m, d, OUT if m % 2 else IN) for m in range(1, 41) for d in (0, 2)] + [(99, 9, IN)]
    rows = [report(spark, m, d, IN if d == 0 else place) for m, d, place in places]
    # vessels 2 and 4 have one more report on day 2, before and after the one inside
    rows += [report(spark, 2, 2, OUT) | {"event_id": 1}, report(spark, 4, 2, OUT) | {"event_id": 999}]
    spark.createDataFrame([tuple(r.get(f.name) for f in POSITION) for r in rows], POSITION).write.parquet(seen)
    opened = [tuple({"mmsi": m, "zone": 0, "tsDetected": day(0)}.get(f.name) for f in EPISODE) for m in range(1, 41)]
    spark.createDataFrame(opened, EPISODE).write.parquet(tracked)
    found = stale.stale_closings(io.stream_positions(spark, seen), spark.readStream.schema(EPISODE).parquet(tracked), BOX, buckets=3)
    with stale.rocksdb(spark):
        query = found.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).foreachBatch(lambda df, n: df.write.parquet(f"{out}/n={n}")).start()
        query.awaitTermination()
    assert {(r.mmsi, r.tsOut) for r in spark.read.parquet(out).collect()} == {(m, day(5)) for m in range(1, 41) if m % 2 or m == 4}
    # three buckets, and at most a timer with its index for each
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 3 * 4


def test_batches_are_planned_by_the_tracker(spark):
    """A stream's own session has no adaptive execution."""
    other = spark.newSession()
    other.conf.set("spark.sql.adaptive.enabled", "false")
    held = trackers._arrived(spark, other.range(5))
    assert held.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true" and held.count() == 5
