"""Answers to request lines: what is sent, in which order, and what is not."""

import json
from datetime import datetime, timedelta

from tidemark.functions import vessels as V
from tidemark.plans import requests as R
from tidemark.plans import views as W
from tidemark.sources.schemas import POSITION
from tidemark.streaming import trackers
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1, 20, 0, 0)
GPS_KIND = "ts long, mmsi long, sog double, cog double, rot double, lng double, lat double, event_id long"
STATIC_KIND = "mmsi long, ts long, message_id long, shipType long, shipName string, imo long, callsign string, to_bow long, to_stern long, to_port long, to_starboard long"


def histories(spark):
    at = lambda i, mmsi, cog: tuple({"event_id": i, "ts": T0 + timedelta(minutes=i // 2), "mmsi": mmsi, "longitude": 100.5 + i, "latitude": 2.25, "sog": 1.5, "cog": cog}.get(f.name) for f in POSITION)
    positions = spark.createDataFrame([at(3, 7, 1.0), at(2, 7, None), at(0, 7, 3.0), at(1, 8, 4.0), at(5, -1, 0.0)], POSITION)
    ms = 1_704_139_200_000
    gps = spark.createDataFrame([(ms + 1500, 7, 2.0, 9.0, 0.5, 101.0, 2.0, 2), (ms, 7, 2.0, 8.0, 0.25, 100.0, 1.0, 1), (ms, 7, 0.0, 8.0, 0.0, 99.0, 9.0, 3)], GPS_KIND)
    static = spark.createDataFrame([(7, ms, 1, 80, "OLD", 9, "A", 1, 2, 3, 4), (7, ms, 2, None, "NEW", 9, "B", 1, 2, 3, 4), (8, ms, 3, 70, "EIGHT", 8, "C", 1, 2, 3, 4)], STATIC_KIND)
    return R.Histories(positions, gps, static)


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def sent(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.request, r.ord)):
        out.setdefault(r.request, []).append(json.loads(r.message) if r.message.startswith("{") else r.message)
    return out


def test_all_verbs(spark):
    asked = lines(spark, "playback:7", "playback:7", "playbackGps:7", "vessel-info:7", "all-vessel:x", "all-vessel:", "playback:9", "playbackGps:8", "vessel-info:x", "playback", "stop:7", "", None)
    got = sent(R.answers(asked, histories(spark)).collect())
    assert set(got) == {"playback:7", "playbackGps:7", "vessel-info:7", "all-vessel"}
    track = [{"m_ts": ts, "m_mmsi": "7", "m_long": lon, "m_lat": 2.25, "m_sog": 1.5, "m_cog": cog, "cmap": 0, "payload": "playback"} for ts, lon, cog in (("2024-01-02 04:00:00", 100.5, 3.0), ("2024-01-02 04:01:00", 102.5, None), ("2024-01-02 04:01:00", 103.5, 1.0))]
    line = lambda *points: {"payload": "playback-data-geojson", "mmsi": "7", "geoSourceData": {"type": "geojson", "data": {"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [list(p) for p in points]}}}}
    assert got["playback:7"] == [*track, "playback-data-done", line((100.5, 2.25), (102.5, 2.25), (103.5, 2.25))]
    samples = [{"m_ts": ts, "m_mmsi": "7", "m_long": lon, "m_lat": lat, "m_rot": rot, "m_cog": cog, "cmap": 0, "payload": "playback"} for ts, lon, lat, rot, cog in (("2024-01-01 20:00:00", 100.0, 1.0, 0.25, 8.0), ("2024-01-01 20:00:01.500000", 101.0, 2.0, 0.5, 9.0))]
    assert got["playbackGps:7"] == [*samples, "playback-data-done", line((100.0, 1.0), (101.0, 2.0))]
    assert got["vessel-info:7"] == [{"m_ts": "2024-01-01 20:00:00", "m_mmsi": "7", "m_shiptype": None, "m_shipname": "NEW", "m_imo": "9", "m_callsign": "B", "m_toStarboard": "4", "m_toPort": "3", "m_toStern": "2", "m_toBow": "1", "payload": "vessel-info"}]
    assert got["all-vessel"] == [{"m_ts": ts, "m_mmsi": m, "m_long": lon, "m_lat": 2.25, "m_cog": cog, "payload": "all-vessel"} for ts, m, lon, cog in (("2024-01-02 04:01:00", "7", 103.5, 1.0), ("2024-01-02 04:00:00", "8", 101.5, 4.0))] + ["all-vessel-data-done"]


def test_nothing_asked(spark):
    assert R.answers(lines(spark, "x", "playback:"), histories(spark)).count() == 0
    assert R.answers(lines(spark), histories(spark)).columns == ["request", "ord", "message"]


def test_lines_in_two_batches(spark, tmp_path):
    write = trackers.answer_sink(histories(spark), str(tmp_path))
    write(lines(spark, "vessel-info:8"), 0)
    write(lines(spark, "playback:8"), 1)
    write(lines(spark, "playback:8"), 1)  # a batch that runs again replaces its own answers
    assert {k: len(v) for k, v in sent(spark.read.parquet(str(tmp_path)).collect()).items()} == {"vessel-info:8": 1, "playback:8": 3}


def test_only_asked_vessels_are_shuffled(spark):
    rows = R._of(histories(spark).positions, R.asked(lines(spark, "playback:7")), R.TRACK)
    assert {r.mmsi for r in rows.collect()} == {7} and "LeftSemi" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_records(spark):
    assert W.vessel_info(histories(spark).static).columns[0] == "m_ts"
    texts = spark.range(1).select(*[V.time_text(F.lit(x).cast("timestamp_ntz")) for x in ("2024-01-01 00:00:00", "2024-01-01 00:00:00.25", "2024-01-01 00:00:00.000001")]).first()
    assert list(texts) == ["2024-01-01 00:00:00", "2024-01-01 00:00:00.250000", "2024-01-01 00:00:00.000001"]
