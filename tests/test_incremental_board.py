"""Boards kept by signed changes equal those worked out anew after every batch."""

import random
from datetime import datetime, timedelta

from tidemark.operators.episodes import zone_episodes
from tidemark.plans.boards import sector_lane_counts
from tidemark.sources.schemas import POSITION
from tidemark.sources.zones import zone_catalog
from tidemark.streaming import trackers

ZONES = tuple(range(1, 12))
PLACES = [(100.89, 2.96), (100.81, 2.92), (101.24, 2.72), (101.11, 2.71), (101.82, 2.34), (0.0, 50.0)]


def test_equal_after_every_batch(spark, tmp_path):
    rnd, t0 = random.Random(4), datetime(2024, 1, 1)
    board, change = trackers.board_keeper(spark, str(tmp_path / "board"))
    _, write = trackers.episode_sink(spark, str(tmp_path / "log"), ZONES, change)
    seen, n = [], 0
    for batch in range(4):
        rows = []
        for _ in range(40):
            lon, lat = rnd.choice(PLACES)
            rows.append(tuple({"event_id": n, "ts": t0 + timedelta(minutes=n), "mmsi": rnd.randint(1, 12), "longitude": lon, "latitude": lat, "sog": 1.0}.get(f.name) for f in POSITION))
            n += 1
        seen += rows
        for _ in range(1 + (batch == 2)):  # one batch runs twice
            write(spark.createDataFrame(rows, POSITION), batch)
        whole = sector_lane_counts(zone_episodes(spark.createDataFrame(seen, POSITION), zone_catalog(spark, ZONES)))
        assert sorted(map(tuple, board.read().collect())) == sorted(map(tuple, whole.collect())) != []
