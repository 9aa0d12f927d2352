"""The grid-cell index of zones against testing every position with every ring."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.geo import within
from tidemark.operators import episodes
from tidemark.sources.zones import from_rings, zone_catalog


def ring(rnd, lon, lat, radius, corners):
    angles = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(corners))
    points = [(lon + radius * rnd.uniform(0.3, 1) * math.cos(a), lat + radius * rnd.uniform(0.3, 1) * math.sin(a)) for a in angles]
    return [*points, points[0]]


def catalogue(spark, rings):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "zone int, ring array<struct<lon:double,lat:double>>")
    return from_rings(df)


def positions(spark, places):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "event_id long, longitude double, latitude double")


def plain(places, zones):
    """Pairs by the exact test alone."""
    test = within(F.col("longitude"), F.col("latitude"), F.col("edges"))
    return {tuple(r) for r in places.where("longitude IS NOT NULL AND latitude IS NOT NULL AND NOT isnan(longitude)").crossJoin(zones).where(test).select("event_id", "zone").collect()}


@pytest.mark.parametrize("sent", [episodes.SENT, 0])
def test_many_zones_of_many_sizes(spark, monkeypatch, sent):
    monkeypatch.setattr(episodes, "SENT", sent)
    rnd = random.Random(1)
    rings = [ring(rnd, rnd.uniform(-179, 179), rnd.uniform(-80, 80), 10 ** rnd.uniform(-3, 1.3), rnd.randint(3, 12)) for _ in range(150)]
    corners = [p for r in rings for p in r]
    places = [*corners, *((lon + rnd.gauss(0, s), lat + rnd.gauss(0, s)) for lon, lat in corners for s in (1e-4, 0.1)), *((rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for _ in range(500))]
    at, zones = positions(spark, places), catalogue(spark, rings)
    tagged = episodes.tag_zones(at, zones)
    found = [tuple(r) for r in tagged.select("event_id", "zone").collect()]
    assert len(found) == len(set(found)) > 300
    assert set(found) == plain(at, zones)
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ("BroadcastHashJoin" in plan) == (sent > 0)


def test_edges_corners_and_odd_places(spark):
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    sliver = [(0.0, 0.0), (1.0, 1e-9), (1.0, 0.0), (0.0, 0.0)]
    places = [(0.5, 0.5), (0.0, 0.5), (1.0, 1.0), (0.5, 0.0), (-0.1, 0.5), (1.0, 0.5), (None, 0.5), (0.5, None), (float("nan"), 0.5), (0.9999999, 0.9999999), (0.9, 5e-10)]
    zones = catalogue(spark, [square, sliver, square])
    found = {tuple(r) for r in episodes.tag_zones(positions(spark, places), zones).select("event_id", "zone").collect()}
    assert found == {(0, 0), (0, 2), (9, 0), (9, 2), (10, 0), (10, 1), (10, 2)}


def test_no_zones(spark):
    tagged = episodes.tag_zones(positions(spark, [(1.0, 1.0)]), zone_catalog(spark).limit(0))
    assert tagged.columns == ["event_id", "longitude", "latitude", "zone"] and tagged.count() == 0


def test_cells_within_zones_bring_no_edges(spark):
    """A large zone is mostly cells that need no test."""
    circle = [(math.cos(k * math.pi / 90), math.sin(k * math.pi / 90)) for k in range(180)]
    cells = episodes.zone_cells(catalogue(spark, [[*circle, circle[0]]])).collect()
    inner = [c for c in cells if c.edges is None]
    assert len(inner) > len(cells) / 3 and len(cells) <= 17 * 17 and len({c.level for c in cells}) == 1
