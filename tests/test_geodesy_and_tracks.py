"""Geodesics on the ellipsoid, tracks in pieces, and mergeable sketches."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.plans import boards, views


def degrees(d, m, s):
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


def reached(spark, lat, lon, distance, bearing, direct=geo.geodesic_point):
    la, lo = direct(F.lit(lat), F.lit(lon), F.lit(distance), F.lit(bearing))
    r = spark.range(1).select(la.alias("lat"), lo.alias("lon")).first()
    return r.lat, r.lon


def test_published_line(spark):
    """The test line from Flinders Peak to Buninyong of the Australian geodetic manual."""
    lat, lon = reached(spark, degrees(-37, 57, 3.72030), degrees(144, 25, 29.52440), 54_972.271, degrees(306, 52, 5.37))
    metre = 1 / 111_000
    assert abs(lat - degrees(-37, 39, 10.15610)) < 1e-3 * metre * 1.5 and abs(lon - degrees(143, 55, 35.38390)) < 1e-3 * metre * 1.5


def test_meridian_and_equator(spark):
    """A quarter of a meridian is 10,001,965.729 m on WGS-84; along the equator angles are distance by radius."""
    lat, lon = reached(spark, 0.0, 10.0, 10_001_965.729, 0.0)
    assert abs(lat - 90) < 1e-8
    lat, lon = reached(spark, 0.0, 0.0, 1_000_000.0, 90.0)
    assert abs(lat) < 1e-9 and abs(lon - math.degrees(1_000_000 / geo.WGS84[0])) < 1e-9
    assert reached(spark, 12.0, 34.0, 0.0, 77.0) == pytest.approx((12.0, 34.0), abs=1e-12)


def test_there_and_back_and_the_sphere(spark):
    rnd = random.Random(1)
    for _ in range(6):
        lat, lon, d, b = rnd.uniform(-70, 70), rnd.uniform(-170, 170), rnd.uniform(10, 5e5), rnd.uniform(0, 360)
        y, x = reached(spark, lat, lon, d, b)
        ys, xs = reached(spark, lat, lon, d, b, geo.destination_point)
        assert 0 < math.hypot(y - ys, (x - xs) * math.cos(math.radians(lat))) < 0.008 * d / 111_000
        north = reached(spark, lat, lon, d, 0.0)[0]
        assert reached(spark, north, lon, d, 180.0)[0] == pytest.approx(lat, abs=1e-9)


def test_triangle_takes_either(spark):
    corners = {d: geo.heading_triangle(F.lit(1.5), F.lit(104.0), F.lit(30.0), 2.0, d) for d in (geo.destination_point, geo.geodesic_point)}
    rows = {d: [spark.range(1).select(x.alias("x"), y.alias("y")).first() for x, y in c] for d, c in corners.items()}
    for a, b in zip(*rows.values(), strict=True):
        assert 0 < math.hypot(a.x - b.x, a.y - b.y) < 0.01 * 2 / 111


def track(spark, sizes):
    t0 = datetime(2024, 1, 1)
    rows = [(m * 10_000 + i, t0 + timedelta(seconds=i // 2), m, i + 0.5, -i + 0.25) for m, n in enumerate(sizes) for i in range(n)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, mmsi long, longitude double, latitude double").repartition(3)


@pytest.mark.parametrize("most", [1, 7, 50, 1_000])
def test_pieces_join_to_the_track(spark, most):
    df = track(spark, [0, 1, 7, 8, 49, 50, 51, 300])
    whole = {r.mmsi: [tuple(p) for p in r.points] for r in views.track_linestring(df).collect()}
    pieces = {}
    for r in sorted(views.track_pieces(df, most).collect(), key=lambda r: (r.mmsi, r.piece)):
        own = [tuple(p) for p in r.points]
        assert len(own) <= most + 1 and r.piece == len(pieces.get(r.mmsi, []))
        pieces.setdefault(r.mmsi, []).append(own)
    for m, parts in pieces.items():
        assert all(a[-1] == b[0] for a, b in zip(parts, parts[1:]))
        assert [p for k, own in enumerate(parts) for p in (own if k == len(parts) - 1 else own[:-1])] == whole[m]
    assert pieces.keys() == whole.keys()


def test_sketches_merge_in_any_order(spark):
    n = 30_000
    days = F.timestamp_seconds((F.col("id") % 5) * 86_400).cast("timestamp_ntz")
    tagged = spark.range(3 * n).select((F.col("id") % n).alias("mmsi"), days.alias("ts"), (F.col("id") % 2).cast("int").alias("zone"))
    exact = {r.zone: r.n for r in tagged.groupBy("zone").agg(F.countDistinct("mmsi").alias("n")).collect()}
    sketches = boards.vessel_sketches(tagged)
    assert sketches.count() == 10
    one = {r.zone: r.vessels for r in boards.merged_vessels(sketches, "zone").collect()}
    other = {r.zone: r.vessels for r in boards.merged_vessels(sketches.repartition(7, F.rand(3)), "zone").collect()}
    # merging is free of order up to the estimator's rounding, and four standard errors bound the estimate
    for zone, want in exact.items():
        assert abs(one[zone] - want) < 4 * 1.04 / 2 ** (boards.SKETCH / 2) * want and abs(one[zone] - other[zone]) <= 1
