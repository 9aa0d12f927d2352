from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo as G
from tidemark.functions import vessels as V
from tidemark.operators.filters import within_region
from tidemark.sources.zones import REGIONS, parse_geojson_zones, region_box, region_envelopes, swap_axes, zone_catalog

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
AS_OF = datetime(2024, 1, 31)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_within_is_strict(spark):
    points = [(0.5, 0.5), (1.0, 0.5), (0.0, 0.0), (1.5, 0.5), (0.5, 0.0), (None, 0.5)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, longitude double, latitude double")
    assert [r.i for r in within_region(df, SQUARE).collect()] == [0]
    assert [r.i for r in within_region(df, SQUARE[::-1]).collect()] == [0]


def test_geojson_zones(spark):
    text = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'
    df = spark.createDataFrame([(1, "a", "x", text), (2, "b", "x", "nonsense"), (3, "c", "x", None)], "zone int, name string, kind string, geojson string")
    row = parse_geojson_zones(df).collect()
    assert len(row) == 1 and len(row[0].edges) == 3 and row[0].bbox.max_lon == 1.0


def test_zone_catalogue(spark):
    sizes = {r.zone: len(r.ring) for r in zone_catalog(spark).collect()}
    assert sizes == {0: 5, 1: 4, 10: 58, 11: 42} | {z: 5 for z in range(2, 10)}
    boxes = {r.region: r for r in region_envelopes(spark).collect()}
    for name in REGIONS:
        r = boxes[name]
        assert (r.min_lon, r.min_lat, r.max_lon, r.max_lat) == pytest.approx(region_box(name))
    assert region_box("lanes") == pytest.approx((100.571667, 1.054087, 103.7, 3.366667), abs=1e-6)


def test_swap_axes(spark):
    assert one(spark, x=swap_axes(F.array(F.array(F.lit(1.0), F.lit(2.0)))))["x"] == [[2.0, 1.0]]


@pytest.mark.parametrize("diff,crossing", [(0, 0), (30, 0), (30.1, 1), (80, 1), (110, 1), (110.1, 0), (150, 0), (210, 0), (260, 1), (280, 1), (300, 0), (300.1, 1), (350, 0), (None, 0)])
def test_sts_threshold(spark, diff, crossing):
    limit = V.sts_threshold_m(F.lit(diff).cast("double"), F.lit(10), F.lit(21), F.lit(100), F.lit(50.0))
    assert one(spark, x=limit)["x"] == (110.0 if crossing else 65.5)


@pytest.mark.parametrize("hours,margin,sog", [(3, 50, 1), (2, 30, 1), (1, 30, 1), (0.6, 30, 1), (0.4, 10, 0.5), (0.01, 10, 0.5)])
def test_time_limits(spark, hours, margin, sog):
    ts = V.as_time(AS_OF - timedelta(hours=hours))
    assert one(spark, m=V.time_margin(AS_OF, ts), s=V.time_sog_limit(AS_OF, ts)) == {"m": margin, "s": sog}


def test_categories_and_colours(spark):
    df = spark.createDataFrame([(x,) for x in (39, 40, 59, 60, 79, 80, 89, 90, None)], "t long")
    got = [r.c for r in df.select(V.ship_category(F.col("t")).alias("c")).collect()]
    assert got == ["others", "hs_craft", "tug", "passenger", "cargo", "tanker", "tanker", "others", "others"]
    assert one(spark, x=V.category_color(F.lit("cargo")))["x"] == [182, 2, 254, 200]
    color = lambda a, z, s: one(spark, x=V.severity_color(F.lit(a).cast("int"), F.lit(z), F.lit(s)))["x"]
    assert color(0, False, False) == [255, 0, 0, 150] and color(100, True, True) == [255, 0, 0, 150]
    assert color(68, False, False) == [66, 247, 255, 150] and color(69, False, False) == [255, 0, 0, 150] and color(None, None, None) == [255, 0, 0, 150]
    assert one(spark, a=V.highlight(F.array(*map(F.lit, (1, 2, 3, 200))), F.lit(1)), b=V.highlight(F.array(*map(F.lit, (1, 2, 3, 200))), F.lit(1), True), c=V.highlight(F.array(*map(F.lit, (1, 2, 3, 200))), F.lit(0))) == {"a": [1, 2, 3, 255], "b": [1, 2, 3, 300], "c": [1, 2, 3, 70]}


def test_small_scalars(spark):
    verb, mmsi = V.split_command(F.lit("playback:533"))
    bad = V.split_command(F.lit("playback:x"))[1]
    got = one(spark, verb=verb, mmsi=mmsi, bad=bad, cog=V.normalize_cog(F.lit(360.0)), none=V.clean_number(F.lit(float("nan"))), text=V.default_text(F.lit(None).cast("string")), lane=V.lane_short_name(F.lit("Northbound")), epoch=V.epoch_ms_to_ts(F.lit(1000)), parsed=V.parse_ts(F.lit("2024-01-02 03:04:05")), junk=V.parse_ts(F.lit("x")))
    assert got == {"verb": "playback", "mmsi": 533, "bad": None, "cog": 0.0, "none": None, "text": "Not Available", "lane": "North", "epoch": datetime(1970, 1, 1, 0, 0, 1), "parsed": datetime(2024, 1, 2, 3, 4, 5), "junk": None}


def test_destination_and_distance(spark):
    lat, lon = G.destination_point(F.lit(1.0), F.lit(104.0), F.lit(10_000.0), F.lit(45.0))
    got = one(spark, d=G.haversine_m(F.lit(1.0), F.lit(104.0), lat, lon))["d"]
    assert got == pytest.approx(10_000 * G.MEAN_RADIUS / G.EQUATOR_RADIUS, rel=1e-6)
