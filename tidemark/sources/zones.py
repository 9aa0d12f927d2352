"""The zone catalogue: rings, edges and envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import ZONE

# The published zone boundaries. Lanes are written as (longitude, latitude), all others as (latitude, longitude).
LANES = {
    10: ("TSS-Northbound", [
        (100.81183434, 3.04546854), (100.78857422, 3.01186991), (100.92864990, 2.89426660), (100.99096298, 2.82448741),
        (101.16983414, 2.73207069), (101.22819901, 2.69983461), (101.43934250, 2.58854501), (101.44878387, 2.58357190),
        (101.61975861, 2.45152024), (101.68893814, 2.39800985), (101.83811188, 2.28069134), (101.87999725, 2.25015950),
        (101.99157715, 2.16267711), (102.07672119, 2.08977126), (102.25542068, 1.92902351), (102.41214752, 1.85404837),
        (102.73057938, 1.70168649), (102.80336380, 1.66428046), (102.99957275, 1.53077984), (103.17449570, 1.40859717),
        (103.20505142, 1.38783233), (103.39817047, 1.22960188), (103.47301483, 1.20351523), (103.49387169, 1.23831167),
        (103.42082977, 1.25427241), (103.33379745, 1.34085335), (103.28358650, 1.39109294), (103.28144073, 1.39606965),
        (103.24710846, 1.42936183), (103.17449570, 1.49182627), (103.09656143, 1.56063806), (103.00008774, 1.64386126),
        (102.74688721, 1.75624996), (102.62483597, 1.81115498), (102.49214172, 1.87069073), (102.27653503, 1.96711031),
        (102.10521698, 2.12185026), (102.10298538, 2.11996328), (102.01698303, 2.19372537), (101.99209213, 2.21671096),
        (101.94917679, 2.25015950), (101.94660187, 2.25067409), (101.79759979, 2.36748054), (101.71588898, 2.43162560),
        (101.71382904, 2.42973902), (101.64567947, 2.48290515), (101.64430618, 2.48513466), (101.52122498, 2.58065662),
        (101.52122498, 2.58271446), (101.46646500, 2.62558549), (101.42389297, 2.64856375), (101.40689850, 2.65559433),
        (101.24879837, 2.73961518), (101.24811172, 2.73858639), (101.18974686, 2.77236458), (100.99868774, 2.87540778),
        (100.99473953, 2.87832234), (100.81183434, 3.04546854),
    ]),
    11: ("TSS-Southbound", [
        (100.78385353, 3.00488435), (100.90719223, 2.90236723), (100.91860771, 2.89276648), (100.92882156, 2.88247987),
        (100.98993301, 2.81741496), (101.11541748, 2.74994592), (101.16545677, 2.72319728), (101.22510910, 2.69370451),
        (101.29875183, 2.65503703), (101.30235672, 2.65220765), (101.37248039, 2.61508222), (101.42766953, 2.58738747),
        (101.53521538, 2.50232741), (101.61194801, 2.44110132), (101.67975426, 2.38638993), (101.85819626, 2.24844421),
        (101.98282242, 2.15049779), (102.06418991, 2.07604743), (102.24666595, 1.91358267), (102.54690170, 1.77169216),
        (102.79975891, 1.65141124), (102.99991608, 1.52031221), (103.20505142, 1.38680267), (103.38752747, 1.22119240),
        (103.45636368, 1.17502558), (103.44451904, 1.15408722), (103.37757111, 1.19390430), (103.23337555, 1.32244764),
        (103.18239212, 1.36775376), (102.98103333, 1.49011024), (102.77812958, 1.61417585), (102.53213882, 1.72999792),
        (102.29764938, 1.84015102), (102.22297668, 1.87532311), (102.03826904, 2.04748431), (101.95724487, 2.11936288),
        (101.65477753, 2.35744689), (101.38732910, 2.56702330), (101.14528656, 2.68740291), (100.89706421, 2.81771500),
        (100.71613312, 2.91269651), (100.78385353, 3.00488435),
    ]),
}
AREAS = {
    0: ("restricted-limit", [(2.283333333333333, 104.565), (2.2838644444444443, 104.95033277777777), (1.690276111111111, 104.95033277777777), (1.6895897222222223, 104.56306444444444), (2.283333333333333, 104.565)]),
    1: ("sector1-limit", [(2.9, 100.66666666666667), (3.066666666666667, 100.96666666666667), (2.9, 101.21666666666667), (2.9, 100.66666666666667)]),
    2: ("sector2-limit", [(2.9, 100.66666666666667), (2.35, 101.35), (2.6333333333333333, 101.63333333333334), (2.9, 101.21666666666667), (2.9, 100.66666666666667)]),
    3: ("sector3-limit", [(2.35, 101.35), (1.85, 101.81666666666666), (2.1666666666666665, 102.2), (2.6333333333333333, 101.63333333333334), (2.35, 101.35)]),
    4: ("sector4-limit", [(1.85, 101.81666666666666), (1.5750099, 102.38333333333334), (1.9, 102.65), (2.1666666666666665, 102.2), (1.85, 101.81666666666666)]),
    5: ("sector5-limit", [(1.5750099, 102.38333333333334), (1.1666666666666667, 102.98333333333333), (1.5666666666666667, 103.31666666666666), (1.9, 102.65), (1.5750099, 102.38333333333334)]),
    6: ("sector6-limit", [(1.1666666666666667, 102.98333333333333), (1.1666666666666667, 103.41666666666667), (1.25, 103.5), (1.5666666666666667, 103.31666666666666), (1.1666666666666667, 102.98333333333333)]),
    7: ("sector7-limit", [(1.1666666666666667, 103.41666666666667), (0.95, 103.75), (1.1833333333333333, 103.75), (1.25, 103.5), (1.1666666666666667, 103.41666666666667)]),
    8: ("sector8-limit", [(0.95, 103.75), (1.1666666666666667, 104.03333333333333), (1.3333333333333333, 104.03333333333333), (1.1833333333333333, 103.75), (0.95, 103.75)]),
    9: ("sector9-limit", [(1.1666666666666667, 104.03333333333333), (1.2, 104.38333333333334), (1.5, 104.38333333333334), (1.3333333333333333, 104.03333333333333), (1.1666666666666667, 104.03333333333333)]),
}

Ring = list[tuple[float, float]]
RESTRICTED, SECTORS, LANE_IDS = (0,), tuple(range(1, 10)), (10, 11)


def zone_rings() -> dict[int, tuple[str, str, Ring]]:
    """zone -> (name, kind, ring as (lon, lat))."""
    kind = lambda z: "restricted" if z in RESTRICTED else "sector"
    areas = {z: (n, kind(z), [(lon, lat) for lat, lon in ring]) for z, (n, ring) in AREAS.items()}
    return areas | {z: (n, "lane", ring) for z, (n, ring) in LANES.items()}


def zone_row(zone: int, name: str, kind: str, ring: Ring) -> tuple:
    lon, lat = [p[0] for p in ring], [p[1] for p in ring]
    edges = [(*a, *b) for a, b in zip(ring, ring[1:], strict=False)]
    return zone, name, kind, ring, edges, (min(lon), min(lat), max(lon), max(lat))


def zone_catalog(spark: SparkSession, zones: list[int] | tuple[int, ...] | None = None) -> DataFrame:
    """The fixed zones, or those asked for."""
    rows = [zone_row(z, *rest) for z, rest in sorted(zone_rings().items()) if zones is None or z in zones]
    return spark.createDataFrame(rows, ZONE)


def swap_axes(ring: Column) -> Column:
    """array<array<double>> with the two numbers of each point exchanged."""
    return F.transform(ring, lambda p: F.array(p[1], p[0]))


def from_rings(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Adds edges and bbox to rows with a closed ring."""
    n = F.size(ring)
    edges = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.struct(F.get(ring, i - 1)["lon"].alias("x1"), F.get(ring, i - 1)["lat"].alias("y1"), F.get(ring, i)["lon"].alias("x2"), F.get(ring, i)["lat"].alias("y2")),
    )
    part = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    box = F.struct(part(F.array_min, "lon").alias("min_lon"), part(F.array_min, "lat").alias("min_lat"), part(F.array_max, "lon").alias("max_lon"), part(F.array_max, "lat").alias("max_lat"))
    return df.withColumn("edges", edges).withColumn("bbox", box)


def parse_geojson_zones(df: DataFrame, geojson: str = "geojson") -> DataFrame:
    """zone, name, kind and a GeoJSON polygon text (one outer ring of [lon, lat]) to zone rows; bad texts are dropped."""
    polygon = F.from_json(geojson, "type string, coordinates array<array<array<double>>>")
    ring = F.transform(F.get(polygon["coordinates"], 0), lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    rows = df.withColumn("ring", ring).where((polygon["type"] == "Polygon") & (F.size("ring") > 3))
    return from_rings(rows).select(*ZONE.names)


def read_geojson_zones(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with zone, name, kind and geometry (a GeoJSON polygon)."""
    raw = spark.read.schema("zone int, name string, kind string, geometry struct<type:string,coordinates:array<array<array<double>>>>").json(path)
    return parse_geojson_zones(raw.withColumn("geojson", F.to_json("geometry")))


def envelope(zones: DataFrame, west: float, east: float, north: float, south: float) -> DataFrame:
    """One row min_lon, min_lat, max_lon, max_lat around all rings, padded on each side."""
    return zones.agg(
        (F.min("bbox.min_lon") - west).alias("min_lon"), (F.min("bbox.min_lat") - south).alias("min_lat"),
        (F.max("bbox.max_lon") + east).alias("max_lon"), (F.max("bbox.max_lat") + north).alias("max_lat"),
    )


#: Regions: zones and paddings west, east, north, south.
REGIONS = {
    "lanes": ((1, 2, 3, 4, 5, 6, 10, 11), 0.095, 0.2, 0.3, 0.1),
    "sectors_7_9": ((7, 8, 9), 0.095, 0.095, 0.095, 0.095),
    "restricted": ((0,), 0.3, 0.3, 0.3, 0.3),
}


def region_box(name: str) -> tuple[float, float, float, float]:
    """A region's envelope as literals (min_lon, min_lat, max_lon, max_lat)."""
    zones, west, east, north, south = REGIONS[name]
    points = [p for z in zones for p in zone_rings()[z][2]]
    lon, lat = [p[0] for p in points], [p[1] for p in points]
    return min(lon) - west, min(lat) - south, max(lon) + east, max(lat) + north


def region_envelopes(spark: SparkSession) -> DataFrame:
    """region and its envelope, for every region."""
    zones, out = zone_catalog(spark), None
    for name, (ids, *pads) in REGIONS.items():
        row = envelope(zones.where(F.col("zone").isin(*ids)), *pads).withColumn("region", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def ring_mean(zones: DataFrame) -> DataFrame:
    """Mean of each ring's vertices, the repeated closing one included."""
    mean = lambda c: F.aggregate("ring", F.lit(0.0), lambda a, p: a + p[c]) / F.size("ring")
    return zones.select("zone", mean("lon").alias("mean_lon"), mean("lat").alias("mean_lat"))
