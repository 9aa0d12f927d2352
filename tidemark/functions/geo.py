"""Geometry on longitude and latitude columns, in degrees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius of distances, and equatorial radius of the direct problem, in metres.
MEAN_RADIUS, EQUATOR_RADIUS = 6_371_000.0, 6_378_137.0
NAUTICAL_MILE = 1852.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = MEAN_RADIUS) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def meters_to_nm(meters: Column) -> Column:
    return meters / F.lit(NAUTICAL_MILE)


def destination_point(lat: Column, lon: Column, distance_m: Column, bearing: Column, radius: float = EQUATOR_RADIUS) -> tuple[Column, Column]:
    """(lat, lon) reached from a point over a distance along an initial bearing, on a sphere."""
    d, b, y, x = distance_m / F.lit(radius), F.radians(bearing), F.radians(lat), F.radians(lon)
    lat2 = F.asin(F.sin(y) * F.cos(d) + F.cos(y) * F.sin(d) * F.cos(b))
    lon2 = x + F.atan2(F.sin(b) * F.sin(d) * F.cos(y), F.cos(d) - F.sin(y) * F.sin(lat2))
    return F.degrees(lat2), F.degrees(lon2)


#: WGS-84: equatorial radius in metres, and flattening.
WGS84 = (6_378_137.0, 1 / 298.257223563)


def geodesic_point(lat: Column, lon: Column, distance_m: Column, bearing: Column, rounds: int = 6) -> tuple[Column, Column]:
    """(lat, lon) reached from a point over a distance along an initial bearing, on the WGS-84 ellipsoid.

    Vincenty's direct solution; each round brings the angular distance some three decimals nearer, so six reach the
    limit of doubles at any distance. Nulls give null.
    """
    radius, flat = WGS84
    polar = radius * (1 - flat)
    y, azimuth = F.radians(lat), F.radians(bearing)
    tan_u = F.lit(1 - flat) * F.tan(y)
    cos_u = 1 / F.sqrt(1 + tan_u * tan_u)
    sin_u = tan_u * cos_u
    start = F.atan2(tan_u, F.cos(azimuth))
    sin_a = cos_u * F.sin(azimuth)
    cos2_a = 1 - sin_a * sin_a
    u2 = cos2_a * F.lit((radius**2 - polar**2) / polar**2)
    big_a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    big_b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    first = distance_m / (F.lit(polar) * big_a)

    def nearer(sigma: Column, _: Column) -> Column:
        m, s, c = F.cos(2 * start + sigma), F.sin(sigma), F.cos(sigma)
        return first + big_b * s * (m + big_b / 4 * (c * (2 * m * m - 1) - big_b / 6 * m * (4 * s * s - 3) * (4 * m * m - 3)))

    # a fold keeps the expression small: each round uses the last one's result many times
    sigma = F.aggregate(F.array(*map(F.lit, range(rounds))), first, nearer)

    def reached(sigma: Column) -> Column:
        m, s, c = F.cos(2 * start + sigma), F.sin(sigma), F.cos(sigma)
        across = sin_u * s - cos_u * c * F.cos(azimuth)
        lat2 = F.atan2(sin_u * c + cos_u * s * F.cos(azimuth), F.lit(1 - flat) * F.sqrt(sin_a * sin_a + across * across))
        turn = F.atan2(s * F.sin(azimuth), cos_u * c - sin_u * s * F.cos(azimuth))
        k = F.lit(flat / 16) * cos2_a * (4 + F.lit(flat) * (4 - 3 * cos2_a))
        return F.struct(F.degrees(lat2).alias("lat"), (lon + F.degrees(turn - (1 - k) * F.lit(flat) * sin_a * (sigma + k * s * (m + k * c * (2 * m * m - 1))))).alias("lon"))

    end = F.get(F.transform(F.array(sigma), reached), 0)
    return end["lat"], end["lon"]


def heading_triangle(lat: Column, lon: Column, heading: Column, size_km: float, direct: Callable = destination_point) -> list[tuple[Column, Column]]:
    """(lon, lat) of the front, left and right corner of a triangle that points along the heading.

    direct: destination_point, on a sphere, or geodesic_point, on the ellipsoid.
    """
    t, out = F.radians(heading), []
    for x, y in ((0.0, size_km), (-size_km / 4, -size_km / 4), (size_km / 4, -size_km / 4)):
        east = F.lit(x) * F.cos(t) - F.lit(y) * F.sin(t)
        north = F.lit(x) * F.sin(t) + F.lit(y) * F.cos(t)
        lat1, lon1 = direct(lat, lon, east * 1000, F.lit(-90.0))
        lat2, lon2 = direct(lat1, lon1, north * 1000, F.lit(0.0))
        out.append((lon2, lat2))
    return out


def in_box(lon: Column, lat: Column, box: Column) -> Column:
    """Strictly inside a struct or literal tuple of min_lon, min_lat, max_lon, max_lat."""
    a = {n: box[n] for n in ("min_lon", "min_lat", "max_lon", "max_lat")} if isinstance(box, Column) else dict(zip(("min_lon", "min_lat", "max_lon", "max_lat"), map(F.lit, box), strict=True))
    return (lon > a["min_lon"]) & (lon < a["max_lon"]) & (lat > a["min_lat"]) & (lat < a["max_lat"])


def within(lon: Column, lat: Column, edges: Column) -> Column:
    """Strictly inside a ring given by its edges: points on an edge or vertex are outside; any orientation."""
    crossings = F.aggregate(
        edges,
        F.lit(0),
        lambda n, e: n + F.when(((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]), 1).otherwise(0),
    )
    on_edge = F.exists(
        edges,
        lambda e: ((lon - e["x1"]) * (e["y2"] - e["y1"]) == (lat - e["y1"]) * (e["x2"] - e["x1"]))
        & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])),
    )
    return (crossings % 2 == 1) & ~on_edge
