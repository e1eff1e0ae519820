"""Distances, areas, projections and containment as Column expressions; no UDF.

Coordinates in rings are [lon, lat]; projections take latitude first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import METERS_PER_DEGREE

EARTH_M = 6371008.8
#: Radius that the map view uses for lines, and metres a degree for its areas.
VIEW_EARTH_M, VIEW_DEGREE_M = 6371000.0, 111139.0
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
MERCATOR_LAT = 85.05112878


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return radius * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def _edges(ring: Column, fn) -> Column:
    """Sum of fn(p, q) over neighbouring points of a ring of [lon, lat]."""
    pairs = F.zip_with(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), fn)
    return F.when(F.size(ring) < 2, F.lit(0.0)).otherwise(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x))


def line_length(points: Column, radius: float = EARTH_M) -> Column:
    return _edges(points, lambda p, q: haversine(p[0], p[1], q[0], q[1], radius))


def ring_area(ring: Column) -> Column:
    """Spherical area of a closed ring in m2; 0 with fewer than 4 points."""
    one = lambda p, q: F.radians(q[0] - p[0]) * (2 + F.sin(F.radians(p[1])) + F.sin(F.radians(q[1])))
    return F.when(F.size(ring) < 4, F.lit(0.0)).otherwise(F.abs(_edges(ring, one) * (EARTH_M * EARTH_M / 2)))


def polygon_area(rings: Column) -> Column:
    """Exterior less holes, never negative."""
    parts = F.transform(rings, ring_area)
    holes = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(rings) == 0, F.lit(0.0)).otherwise(F.abs(parts[0] - holes))


def polygon_perimeter(rings: Column) -> Column:
    """Edges of all rings, holes too."""
    return F.aggregate(F.transform(rings, lambda r: line_length(r)), F.lit(0.0), lambda a, x: a + x)


def local_area(rings: Column) -> Column:
    """Shoelace on an equirectangular projection at the mean latitude of the exterior's points."""
    lats = F.transform(rings[0], lambda p: p[1])
    lat0 = F.aggregate(lats, F.lit(0.0), lambda a, x: a + x) / F.size(lats)
    k = math.pi / 180 * EARTH_M
    one = lambda ring: F.abs(_edges(ring, lambda p, q: (p[0] * q[1] - q[0] * p[1]) * (k * k) * F.cos(F.radians(lat0)))) / 2
    parts = F.transform(rings, one)
    return parts[0] - F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(0.0), lambda a, x: a + x)


def view_area(ring: Column) -> Column:
    """Planar area of the map view."""
    lats = F.transform(ring, lambda p: p[1])
    lat0 = F.aggregate(lats, F.lit(0.0), lambda a, x: a + x) / F.size(lats)
    return F.abs(_edges(ring, lambda p, q: (p[0] * q[1] - q[0] * p[1]) * (VIEW_DEGREE_M * VIEW_DEGREE_M) * F.cos(F.radians(lat0)))) / 2


def valid_coordinate(lon: Column, lat: Column) -> Column:
    return F.coalesce(~F.isnan(lon) & ~F.isnan(lat) & lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def valid_ring(ring: Column) -> Column:
    """Four points at least, closed, all in range and of two numbers."""
    return F.coalesce((F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1)) & F.forall(ring, lambda p: (F.size(p) == 2) & valid_coordinate(p[0], p[1])), F.lit(False))


def valid_polygon(rings: Column) -> Column:
    return (F.size(rings) > 0) & F.forall(rings, valid_ring)


def closed(ring: Column) -> Column:
    """``ring`` with its first point at the end."""
    return F.when((F.size(ring) > 0) & (F.element_at(ring, 1) != F.element_at(ring, -1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def edges(ring: Column) -> Column:
    """Edges of a ring, from its last point round to its last: x, y, dx, dy and the y of the end. None below 3 points or along a parallel."""
    last = F.concat(F.slice(ring, F.greatest(F.size(ring), F.lit(1)), F.lit(1)), F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))))
    one = lambda p, q: F.struct(p[0].alias("x"), p[1].alias("y"), (q[0] - p[0]).alias("dx"), (q[1] - p[1]).alias("dy"), q[1].alias("end"))
    return F.when(F.size(ring) < 3, F.slice(F.zip_with(ring, last, one), 1, 0)).otherwise(F.filter(F.zip_with(ring, last, one), lambda e: e["y"] != e["end"]))


def in_edges(lon: Column, lat: Column, sides: Column) -> Column:
    """Ray casting with half-open edges."""
    return F.size(F.filter(sides, lambda e: ((e["y"] > lat) != (e["end"] > lat)) & (lon < e["dx"] * (lat - e["y"]) / e["dy"] + e["x"]))) % 2 == 1


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """False with fewer than 3 points."""
    return F.coalesce(in_edges(lon, lat, edges(ring)), F.lit(False))


def in_polygon_edges(lon: Column, lat: Column, sides: Column) -> Column:
    """In the exterior and in no hole; ``sides`` are the edges of each ring."""
    holes = F.slice(sides, F.lit(2), F.greatest(F.size(sides) - 1, F.lit(0)))
    return in_edges(lon, lat, sides[0]) & ((F.size(sides) < 2) | ~F.exists(holes, lambda r: in_edges(lon, lat, r)))


def in_polygon(lon: Column, lat: Column, rings: Column) -> Column:
    return in_polygon_edges(lon, lat, F.transform(rings, edges))


def bbox(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return {"west": F.array_min(xs), "south": F.array_min(ys), "east": F.array_max(xs), "north": F.array_max(ys)}


def mercator(lat: Column, lon: Column) -> dict[str, Column]:
    """EPSG:3857; null beyond the latitude limit."""
    ok = F.abs(lat) <= MERCATOR_LAT
    return {"x": F.when(ok, F.radians(lon) * WGS84_A), "y": F.when(ok, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * WGS84_A)}


def from_mercator(x: Column, y: Column) -> dict[str, Column]:
    return {"lat": F.degrees(2 * F.atan(F.exp(y / WGS84_A)) - math.pi / 2), "lon": F.degrees(x / WGS84_A)}


_E2 = 2 * WGS84_F - WGS84_F**2
_EP2 = _E2 / (1 - _E2)
_K0 = 0.9996


def utm(lat: Column, lon: Column, zone: Column, south: Column) -> dict[str, Column]:
    """Transverse Mercator by the usual series."""
    phi = F.radians(lat)
    n = WGS84_A / F.sqrt(1 - _E2 * F.pow(F.sin(phi), 2))
    t, c = F.pow(F.tan(phi), 2), _EP2 * F.pow(F.cos(phi), 2)
    a = F.radians(lon - ((zone - 1) * 6 - 177)) * F.cos(phi)
    arc = [1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256, 3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024, 15 * _E2**2 / 256 + 45 * _E2**3 / 1024, 35 * _E2**3 / 3072]
    m = WGS84_A * (arc[0] * phi - arc[1] * F.sin(2 * phi) + arc[2] * F.sin(4 * phi) - arc[3] * F.sin(6 * phi))
    x = _K0 * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * _EP2) * F.pow(a, 5) / 120) + 500000
    y = _K0 * (m + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * _EP2) * F.pow(a, 6) / 720))
    ok = zone.between(1, 60)
    return {"easting": F.when(ok, x), "northing": F.when(ok, y + F.when(south, F.lit(10000000.0)).otherwise(F.lit(0.0)))}


def from_utm(easting: Column, northing: Column, zone: Column, south: Column) -> dict[str, Column]:
    e1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
    m = (northing - F.when(south, F.lit(10000000.0)).otherwise(F.lit(0.0))) / _K0
    mu = m / (WGS84_A * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256))
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    s2 = F.pow(F.sin(foot), 2)
    c, t = _EP2 * F.pow(F.cos(foot), 2), F.pow(F.tan(foot), 2)
    n, r = WGS84_A / F.sqrt(1 - _E2 * s2), WGS84_A * (1 - _E2) / F.pow(1 - _E2 * s2, 1.5)
    d = (easting - 500000) / (n * _K0)
    lat = foot - n * F.tan(foot) / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * _EP2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * _EP2 - 3 * c * c) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * _EP2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(foot)
    return {"lat": F.degrees(lat), "lon": F.degrees(lon) + (zone - 1) * 6 - 177}


def to_wgs84(x: Column, y: Column, epsg: Column) -> dict[str, Column]:
    """By code: 4326, 3857, 326zz and 327zz; null for others."""
    merc, north = from_mercator(x, y), from_utm(x, y, epsg % 100, epsg >= 32700)
    utm_code = (epsg.between(32601, 32660)) | (epsg.between(32701, 32760))
    pick = lambda plain, k: F.when(epsg == 4326, plain).when(epsg == 3857, merc[k]).when(utm_code, north[k])
    return {"lat": pick(y, "lat"), "lon": pick(x, "lon")}


def footprint(lat: Column, lon: Column, altitude: Column, width: Column, height: Column, hfov: float = 60.0) -> dict[str, Column]:
    """Ground bounds of a photo taken straight down; null unless altitude and size are positive."""
    ok = (altitude > 0) & (width > 0) & (height > 0)
    ground = 2 * altitude * math.tan(math.radians(hfov / 2))
    dlat = ground * (height / width) / 2 / METERS_PER_DEGREE
    dlon = ground / 2 / (METERS_PER_DEGREE * F.cos(F.radians(lat)))
    return {"west": F.when(ok, lon - dlon), "south": F.when(ok, lat - dlat), "east": F.when(ok, lon + dlon), "north": F.when(ok, lat + dlat)}


def bounds_from_gsd(lat: Column, lon: Column, gsd_m: Column, width: Column, height: Column) -> dict[str, Column]:
    dlat = height * gsd_m / 2 / METERS_PER_DEGREE
    dlon = width * gsd_m / 2 / (METERS_PER_DEGREE * F.cos(F.radians(lat)))
    ok = gsd_m > 0
    return {"west": F.when(ok, lon - dlon), "south": F.when(ok, lat - dlat), "east": F.when(ok, lon + dlon), "north": F.when(ok, lat + dlat)}


def intersected(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Common rectangle, null where there is none."""
    out = {"west": F.greatest(a["west"], b["west"]), "south": F.greatest(a["south"], b["south"]), "east": F.least(a["east"], b["east"]), "north": F.least(a["north"], b["north"])}
    ok = (out["west"] < out["east"]) & (out["south"] < out["north"])
    return {k: F.when(ok, v) for k, v in out.items()}


def valid_bounds(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.coalesce(valid_coordinate(west, south) & valid_coordinate(east, north) & (south < north) & (west < east), F.lit(False))


def pixel_area(west: Column, south: Column, east: Column, north: Column, width: Column, height: Column) -> Column:
    return F.abs((east - west) / width * METERS_PER_DEGREE * F.cos(F.radians((south + north) / 2)) * ((north - south) / height) * METERS_PER_DEGREE)


def pixel_center(x: Column, y: Column, bounds: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """Row 0 is the northern one."""
    return {"lon": bounds["west"] + (x + 0.5) / width * (bounds["east"] - bounds["west"]), "lat": bounds["north"] - (y + 0.5) / height * (bounds["north"] - bounds["south"])}


def pixel_to_geo(x: Column, y: Column, lat: Column, lon: Column, gsd_m: Column, rotation: Column, width: Column, height: Column) -> dict[str, Column]:
    right, up, a = (x - width / 2) * gsd_m, (height / 2 - y) * gsd_m, F.radians(rotation)
    return {"lat": lat + (up * F.cos(a) - right * F.sin(a)) / METERS_PER_DEGREE, "lon": lon + (right * F.cos(a) + up * F.sin(a)) / (METERS_PER_DEGREE * F.cos(F.radians(lat)))}


def box_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Closed ring of five points around a box."""
    return F.array(F.array(west, south), F.array(east, south), F.array(east, north), F.array(west, north), F.array(west, south))
