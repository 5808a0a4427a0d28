"""Geometry as Column expressions. A geometry is an array of parts, each a struct of rings (arrays of points x, y).

A line is a part whose single ring isn't closed. Distances are in km on a sphere of 6371 km.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
GEOMETRY = "array<struct<rings:array<array<struct<x:double,y:double>>>>>"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def point_segment_km(lat: Column, lon: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance to a segment: the foot is found with longitudes scaled by the cosine of the site's latitude."""
    k = F.cos(F.radians(lat))
    dx, dy = (bx - ax) * k, by - ay
    size = dx * dx + dy * dy
    t = F.coalesce(F.try_divide(((lon - ax) * k) * dx + (lat - ay) * dy, size), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return haversine_km(lat, lon, ay + t * (by - ay), ax + t * (bx - ax))


def edges(ring: Column) -> Column:
    """Consecutive point pairs (a, b) of a ring."""
    n = F.size(ring) - 1
    return F.when(n > 0, F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def ring_has(ring: Column, lon: Column, lat: Column) -> Column:
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = F.try_divide((b["x"] - a["x"]) * (lat - a["y"]), b["y"] - a["y"]) + a["x"]
        return ((a["y"] > lat) != (b["y"] > lat)) & (lon < at)

    return F.coalesce(F.size(F.filter(edges(ring), crosses)) % 2 == 1, F.lit(False))


def contains_point(parts: Column, lon: Column, lat: Column) -> Column:
    """Even-odd rule: in the first ring of a part and in none of its holes."""
    return F.exists(parts, lambda p: ring_has(p["rings"][0], lon, lat) & ~F.exists(F.slice(p["rings"], 2, F.greatest(F.size(p["rings"]) - 1, F.lit(0))), lambda r: ring_has(r, lon, lat)))


def all_edges(parts: Column) -> Column:
    return F.flatten(F.flatten(F.transform(parts, lambda p: F.transform(p["rings"], edges))))


def point_line_km(parts: Column, lat: Column, lon: Column) -> Column:
    """Smallest distance to any edge: to a line, or to a polygon's boundary."""
    return F.array_min(F.transform(all_edges(parts), lambda e: point_segment_km(lat, lon, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])))


def is_polygon(parts: Column) -> Column:
    """Whether a part's first ring is closed."""
    return F.exists(parts, lambda p: (F.size(p["rings"][0]) > 3) & (F.element_at(p["rings"][0], 1) == F.element_at(p["rings"][0], -1)))


def geometry_km(parts: Column, lat: Column, lon: Column) -> Column:
    """Distance to points (rings of one point) and lines; polygons are infinitely far, so that no search finds them."""
    point = F.transform(F.filter(parts, lambda p: F.size(p["rings"][0]) == 1), lambda p: haversine_km(lat, lon, p["rings"][0][0]["y"], p["rings"][0][0]["x"]))
    return F.when(is_polygon(parts), F.lit(float("inf"))).otherwise(F.least(F.array_min(point), point_line_km(parts, lat, lon)))


def bbox(parts: Column) -> Column:
    points = F.flatten(F.flatten(F.transform(parts, lambda p: p["rings"])))
    x, y = F.transform(points, lambda q: q["x"]), F.transform(points, lambda q: q["y"])
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x)


def line_centroid(parts: Column) -> Column:
    """Mean of the segments' midpoints weighted by length."""
    e = all_edges(parts)
    length = lambda s: F.sqrt((s["b"]["x"] - s["a"]["x"]) ** 2 + (s["b"]["y"] - s["a"]["y"]) ** 2)
    total = _sum(F.transform(e, length))
    return F.struct(*[(_sum(F.transform(e, lambda s: length(s) * (s["a"][c] + s["b"][c]) / 2)) / total).alias(c) for c in ("x", "y")])


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace rule, in squared units of the coordinates."""
    return _sum(F.transform(edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def polygon_centroid(parts: Column) -> Column:
    """Area-weighted centre of the outer rings."""
    e = F.flatten(F.transform(parts, lambda p: edges(p["rings"][0])))
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    area = _sum(F.transform(e, cross))
    return F.struct(*[(_sum(F.transform(e, lambda s: cross(s) * (s["a"][c] + s["b"][c]))) / (area * 3)).alias(c) for c in ("x", "y")])


# The GRS 1980 ellipsoid and the parameters of EPSG:3310.
_A, _E2 = 6378137.0, 0.00669438002290
_LAT0, _LAT1, _LAT2, _LON0, _NORTH = 0.0, 34.0, 40.5, -120.0, -4000000.0


def _q_number(lat: float) -> float:
    s, e = math.sin(math.radians(lat)), math.sqrt(_E2)
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))


def _m_number(lat: float) -> float:
    s = math.sin(math.radians(lat))
    return math.cos(math.radians(lat)) / math.sqrt(1 - _E2 * s * s)


ALBERS_N = (_m_number(_LAT1) ** 2 - _m_number(_LAT2) ** 2) / (_q_number(_LAT2) - _q_number(_LAT1))
ALBERS_C = _m_number(_LAT1) ** 2 + ALBERS_N * _q_number(_LAT1)
ALBERS_RHO0 = _A * math.sqrt(ALBERS_C - ALBERS_N * _q_number(_LAT0)) / ALBERS_N


def albers(lon: Column, lat: Column) -> Column:
    """Equal-area coordinates in metres."""
    e, s = math.sqrt(_E2), F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.ln((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = _A * F.sqrt(ALBERS_C - ALBERS_N * q) / ALBERS_N
    theta = F.radians(lon - _LON0) * ALBERS_N
    return F.struct((rho * F.sin(theta)).alias("x"), (ALBERS_RHO0 - rho * F.cos(theta) + _NORTH).alias("y"))


def projected(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.struct(F.transform(p["rings"], lambda r: F.transform(r, lambda q: albers(q["x"], q["y"]))).alias("rings")))


def length_km(parts: Column) -> Column:
    return _sum(F.transform(all_edges(projected(parts)), lambda s: F.sqrt((s["b"]["x"] - s["a"]["x"]) ** 2 + (s["b"]["y"] - s["a"]["y"]) ** 2))) / 1000


def area_km2(parts: Column) -> Column:
    """Outer rings less their holes."""
    return _sum(F.transform(projected(parts), lambda p: F.abs(ring_area(p["rings"][0])) - _sum(F.transform(F.slice(p["rings"], 2, F.greatest(F.size(p["rings"]) - 1, F.lit(0))), lambda r: F.abs(ring_area(r)))))) / 1e6


def tile_index(v: Column, cell: float) -> Column:
    return F.floor(v / F.lit(cell)).cast("long")


def tile_keys(lat: Column, lon: Column) -> dict[str, Column]:
    """0.1 and 0.5 degree keys as texts, and as the integers that joins use."""
    fine = F.format_string("%.1f_%.1f", F.floor(lat * 10) / 10, F.floor(lon * 10) / 10)
    return {"tile": fine, "ci": F.floor(lat * 10), "cj": F.floor(lon * 10), "coarse_i": F.floor(lat * 2), "coarse_j": F.floor(lon * 2)}


def downwind_sector(lat: Column, lon: Column, wind_from: Column, radius_m: float = 2000.0, half_angle: float = 45.0, n: int = 32) -> Column:
    """A sector polygon on the lee side of a point, from it and back to it."""
    to = F.pmod(wind_from + 180, F.lit(360.0))
    centre = F.struct(lon.alias("x"), lat.alias("y"))

    def rim(k: Column) -> Column:
        bearing = F.radians(to - half_angle + k * (2 * half_angle / n))
        return F.struct((lon + F.lit(radius_m) * F.sin(bearing) / (F.lit(111320.0) * F.cos(F.radians(lat)))).alias("x"), (lat + F.lit(radius_m) * F.cos(bearing) / 111320.0).alias("y"))

    ring = F.concat(F.array(centre), F.transform(F.sequence(F.lit(0), F.lit(n)), rim), F.array(centre))
    return F.array(F.struct(F.array(ring).alias("rings")))
