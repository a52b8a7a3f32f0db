"""Distances and areas on points of latitude and longitude in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.errors import QueryError

# Earth radius in metres and units of distance in metres.
EARTH = 6_371_000.0
UNITS = {"cm": 0.01, "m": 1.0, "km": 1000.0, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344}


def metres(value: float, unit: str) -> float:
    if unit not in UNITS:
        raise QueryError("invalid_distance_unit", unit)
    return value * UNITS[unit]


def haversine(lat: Column, lon: Column, at_lat: float, at_lon: float) -> Column:
    """Great-circle distance in metres to a fixed point."""
    a, b = F.radians(lat), math.radians(at_lat)
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * math.cos(b) * F.pow(F.sin((F.radians(lon) - math.radians(at_lon)) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def within(lat: Column, lon: Column, at_lat: float, at_lon: float, value: float, unit: str = "m") -> Column:
    """Inside a radius, border included. A band of latitudes goes first: it reaches the scan as a range."""
    far = metres(value, unit)
    band = math.degrees(far / EARTH) + 1e-9
    return lat.between(at_lat - band, at_lat + band) & (haversine(lat, lon, at_lat, at_lon) <= far)


def in_polygon(lat: Column, lon: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule over edges that hold their lower end only; under three corners nothing is inside."""
    if len(corners) < 3:
        return F.lit(False) & lat.isNotNull()
    inside: Column = F.lit(0)
    for (y1, x1), (y2, x2) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y1 != y2:
            crosses = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
            inside = inside + crosses.cast("int")
    return inside % 2 == 1


def inside_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Whether a point lies in a box; one whose west exceeds its east spans the date line."""
    across = (lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & across


def destination(lat: Column, lon: Column, bearing: Column, metres: Column) -> Column:
    """The point at a bearing (degrees) and distance on the sphere, as a struct of lat and lon."""
    a, d, way = F.radians(lat), metres / F.lit(6371000.0), F.radians(bearing)
    up = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(way))
    over = F.radians(lon) + F.atan2(F.sin(way) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(up))
    return F.struct(F.degrees(up).alias("lat"), ((F.degrees(over) + 540) % 360 - 180).alias("lon"))
