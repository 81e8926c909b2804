"""Places within a radius, and below a path."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M, METRES_PER_DEGREE = 6_371_000.0, 111_000.0


def haversine(lng: Column, lat: Column, lng0: float, lat0: float) -> Column:
    """Metres between a point and (lng0, lat0)."""
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    a = half(lat - lat0) + F.cos(F.radians(F.lit(lat0))) * F.cos(F.radians(lat)) * half(lng - lng0)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def query_in_area(locations: DataFrame, lng: float, lat: float, radius_m: float, scope: Column | None = None) -> DataFrame:
    """Locations within radius_m of a point, each id once, with distance_m, nearest first.

    A box of degrees, which reaches the scan as ranges, comes before the exact
    distance; it doesn't wrap at 180 degrees. Locations without coordinates,
    or with impossible ones, are not found.
    """
    x, y = F.col("coordinates.lng"), F.col("coordinates.lat")
    dy = radius_m / METRES_PER_DEGREE
    dx = radius_m / (METRES_PER_DEGREE * max(math.cos(math.radians(lat)), 1e-6))
    near = x.between(max(lng - dx, -180.0), min(lng + dx, 180.0)) & y.between(max(lat - dy, -90.0), min(lat + dy, 90.0))
    rows = locations.filter(near if scope is None else near & scope).dropDuplicates(["id"]).withColumn("distance_m", haversine(x, y, lng, lat))
    return rows.filter(F.col("distance_m") <= radius_m).orderBy("distance_m", "id")


def below_path(path: str, include_children: bool = True) -> Column:
    """The path itself, or with children: a range that reaches the scan (`/` follows `.`), so no neighbour with a common beginning."""
    c = F.col("path")
    return (c == path) | ((c >= f"{path}.") & (c < f"{path}/")) if include_children else c == path


def query_in_location(locations: DataFrame, path: str, include_children: bool = True, scope: Column | None = None) -> DataFrame:
    """Locations at or below a path, each id once, in order of path, id."""
    here = below_path(path, include_children)
    return locations.filter(here if scope is None else here & scope).dropDuplicates(["id"]).orderBy("path", "id")
