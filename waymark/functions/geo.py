"""Distances and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Latitudes and longitudes outside these are no places.
LATITUDES, LONGITUDES = (20.0, 50.0), (120.0, 155.0)


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres on a sphere of radius 6,371,000 m."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def is_place(lat: Column, lon: Column) -> Column:
    """Whether both coordinates lie where places can be; false for null and NaN."""
    return F.coalesce(lat.between(*LATITUDES) & lon.between(*LONGITUDES), F.lit(False))
