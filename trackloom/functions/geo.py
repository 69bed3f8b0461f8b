"""Geometry on latitude and longitude columns in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
METRES_PER_DEGREE = 111194.92664455873  # pi / 180 * EARTH_M
#: Inclusive default region.
REGION = {"min_lat": 39.4, "max_lat": 40.6, "min_lon": 115.7, "max_lon": 117.4}
METRICS = ("euclidean", "haversine")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(1.0) - a, F.lit(0.0))))


def euclidean(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in degrees."""
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2))


def distance(metric: str, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    check_metric(metric)
    return (euclidean if metric == "euclidean" else haversine_m)(lat1, lon1, lat2, lon2)


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, north 0, clockwise, in [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return (F.degrees(F.atan2(y, x)) + 360.0) % 360.0


def known(c: Column) -> Column:
    """Neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def in_region(lat: Column, lon: Column, region: dict = REGION) -> Column:
    """Inside the region, borders included; NaN is outside."""
    return known(lat) & known(lon) & lat.between(region["min_lat"], region["max_lat"]) & lon.between(region["min_lon"], region["max_lon"])


def cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size))
