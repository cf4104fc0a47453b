"""Great-circle geometry. Functions of columns give columns; functions of numbers give numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: The fitted power law between a sphere grid's size and its spacing in km.
SPACING_POWER = -2.01155176
SPACING_LOG_SCALE = 20.0165958


def _positive(name: str, value: float) -> None:
    if not value > 0:
        raise ValueError(f"{name} must be positive")


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_KM) -> Column:
    """Haversine distance of points in degrees, in the unit of the radius."""
    _positive("radius", radius)
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1.0 - a, F.lit(0.0))))


def degrees_to_km(step: float, radius: float = EARTH_KM) -> float:
    """Length of a step along the equator."""
    _positive("step", step)
    _positive("radius", radius)
    half = math.radians(step) / 2
    a = math.sin(half) ** 2
    return 2 * radius * math.atan2(math.sqrt(a), math.sqrt(max(1 - a, 0.0)))


def degrees_to_km_column(step: Column, radius: float = EARTH_KM) -> Column:
    a = F.sin(F.radians(step) / 2) * F.sin(F.radians(step) / 2)
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1.0 - a, F.lit(0.0))))


def km_to_degrees(distance: float, radius: float = EARTH_KM) -> float:
    _positive("distance", distance)
    _positive("radius", radius)
    return distance * 360 / (2 * math.pi * radius)


def km_to_degrees_column(distance: Column, radius: float = EARTH_KM) -> Column:
    return distance * F.lit(360 / (2 * math.pi * radius))


def to_cartesian(lon: Column, lat: Column, radius: float = 1.0) -> tuple[Column, Column, Column]:
    _positive("radius", radius)
    flat = F.cos(F.radians(lat)) * radius
    return flat * F.cos(F.radians(lon)), flat * F.sin(F.radians(lon)), F.sin(F.radians(lat)) * radius


def to_geographic(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """lon, lat in degrees of points on the unit sphere; NaN where |z| exceeds 1."""
    return F.degrees(F.atan2(y, x)), F.degrees(F.asin(z))


def to_geographic_any(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """lon, lat of points at any distance from the centre."""
    r = F.sqrt(x * x + y * y + z * z)
    return to_geographic(x / r, y / r, z / r)


def from_angles(polar: Column, azimuth: Column, radius: float = 1.0) -> tuple[Column, Column, Column]:
    """Cartesian coordinates from the angle off the pole and the angle around it, in radians."""
    flat = F.sin(polar) * radius
    return flat * F.cos(azimuth), flat * F.sin(azimuth), F.cos(polar) * radius


def points_to_spacing(n: int) -> float:
    """Spacing in km of a sphere grid with n points."""
    if not isinstance(n, int) or isinstance(n, bool) or n <= 0:
        raise ValueError("the number of points must be a positive integer")
    return (n / math.exp(SPACING_LOG_SCALE)) ** (1 / SPACING_POWER)


def spacing_to_points(km: float) -> int:
    """Points of a sphere grid with that spacing, truncated."""
    _positive("spacing", km)
    return int(math.exp(SPACING_LOG_SCALE) * km**SPACING_POWER)


def points_to_spacing_column(n: Column) -> Column:
    return F.pow(n / F.lit(math.exp(SPACING_LOG_SCALE)), F.lit(1 / SPACING_POWER))


def spacing_to_points_column(km: Column) -> Column:
    return (F.lit(math.exp(SPACING_LOG_SCALE)) * F.pow(km, F.lit(SPACING_POWER))).cast("long")
