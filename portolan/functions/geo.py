"""Distances, bearings and points on a sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the Earth in km.
RADIUS_KM = 6371.0088


def turn(a: Column, b: Column) -> Column:
    """The angle from a to b, both in degrees, in radians. The difference of degrees is exact where they are whole numbers."""
    return F.radians(b - a)


def turn_of_radians(a: Column, b: Column) -> Column:
    """The same as a difference of radians. Half a turn apart, its rounding error decides the sign of a bearing, so it is for results defined by it."""
    return F.radians(b) - F.radians(a)


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_KM, turn=turn) -> Column:
    h = F.sin(turn(lat1, lat2) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(turn(lon1, lon2) / 2) ** 2
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column, turn=turn) -> Column:
    """Initial bearing in radians."""
    a, b, d = F.radians(lat1), F.radians(lat2), turn(lon1, lon2)
    return F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def destination(lat: Column, lon: Column, degrees: Column, km: Column, radius: float = RADIUS_KM) -> tuple[Column, Column]:
    """The point reached from another on a bearing, longitude from -180 to 180."""
    a, o, t, d = F.radians(lat), F.radians(lon), F.radians(degrees), km / radius
    lat2 = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    lon2 = o + F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(lat2))
    return F.degrees(lat2), F.pmod(F.degrees(lon2) + 540, F.lit(360.0)) - 180
