"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km of degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def midpoint(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """struct(lat, lon) halfway along the great circle."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    x, y = F.cos(b) * F.cos(d), F.cos(b) * F.sin(d)
    lat = F.atan2(F.sin(a) + F.sin(b), F.sqrt(F.pow(F.cos(a) + x, 2) + y * y))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.radians(lon1) + F.atan2(y, F.cos(a) + x)).alias("lon"))
