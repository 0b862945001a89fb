"""Distances, extents and safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def extent(lat: Column, radius_m: Column) -> tuple[Column, Column]:
    """Half sizes in degrees of latitude and longitude of a circle."""
    half = radius_m / METRES_PER_DEGREE
    return half, half / F.cos(F.radians(lat))


def walking_minutes(km: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(km * 12 + 0.5).cast("int"))


def clamp(c: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def half_up(c: Column, places: int = 1) -> Column:
    """A non-negative number rounded half up on its double value, as other engines do it too."""
    return F.floor(c * 10**places + 0.5) / float(10**places)


def rate(part: Column, whole: Column) -> Column:
    """Percent with one decimal, 0 where there is no whole."""
    return F.when(whole > 0, half_up(part * 100.0 / whole)).otherwise(F.lit(0.0))


def pages(total: Column, per: int) -> Column:
    return F.ceil(total / per).cast("long")


def identity_digest(*columns: Column) -> Column:
    """Digest of a tuple; null if one of it is blank."""
    missing = None
    for c in columns:
        blank = c.isNull() | (F.trim(c) == "")
        missing = blank if missing is None else missing | blank
    return F.when(~missing, F.sha2(F.to_json(F.array(*columns)), 256))
