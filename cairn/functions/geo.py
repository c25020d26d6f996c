"""Distances, boxes and grid cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import col

EARTH_KM = 6371.0


def haversine_km(lat1: Column | str, lng1: Column | str, lat2: Column | str, lng2: Column | str) -> Column:
    a1, g1, a2, g2 = (F.radians(col(c)) for c in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((g2 - g1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(h))


def inside(lat: Column | str, lng: Column | str, box: tuple[float, float, float, float]) -> Column:
    south, north, west, east = box
    return col(lat).between(south, north) & col(lng).between(west, east)


def cell(x: Column | str, size: float) -> Column:
    return F.floor(col(x) / size)


def damage_height(p: Column | str) -> Column:
    """Height on the map, in metres, of a footprint that is damaged with probability p."""
    return F.lit(6.0) + F.lit(26.0) * col(p)


def zone_radius(total: Column | str) -> Column:
    """Radius on the map, in pixels, of a zone's circle of ``total`` people."""
    return F.least(F.lit(38.0), F.lit(7.0) + F.lit(1.7) * F.sqrt(col(total)))


def jitter(x: Column | str, key: Column | str, spread: float) -> Column:
    """x moved by up to ``spread`` either way, the same for one key each time."""
    part = F.pmod(F.xxhash64(col(key)), F.lit(1_000_001)) / 1_000_000
    return col(x) + (part * 2 - 1) * spread
