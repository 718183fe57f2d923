"""Distances and geohashes of points as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius in metres for points in SQL, and for geo sets.
SQL_RADIUS, SET_RADIUS = 6_371_000.0, 6_371_008.8

UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.344}

# The alphabet of geohashes.
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1: Column | float, lng1: Column | float, lat2: Column | float, lng2: Column | float, radius: float = SET_RADIUS) -> Column:
    """Great-circle distance in metres."""
    lat1, lng1, lat2, lng2 = map(_col, (lat1, lng1, lat2, lng2))
    half_lat, half_lng = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2 * radius) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def box_around(lat: float, lng: float, metres: float, radius: float = SET_RADIUS) -> tuple[float, float, float, float]:
    """Latitudes and longitudes that contain the circle; all longitudes where it holds a pole or meets the antimeridian."""
    angle = metres / radius
    low, high = lat - math.degrees(angle), lat + math.degrees(angle)
    if low <= -90 or high >= 90:
        return max(low, -90.0), min(high, 90.0), -180.0, 180.0
    spread = math.degrees(math.asin(min(1.0, math.sin(min(angle, math.pi / 2)) / math.cos(math.radians(lat)))))
    if lng - spread < -180 or lng + spread > 180:
        return low, high, -180.0, 180.0
    return low, high, lng - spread, lng + spread


def within(lat: Column, lng: Column, center_lat: float, center_lng: float, metres: float, radius: float = SQL_RADIUS) -> Column:
    """Whether a point is at most so far from the centre. A box that the scan can push down comes before the exact test."""
    low, high, west, east = box_around(center_lat, center_lng, metres * 1.000001 + 0.001, radius)
    inside = lat.between(low, high) & lng.between(west, east) & (haversine(center_lat, center_lng, lat, lng, radius) <= metres)
    return F.coalesce(inside, F.lit(False))


def geohash(lat: Column, lng: Column, length: int = 11) -> Column:
    """Interleaved bits of longitude and latitude, five to a character. The halves of both ranges are whole multiples, so arithmetic gives each bit."""
    bits = 5 * length
    lng_bits, lat_bits = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lng + 180) / 360 * float(1 << lng_bits)), F.lit((1 << lng_bits) - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * float(1 << lat_bits)), F.lit((1 << lat_bits) - 1)).cast("long")
    letters = []
    for k in range(length):
        value = F.lit(0).cast("long")
        for bit in range(5 * k, 5 * k + 5):
            source, place = (x, lng_bits - 1 - bit // 2) if bit % 2 == 0 else (y, lat_bits - 1 - bit // 2)
            value = value * 2 + F.shiftright(source, place) % 2
        letters.append(F.substring(F.lit(_BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)
