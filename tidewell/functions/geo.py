"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    s = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return F.lit(2 * RADIUS_KM) * F.asin(F.sqrt(s))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Direction in radians, east being 0, on a local plane."""
    return F.atan2(lat2 - lat1, (lon2 - lon1) * F.cos(F.radians(lat1)))


def distance_label(km: Column) -> Column:
    return F.when(km < 1, F.format_string("%d m", F.round(km * 1000).cast("int"))).otherwise(F.format_string("%.1f km", km))


def radial(km: Column, most: Column, angle: Column) -> tuple[Column, Column]:
    """Place on a map whose radius grows with the distance to the power 0.6."""
    r = F.pow(km / most, 0.6)
    return r * F.cos(angle), r * F.sin(angle)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """box: least longitude, least latitude, largest longitude, largest latitude; borders belong to it."""
    if len(box) != 4 or box[0] > box[2] or box[1] > box[3]:
        raise ValueError("a box is min lon, min lat, max lon, max lat")
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])
