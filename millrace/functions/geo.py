"""Distances and boxes on the globe as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth, kilometres in a mile, kilometres in a degree of latitude and of longitude at the equator.
EARTH_RADIUS_KM = 6371.0088
KM_PER_MILE = 1.609344
KM_PER_DEGREE_LAT = 110.574
KM_PER_DEGREE_LNG = 111.32


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in kilometres."""
    lat = F.radians(lat2 - lat1) / 2
    lng = F.radians(lng2 - lng1) / 2
    h = F.sin(lat) * F.sin(lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(lng) * F.sin(lng)
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def box_around(lat: float, lng: float, km: float) -> tuple[float, float, float, float]:
    """South, north, west and east edge of a box that holds every point within ``km``."""
    d_lat = km / KM_PER_DEGREE_LAT
    d_lng = km / (KM_PER_DEGREE_LNG * max(math.cos(math.radians(lat)), 0.01))
    return lat - d_lat, lat + d_lat, lng - d_lng, lng + d_lng


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    """Range predicates, which reach the scan; a distance does not."""
    return lat.between(box[0], box[1]) & lng.between(box[2], box[3])
