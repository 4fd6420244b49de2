"""Great-circle distance, spatial cells and raster georeferencing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gustfront.constants import BOX_KM, EARTH_RADIUS_KM, KM_PER_DEGREE, MIN_BOX_PX

_KM_PER_LAT_DEGREE = math.pi * EARTH_RADIUS_KM / 180.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres on a sphere of radius 6371 km."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def lat_cell(lat: Column, degrees: float) -> Column:
    return F.floor(lat / F.lit(degrees)).cast("long")


def lon_cell(lon: Column, degrees: float) -> Column:
    """Longitude cell, wrapped so that both sides of the date line meet."""
    return F.pmod(F.floor(lon / F.lit(degrees)).cast("long"), F.lit(round(360 / degrees)))


def lat_cells_within(lat: Column, km: float, degrees: float) -> Column:
    """Every latitude cell that a disc of ``km`` around the point can touch."""
    reach = km / _KM_PER_LAT_DEGREE + 1e-9
    return F.sequence(lat_cell(lat - reach, degrees), lat_cell(lat + reach, degrees))


def lon_cells_within(lat: Column, lon: Column, km: float, degrees: float) -> Column:
    """Every longitude cell of that disc; cells shrink with latitude, so the reach grows."""
    ratio = F.lit(math.sin(km / EARTH_RADIUS_KM)) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
    reach = F.when(ratio >= 1, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0))))) + 1e-9
    cells = round(360 / degrees)
    raw = F.sequence(
        F.floor((lon - reach) / F.lit(degrees)).cast("long"), F.floor((lon + reach) / F.lit(degrees)).cast("long")
    )
    return F.array_distinct(F.transform(raw, lambda x: F.pmod(x, F.lit(cells))))


def pixel_row(lat: Column, e: Column, f: Column) -> Column:
    return (lat - f) / e


def pixel_col(lon: Column, a: Column, c: Column) -> Column:
    return (lon - c) / a


def km_per_pixel(lat: Column, a: Column) -> Column:
    return F.abs(a) * KM_PER_DEGREE * F.cos(F.radians(lat))


def box_pixels(lat: Column, a: Column, box_km: float = BOX_KM) -> Column:
    """Side of the physical box in pixels, half-even rounding, at least 8."""
    side = F.rint(F.lit(box_km) / F.greatest(km_per_pixel(lat, a), F.lit(1e-6))).cast("int")
    return F.greatest(F.lit(MIN_BOX_PX), side)
