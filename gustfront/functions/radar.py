"""Radar-specific expressions: names, types, index codes and value bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gustfront.constants import BBOX


def in_bbox(lat: Column, lon: Column) -> Column:
    return (lon > BBOX["lon_min"]) & (lon < BBOX["lon_max"]) & (lat > BBOX["lat_min"]) & (lat < BBOX["lat_max"])


def off_null_island(lat: Column, lon: Column) -> Column:
    return (lat != 0) & (lon != 0)


def strong_enough(label: Column, mag: Column, min_ef: int) -> Column:
    """The magnitude floor binds confirmed tornadoes only."""
    return (label != "tornado") | (mag >= min_ef)


def radar_type(filename: Column) -> Column:
    name = F.lower(filename)
    return (
        F.when(name.contains("reflectivity"), "reflectivity").when(name.contains("velocity"), "velocity").otherwise("unknown")
    )


def event_key(subtype: Column, event_ts: Column, station: Column) -> Column:
    return F.concat_ws("_", subtype, F.date_format(event_ts, "yyyyMMdd_HHmm"), station)


def tensor_name(frame_path: Column, product: str = "N0B") -> Column:
    """File stem of the reflectivity frame without its product tag."""
    stem = F.regexp_replace(F.substring_index(frame_path, "/", -1), r"\.[^.]*$", "")
    return F.concat(F.lit("tensors/"), F.replace(stem, F.lit(f"_{product}"), F.lit("")), F.lit(".npy"))


def normalised_index(idx: Column, codes: dict) -> Column:
    """Missing codes become 0, others a share of the scale, clipped to [0, 1]."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), idx / F.lit(codes["denom"])))
    return F.when(idx.isin(*codes["missing"]), F.lit(0.0)).otherwise(share)


def is_severe(radar: Column, value: Column, limit: float = 50.0) -> Column:
    """Reflectivity above 50 dBZ or wind above 50 knots either way."""
    return F.when(radar == "reflectivity", value > limit).otherwise(F.abs(value) > limit)


def intensity_band(radar: Column, value: Column) -> Column:
    reflectivity = F.when(value < 0, "low").when(value < 40, "moderate").otherwise("high")
    velocity = F.when(value < -20, "away").when(value <= 20, "neutral").otherwise("toward")
    return F.when(radar == "reflectivity", reflectivity).otherwise(velocity)


def is_png(content: Column, length: Column, min_bytes: int = 200) -> Column:
    """PNG signature present and more than a stub."""
    return (F.substring(content, 1, 4) == F.lit(bytearray(b"\x89PNG"))) & (length > min_bytes)


def stacked_channels(reflectivity: Column, velocity: Column, size: Column) -> Column:
    """Two channels back to back; a missing velocity channel is all zero."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    return F.concat(reflectivity, F.coalesce(velocity, zeros))
