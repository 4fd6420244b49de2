"""Rounding, formatting and scoring arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(value: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: the array-library rule for grid values."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def fixed_text(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounding the exact binary value half to even.

    Java's formatter rounds the printed decimal instead and differs on values such as 6.55.
    The fraction is a count of 2**-48 and what lies below that, so no bit is lost for up to four
    decimals. Whole part and decimals stay apart, so nothing overflows below 2**63.
    """
    unit = 10**digits
    size = F.abs(value)
    whole = F.floor(size).cast("long")
    fine = (size - whole) * F.lit(2.0**48)
    count = F.floor(fine).cast("long")
    parts, below = count * F.lit(unit), (fine - count) * F.lit(float(unit))
    kept, missing = F.shiftright(parts, 48), F.lit(2**47) - parts.bitwiseAND(F.lit(2**48 - 1))
    odd = (kept if digits else whole) % 2 == 1
    up = (below > missing) | ((below == missing) & odd)
    scaled = kept + up.cast("long")
    full = (scaled >= unit).cast("long")
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    if digits == 0:
        return F.concat(sign, (whole + scaled).cast("string"))
    return F.concat(sign, (whole + full).cast("string"), F.lit("."), F.lpad((scaled - full * unit).cast("string"), digits, "0"))


def logistic_score(logit: Column) -> Column:
    """Squash to (0, 1) and keep four decimals."""
    return round_even(F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)), 4)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent; NULL for an empty whole."""
    return part * F.lit(100.0) / F.nullif(whole, F.lit(0))


def truncated_magnitude(text: Column) -> Column:
    """Whole magnitude toward zero; empty or absent text is -9, other text NULL."""
    given = F.when(F.coalesce(text, F.lit("")) == "", F.lit("-9")).otherwise(text)
    return given.try_cast("double").try_cast("int")


def min_max_scaled(value: Column, low: Column, high: Column) -> Column:
    return (value - low) / F.nullif(high - low, F.lit(0.0))


def file_size_text(size: Column) -> Column:
    """1536 -> '1.5 KB'; units step at 1024."""
    size = size.cast("double")
    text = F.concat(fixed_text(size / F.lit(1024.0**4), 1), F.lit(" TB"))
    for step, unit in reversed(list(enumerate(["B", "KB", "MB", "GB"]))):
        scaled = size / F.lit(1024.0**step)
        text = F.when(scaled < 1024, F.concat(fixed_text(scaled, 1), F.lit(f" {unit}"))).otherwise(text)
    return text
