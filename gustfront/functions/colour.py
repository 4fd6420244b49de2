"""Colour classes, masks and difference maps on red, green and blue columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _all(op, bound: int, *channels: Column) -> Column:
    return reduce(lambda a, b: a & b, [op(c, bound) for c in channels])


def _above(c, n):
    return c > n


def _below(c, n):
    return c < n


def is_white(r: Column, g: Column, b: Column, over: int = 240) -> Column:
    return _all(_above, over, r, g, b)


def is_dark(r: Column, g: Column, b: Column, under: int = 50) -> Column:
    return _all(_below, under, r, g, b)


def colour_class(r: Column, g: Column, b: Column) -> Column:
    """Likely meaning of a frame colour, classes 1 to 4 by rising intensity; the first rule that holds decides."""
    return (
        F.when(r.between(200, 240) & g.between(190, 230) & b.between(150, 200), "ground")
        .when(is_white(r, g, b), "blank")
        .when(is_dark(r, g, b), "ink")
        .when((b > r) & (b > g) & (b > 100), "class 1")
        .when((g > r) & (g > b) & (g > 100), "class 2")
        .when((r > 150) & (g > 100) & (b < 100), "class 3")
        .when((r > 150) & (b > 100) & (g < 100), "class 4")
        .otherwise("other")
    )


def colour_words(r: Column, g: Column, b: Column) -> Column:
    """Name of a scale colour, in plain integer arithmetic."""
    return (
        F.when(is_dark(r, g, b, 60), "near black")
        .when((b > r + 30) & (b > g + 30) & (b > 150), "strong blue")
        .when((b > r + 30) & (b > g + 30), "blue")
        .when((g > r + 20) & (g > b + 20), "green")
        .when((r > 150) & (g > 150) & (b < 100), "yellow")
        .when((r > 200) & (g < 150), "red")
        .when((r > 150) & (g < 150), "orange")
        .when((r > 100) & (b > 100) & (g < 100), "purple")
        .when((F.abs(r - g) < 20) & (F.abs(g - b) < 20), "gray")
        .otherwise("other")
    )


def weather_mask(r: Column, g: Column, b: Column) -> Column:
    """True for a pixel that may show weather: neither near-white nor near-black."""
    very_light = (r >= 250) & (g >= 250) & (b >= 245)
    very_dark = (r <= 40) & (g <= 40) & (b <= 40)
    return ~very_light & ~very_dark


def tunable_mask(
    r: Column, g: Column, b: Column, tolerance: int = 25, dark: int = 50, white: int = 245, centre=(220, 210, 175)
) -> Column:
    """Mask with adjustable background tolerance and dark/white thresholds."""
    background = reduce(lambda a, c: a & c, [F.abs(ch - mid) <= tolerance for ch, mid in zip((r, g, b), centre)])
    light = (r >= white) & (g >= white) & (b >= white)
    black = (r <= dark) & (g <= dark) & (b <= dark)
    return ~background & ~light & ~black


def difference_map(diff: Column, keep: Column | None = None) -> Column:
    """Error amplified tenfold into 0..255; pixels outside ``keep`` turn mid grey."""
    shown = F.least(F.lit(255), F.greatest(F.lit(0), diff * 10)).cast("int")
    return shown if keep is None else F.when(keep, shown).otherwise(F.lit(128))
