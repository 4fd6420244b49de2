"""Freshness and verdict ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gustfront.constants import IDLE_MINUTES, MAX_SCORE_AGE_SECONDS


def seconds_between(earlier: Column, later: Column) -> Column:
    return F.unix_timestamp(later) - F.unix_timestamp(earlier)


def score_freshness(status: Column, score_ts: Column, as_of: Column, max_age: int = MAX_SCORE_AGE_SECONDS) -> Column:
    """A running score past its age limit reads as stale."""
    old = (status == "running") & (seconds_between(score_ts, as_of) > max_age)
    return F.when(F.coalesce(old, F.lit(False)), "stale").otherwise(status)


def idle_health(last_ts: Column, as_of: Column, minutes: int = IDLE_MINUTES) -> Column:
    """Unhealthy after more than 20 idle minutes; never-started services get grace."""
    idle = (F.unix_micros(as_of) - F.unix_micros(last_ts)) / F.lit(60e6)
    return F.when(F.coalesce(idle > minutes, F.lit(False)), "unhealthy").otherwise("healthy")


def idle_reason(last_ts: Column, as_of: Column, minutes: int = IDLE_MINUTES) -> Column:
    idle = (F.unix_micros(as_of) - F.unix_micros(last_ts)) / F.lit(60e6)
    return F.when(
        F.coalesce(idle > minutes, F.lit(False)), F.concat(F.lit("no processing for "), F.floor(idle).cast("string"), F.lit(" minutes"))
    ).otherwise("ok")


def ladder(value: Column, steps: list[tuple[float, str]], last: str, strict: bool = False) -> Column:
    """First label whose lower bound the value reaches (or exceeds, when ``strict``)."""
    out = F.lit(last)
    for bound, label in reversed(steps):
        out = F.when(value > bound if strict else value >= bound, F.lit(label)).otherwise(out)
    return out


def quality_grade(score: Column) -> Column:
    return ladder(score, [(80, "A - EXCELLENT"), (70, "B - GOOD"), (60, "C - ACCEPTABLE")], "D - NEEDS WORK")


def masked_grade(score: Column) -> Column:
    return ladder(score, [(85, "A"), (70, "B"), (55, "C"), (40, "D")], "F")


def accuracy_verdict(within_10: Column) -> Column:
    return ladder(within_10, [(95, "EXCELLENT"), (85, "GOOD"), (70, "FAIR")], "POOR", strict=True)


def masked_composite(within_5: Column, within_10: Column, within_20: Column, sample_rate: int = 1) -> Column:
    """Weighted accuracy; coarser sampling earns a bonus, capped at 100."""
    score = within_5 * 0.4 + within_10 * 0.3 + within_20 * 0.3
    return F.least(F.lit(100.0), score * (1 + (sample_rate - 1) * 0.15)) if sample_rate > 1 else score


def quality_composite(coverage, consistency, diversity, weather, smoothness) -> Column:
    """Five metrics weighted 15/35/20/15/15.

    The weather share arrives in percent and is still scaled by 100/0.30, so 0.3 % already earns full marks.
    """
    weather_score = F.least(F.lit(100.0), weather / 0.30 * 100)
    return coverage * 0.15 + consistency * 0.35 + diversity * 0.20 + weather_score * 0.15 + smoothness * 0.15


# Bounds above which a grid metric earns each label, and the label below them.
METRIC_LADDERS = {
    "range_coverage": ([(50, "GOOD")], "LIMITED"),
    "spatial_consistency": ([(70, "EXCELLENT"), (50, "GOOD")], "WEAK"),
    "value_diversity": ([(30, "EXCELLENT"), (15, "GOOD")], "LIMITED"),
    "weather_coverage": ([(30, "SUBSTANTIAL"), (10, "MODERATE")], "LIGHT"),
    "gradient_quality": ([(70, "SMOOTH"), (50, "ACCEPTABLE")], "NOISY"),
}


def metric_verdict(metric: str, value: Column) -> Column:
    """Label of one grid metric, in percent; bounds must be exceeded."""
    steps, last = METRIC_LADDERS[metric]
    return ladder(value, steps, last, strict=True)
