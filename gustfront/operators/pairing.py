"""Time joins: interval, nearest, newest and last-known-value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustfront.constants import LIVE_PAIR_SECONDS, VELOCITY_TOLERANCE_MIN, WINDOW_AFTER_MIN, WINDOW_BEFORE_MIN


def _slot(ts: Column, seconds: int, shift: int = 0) -> Column:
    return F.floor((F.unix_micros(ts) + shift * 1_000_000) / (seconds * 1_000_000)).cast("long")


def minute_scans(scans: DataFrame) -> DataFrame:
    """One row per site, product and minute (smallest id), the resolution of a listing.

    This bounds every later time window: 40 minutes hold at most 41 scans of one product.
    """
    return (
        scans.withColumn("scan_ts", F.date_trunc("minute", "scan_ts"))
        .groupBy("station", "product", "scan_ts")
        .agg(F.min("scan_id").alias("scan_id"))
    )


def product_minutes(scans: DataFrame, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """``minute_scans`` of two products from one pass: both come out of one row per site and minute."""
    ids = [F.min(F.when(F.col("product") == p, F.col("scan_id"))).alias(n) for p, n in ((first, "_first"), (second, "_second"))]
    both = scans.withColumn("scan_ts", F.date_trunc("minute", "scan_ts")).groupBy("station", "scan_ts").agg(*ids)
    one = lambda n: both.where(F.col(n).isNotNull()).select("station", F.col(n).alias("scan_id"), "scan_ts")
    return one("_first"), one("_second")


def closest_scans(
    events: DataFrame,
    scans: DataFrame,
    k: int = 5,
    before_min: int = WINDOW_BEFORE_MIN,
    after_min: int = WINDOW_AFTER_MIN,
    key: str = "report_id",
    same_day_only: bool = False,
    identity: str | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """The ``k`` scans of the event's site closest in time within [-before, +after] minutes.

    With ``identity`` (the event id) only the first event, by ``key``, that has scans keeps the id;
    reports of one id and instant see the same scans, so they collapse before any join.

    Events are repeated for the one or two time slots their window touches and meet scans on
    (site, slot), so a busy site is split over time. Ties go to the earlier scan. ``carry`` names further scan columns.
    """
    slot = (before_min + after_min) * 60
    if identity is not None:
        first = F.min_by(F.struct(*events.columns), key).alias("first")
        events = events.groupBy(F.col(identity).alias("_id"), F.col("station").alias("_s"), F.col("event_ts").alias("_ts")).agg(first).select("first.*")
    spread = events.withColumn(
        "slot", F.explode(F.sequence(_slot(F.col("event_ts"), slot, -before_min * 60), _slot(F.col("event_ts"), slot, after_min * 60)))
    )
    listed = scans.select("station", "scan_id", "scan_ts", *carry, _slot(F.col("scan_ts"), slot).alias("slot"))
    gap = F.unix_micros("scan_ts") - F.unix_micros("event_ts")
    paired = spread.join(listed, ["station", "slot"]).where(gap.between(-before_min * 60_000_000, after_min * 60_000_000))
    if same_day_only:
        paired = paired.where(F.to_date("scan_ts") == F.to_date("event_ts"))
    if identity is None:
        order = Window.partitionBy(key).orderBy(F.abs(gap), "scan_ts")
        return paired.withColumn("_pick", F.row_number().over(order)).where(F.col("_pick") <= k).drop("slot", "_pick")
    order = Window.partitionBy(identity).orderBy(key, F.abs(gap), "scan_ts")
    ranked = paired.withColumn("_pick", F.row_number().over(order)).withColumn("_owner", F.first(key).over(order))
    return ranked.where((F.col("_pick") <= k) & (F.col(key) == F.col("_owner"))).drop("slot", "_pick", "_owner")


def nearest_in_time(
    targets: DataFrame,
    candidates: DataFrame,
    on: list[str],
    target_ts: str,
    candidate_ts: str,
    candidate_id: str,
    tolerance_seconds: int,
    keep_unmatched: bool = True,
) -> DataFrame:
    """Attach id, time and gap of the nearest candidate within a tolerance.

    ``targets`` must be unique as rows and ``candidates`` unique per (on, time). The gap and its
    side fit one integer, so the reduction hashes; ties go to the earlier candidate.
    """
    slot = 2 * tolerance_seconds
    micros = tolerance_seconds * 1_000_000
    near = candidates.select(
        *on,
        F.unix_micros(candidate_ts).alias("_c"),
        F.col(candidate_id).alias("_id"),
        F.explode(F.sequence(_slot(F.col(candidate_ts), slot, -tolerance_seconds), _slot(F.col(candidate_ts), slot, tolerance_seconds))).alias("_slot"),
    ).alias("c")
    left = targets.withColumn("_slot", _slot(F.col(target_ts), slot)).alias("t")
    match = [F.col(f"t.{name}") == F.col(f"c.{name}") for name in (*on, "_slot")]
    diff = F.col("c._c") - F.unix_micros(F.col(f"t.{target_ts}"))
    condition = F.abs(diff) <= micros
    for part in match:
        condition = part & condition
    joined = left.join(near, condition, "left" if keep_unmatched else "inner")
    code = F.abs(diff) * 2 + F.when(diff > 0, 1).otherwise(0)
    kept = [F.col(f"t.{name}").alias(name) for name in targets.columns]
    best = joined.select(*kept, code.alias("_code"), F.col("c._id").alias("_id")).groupBy(*targets.columns)
    best = best.agg(F.min("_code").alias("_code"), F.min_by("_id", "_code").alias("pair_id"))
    gap = F.floor(F.col("_code") / 2).cast("long")
    signed = F.when(F.col("_code") % 2 == 1, gap).otherwise(-gap)
    return best.select(
        *targets.columns,
        "pair_id",
        F.timestamp_micros(F.unix_micros(target_ts) + signed).alias("pair_ts"),
        (gap / F.lit(1_000_000)).alias("gap_seconds"),
    )


def pair_velocity(reflectivity: DataFrame, velocity: DataFrame, tolerance_min: int = VELOCITY_TOLERANCE_MIN) -> DataFrame:
    """Nearest velocity scan of the same site for each reflectivity scan; missing velocity is kept."""
    return nearest_in_time(reflectivity, velocity, ["station"], "scan_ts", "scan_ts", "scan_id", tolerance_min * 60)


def newest_pair(reflectivity: DataFrame, velocity: DataFrame, as_of: Column, tolerance_seconds: int = LIVE_PAIR_SECONDS, stations: DataFrame | None = None) -> DataFrame:
    """Newest reflectivity scan per site over yesterday and today, with its velocity or the reason for none.

    With the site list, sites without any such scan come too, with their reason.
    """
    midnight = F.date_trunc("day", as_of)
    recent = lambda df: df.where((F.col("scan_ts") >= midnight - F.expr("interval 1 day")) & (F.col("scan_ts") < midnight + F.expr("interval 1 day")))
    newest = recent(reflectivity).groupBy("station").agg(
        F.max("scan_ts").alias("scan_ts"), F.max_by("scan_id", "scan_ts").alias("scan_id")
    )
    paired = nearest_in_time(newest, recent(velocity), ["station"], "scan_ts", "scan_ts", "scan_id", tolerance_seconds)
    reason = F.when(F.col("pair_id").isNull(), F.concat(F.lit(f"no velocity within {tolerance_seconds}s of "), F.date_format("scan_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    rated = paired.withColumn("reason", F.coalesce(reason, F.lit("paired")))
    if stations is None:
        return rated
    every = stations.select("station").distinct().join(rated, "station", "left")
    return every.withColumn("reason", F.coalesce("reason", F.lit("no recent reflectivity")))


def last_known(requests: DataFrame, facts: DataFrame, request_ts: str, fact_ts: str, fact_id: str, slot_seconds: int = 600) -> DataFrame:
    """For each distinct request time, the latest fact at or before it (one global timeline).

    Both sides shrink to distinct times first. Time is cut into slots; a slot's opening value comes
    from a window over one row per non-empty slot, and only rows inside a slot are ordered together.
    Returns ``request_ts`` and ``fact`` (a struct of the fact columns; NULL before the first fact).
    """
    columns = facts.columns
    body = F.struct(*columns)
    latest = facts.groupBy(fact_ts).agg(F.max_by(body, fact_id).alias("fact")).withColumnRenamed(fact_ts, "at").withColumn("ask", F.lit(False))
    wanted = requests.select(F.col(request_ts).alias("at")).distinct().withColumn("ask", F.lit(True))
    line = latest.unionByName(wanted, allowMissingColumns=True).withColumn("slot", _slot(F.col("at"), slot_seconds))
    per_slot = line.groupBy("slot").agg(F.max_by("fact", F.when(~F.col("ask"), F.col("at"))).alias("closing"))
    carried = F.last("closing", ignorenulls=True).over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    opening = per_slot.select("slot", carried.alias("opening"))
    inside = Window.partitionBy("slot").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    known = line.withColumn("fact", F.last("fact", ignorenulls=True).over(inside)).where("ask")
    return known.join(opening, "slot").select(F.col("at").alias(request_ts), F.coalesce("fact", "opening").alias("fact"))
