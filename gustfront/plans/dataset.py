"""Event reports to labelled scan manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustfront.constants import REFLECTIVITY_PRODUCT, VELOCITY_PRODUCT
from gustfront.functions.radar import event_key
from gustfront.operators.lookups import not_yet_done
from gustfront.operators.pairing import closest_scans, product_minutes, pair_velocity
from gustfront.operators.proximity import exclude_near, nearest_station

MANIFEST_COLUMNS = [
    "event_id", "label", "class", "subtype", "station", "mag", "event_lat", "event_lon", "dist_km", "date", "scan_time", "refl", "vel",
]


def event_class() -> Column:
    return F.when(F.col("subtype") == "tornado", "tornado").otherwise("no_tornado")


def manifest_row() -> list[Column]:
    """Columns of a manifest row from an event joined to one scan (and perhaps a velocity scan)."""
    scan_stamp = F.date_format("scan_ts", "yyyyMMdd_HHmm")
    frame = lambda product: F.concat(F.lit("raw/"), event_class(), F.lit("/"), F.concat_ws("_", "event_id", scan_stamp, F.lit(product)), F.lit(".png"))
    return [
        F.col("event_id"), F.when(F.col("subtype") == "tornado", 1).otherwise(0).alias("label"), event_class().alias("class"), F.col("subtype"),
        F.col("station"), F.col("mag"), F.col("lat").alias("event_lat"), F.col("lon").alias("event_lon"), F.bround("dist_km", 1).alias("dist_km"),
        F.date_format("event_ts", "yyyy-MM-dd").alias("date"), F.date_format("scan_ts", "yyyy-MM-dd'T'HH:mm'Z'").alias("scan_time"),
        frame(REFLECTIVITY_PRODUCT).alias("refl"), F.when(F.col("pair_id").isNotNull(), frame(VELOCITY_PRODUCT)).alias("vel"),
    ]


def collectable_events(events: DataFrame, exclusion_min_mag: int = 1) -> DataFrame:
    """Reports plus those warnings that no confirmed tornado (of the minimum magnitude) explains."""
    warning = F.col("subtype") == "warning_no_torn"
    confirmed = events.where((F.col("subtype") == "tornado") & (F.col("mag") >= exclusion_min_mag))
    return events.where(~warning).unionByName(exclude_near(events.where(warning), confirmed))


def build_manifest(events: DataFrame, stations: DataFrame, scans: DataFrame, done: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Site, closest scans and velocity pair of each event; ids already in ``done`` are skipped.

    Reports that share minute, type and site share an id; the first report with scans keeps it. Scans collapse
    once for both products and are paired scan to scan before any event is repeated for its scans.
    """
    paired = pair_velocity(*product_minutes(scans, REFLECTIVITY_PRODUCT, VELOCITY_PRODUCT))
    placed = nearest_station(events, stations)
    placed = placed.withColumn("event_id", event_key(F.col("subtype"), F.col("event_ts"), F.col("station")))
    if done is not None:
        placed = not_yet_done(placed, done)
    chosen = closest_scans(placed, paired, k, identity="event_id", carry=("pair_id",))
    return chosen.select(*manifest_row())
