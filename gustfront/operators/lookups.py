"""Key joins: resume, reconcile, dimension lookup, alias resolution and status merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIVE_STATES = ("running", "idle", "processing", "starting")


def not_yet_done(rows: DataFrame, done: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows whose key has no committed row yet."""
    return rows.join(done.select(key), key, "left_anti")


def lookup_or_drop(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Inner lookup; rows without an entry are dropped. A key stands once in ``dimension``, or its rows come out once per entry."""
    return rows.join(dimension, key)


def count_misses(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows per key that the lookup would drop."""
    return rows.groupBy(key).agg(F.count("*").alias("missed")).join(dimension.select(key), key, "left_anti")


def reconcile(rows: DataFrame, artifacts: DataFrame, manifest: DataFrame, georefs: DataFrame) -> DataFrame:
    """Decide per expected tensor: reused, healed_orphan, healed_corrupt, new or skipped_no_georef.

    ``artifacts(tensor, loadable)`` lists what is stored, ``manifest(tensor)`` what is committed,
    ``georefs(station)`` the sites that can be cropped. A tensor that is listed twice is loadable if one of its artifacts is.
    """
    have = artifacts.groupBy("tensor").agg(F.bool_or("loadable").alias("loadable"))
    listed = manifest.select("tensor").distinct().withColumn("listed", F.lit(True))
    sites = georefs.select("station").distinct().withColumn("georef", F.lit(True))
    joined = rows.join(sites, "station", "left").join(have, "tensor", "left").join(listed, "tensor", "left")
    status = (
        F.when(F.col("georef").isNull(), "skipped_no_georef")
        .when(F.col("loadable") & F.col("listed").isNotNull(), "reused")
        .when(F.col("loadable"), "healed_orphan")
        .when(~F.col("loadable"), "healed_corrupt")
        .otherwise("new")
    )
    return joined.withColumn("action", status).drop("georef", "loadable", "listed")


def unlisted_artifacts(rows: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Stored tensors that no expected row asks for."""
    return artifacts.join(rows.select("tensor"), "tensor", "left_anti")


def join_with_reason(sample: DataFrame, manifest: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """Left join on a composite key; ``reason`` tells why a row cannot be compared."""
    joined = sample.join(manifest.withColumn("_hit", F.lit(True)), keys, "left")
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull()
    reason = F.when(F.col("_hit").isNull(), "no manifest row").when(missing, "missing artifact").otherwise("ok")
    return joined.withColumn("reason", reason).drop("_hit")


def resolve_alias(wanted: DataFrame, present: DataFrame, key: str, aliases: str) -> DataFrame:
    """First alias of an ordered list that exists in ``present(name, state)``; else 'not_found'."""
    tried = wanted.select(key, F.posexplode(aliases).alias("pos", "name")).join(present, "name")
    found = tried.groupBy(key).agg(F.min_by(F.struct("name", "state"), "pos").alias("hit"))
    return wanted.join(found, key, "left").select(
        *wanted.columns, F.coalesce("hit.state", F.lit("not_found")).alias("state"), F.col("hit.name").alias("matched")
    )


def effective_state(state: Column, status: Column) -> Column:
    """Trust a live status report when the container itself cannot be seen."""
    unseen = state.isNull() | state.isin("not_found", "")
    return F.when(unseen & F.lower(status).isin(*LIVE_STATES), "running").otherwise(F.coalesce(state, F.lit("not_found")))


def fill_capture_status(capture: DataFrame, processor: DataFrame, key: str) -> DataFrame:
    """Capture status with fallbacks: own report, then files seen, then the processor's totals.

    ``capture(key, state, total_captured, total_errors, files, last_file)``;
    ``processor(key, total_processed, last_processed)``. A row without ``total_captured`` has no report.
    """
    joined = capture.join(processor, key, "left")
    silent = F.col("total_captured").isNull()
    processed = F.coalesce("total_processed", F.lit(0))
    producing = (F.col("state") == "running") | (processed > 0)
    files = F.coalesce("files", F.lit(0))
    return joined.select(
        key,
        F.when(silent & producing, "running").otherwise(F.col("state")).alias("state"),
        F.when(silent, F.when(producing, "running").otherwise("unknown")).otherwise("reported").alias("status"),
        F.when(silent, F.when(files > 0, files).otherwise(processed)).otherwise(F.col("total_captured")).cast("long").alias("total_captured"),
        F.when(silent, F.lit(0)).otherwise(F.col("total_errors")).cast("long").alias("total_errors"),
        F.when(silent, F.coalesce("last_file", "last_processed")).otherwise(F.col("last_file")).alias("last_file"),
        silent.alias("synthetic"),
    )


def compare_arrays(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Add whether two number arrays are equal, and their largest and mean absolute difference.

    Arrays of unequal length, or a missing one, are different without a measure; two empty ones are equal.
    """
    same_size = F.size(left) == F.size(right)
    gaps = F.zip_with(left, right, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    total = F.aggregate("_gaps", F.lit(0.0), lambda acc, g: acc + g)
    compared = pairs.withColumn("_gaps", F.when(same_size, gaps))
    return compared.select(
        *pairs.columns, F.coalesce(same_size & (F.coalesce(F.array_max("_gaps"), F.lit(0.0)) == 0), F.lit(False)).alias("equal"),
        F.coalesce(F.array_max("_gaps"), F.when(same_size, F.lit(0.0))).alias("largest_difference"),
        F.when(F.size("_gaps") > 0, total / F.size("_gaps")).when(same_size, F.lit(0.0)).alias("mean_difference"),
    ).drop("_gaps")
