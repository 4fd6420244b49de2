"""Collection, conversion and service rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustfront.constants import EXPECTED_PIXELS_PER_SECOND
from gustfront.functions.numbers import percent


def collection_report(manifest: DataFrame) -> DataFrame:
    """Scans, class balance, scans with velocity and distinct events of a manifest."""
    per_event = manifest.groupBy("event_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.coalesce("vel", F.lit("")) != "").alias("vel")
    )
    return per_event.agg(
        F.sum("n").alias("scans"), F.sum("pos").alias("positive"), (F.sum("n") - F.sum("pos")).alias("negative"),
        F.sum("vel").alias("with_velocity"), F.count("*").alias("events"),
    )


def active_by_type(alerts: DataFrame, by: list[str] | None = None) -> DataFrame:
    return alerts.groupBy(*(by or []), "event").agg(F.count("*").alias("active"))


def active_snapshot(alerts: DataFrame) -> DataFrame:
    """All types in one map with the tornado count beside it (types are few by nature)."""
    counts = active_by_type(alerts)
    pairs = F.array_sort(F.collect_list(F.struct("event", "active")))
    return counts.agg(
        F.sum("active").alias("active_warnings"), F.coalesce(F.max(F.when(F.col("event") == "Tornado Warning", F.col("active"))), F.lit(0)).alias("active_tornado"),
        F.map_from_entries(pairs).alias("active_by_type"),
    )


def folder_stats(files: DataFrame, by: list[str] | None = None, length: str = "length") -> DataFrame:
    """File count and megabytes to two decimals."""
    return files.groupBy(*(by or [])).agg(
        F.count("*").alias("files"), F.bround(F.coalesce(F.sum(length), F.lit(0)) / F.lit(1048576.0), 2).alias("size_mb")
    )


def batch_progress(log: DataFrame, expected: int | Column, started: Column, as_of: Column) -> DataFrame:
    """Percent done, rate per minute and minutes to go, as of an instant."""
    total = F.lit(expected) if isinstance(expected, int) else expected
    facts = log.agg(F.count_if(F.col("success")).alias("processed"), F.count_if(~F.col("success")).alias("errors"))
    elapsed = (F.unix_micros(as_of) - F.unix_micros(started)) / F.lit(1e6)
    rate = F.when(elapsed > 0, F.col("processed") / elapsed).otherwise(0.0)
    left = F.when(rate > 0, (total - F.col("processed") - F.col("errors")) / rate).otherwise(0.0)
    return facts.select(
        total.cast("long").alias("total"), "processed", "errors",
        F.bround(F.coalesce(percent(F.col("processed") + F.col("errors"), total), F.lit(0.0)), 1).alias("percent"),
        F.bround(elapsed / 60, 1).alias("elapsed_min"), F.bround(rate * 60, 1).alias("rate_per_min"), F.bround(left / 60, 1).alias("eta_min"),
    )


def in_flight(progress: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Average progress of images in work; one image shows its name, several their number."""
    facts = progress.groupBy(*(by or [])).agg(F.count("*").alias("images"), F.avg("progress").alias("avg"), F.min("filename").alias("name"))
    return facts.select(
        *(by or []), "images", F.coalesce(F.rint("avg"), F.lit(0.0)).cast("long").alias("progress_percent"),
        F.when(F.col("images") == 1, F.col("name")).when(F.col("images") > 1, F.concat(F.col("images").cast("string"), F.lit(" images"))).alias("current_image"),
    )


def throughput(log: DataFrame, by: list[str] | None = None, expected_rate: int = EXPECTED_PIXELS_PER_SECOND) -> DataFrame:
    """Time and pixel rate of conversions against the expected rate.

    ``log(secs, pixels, success)``; slow above 1.5 times and very slow above 3 times the expected time.
    """
    facts = log.where("success").groupBy(*(by or [])).agg(F.count("*").alias("images"), F.sum("secs").alias("total_secs"), F.sum("pixels").alias("pixels"))
    expected = F.col("pixels") / F.lit(float(expected_rate))
    verdict = F.when(F.col("total_secs") > expected * 3, "extremely slow").when(F.col("total_secs") > expected * 1.5, "slower than expected").otherwise("normal")
    return facts.select(
        *(by or []), "images", "total_secs", (F.col("total_secs") / F.col("images")).alias("secs_per_image"), expected.alias("expected_secs"),
        (F.col("pixels") / F.nullif(F.col("total_secs"), F.lit(0.0))).alias("pixels_per_second"),
        (F.lit(3600.0) * F.col("images") / F.nullif(F.col("total_secs"), F.lit(0.0))).alias("images_per_hour"), verdict.alias("verdict"),
    )


def stage_timing(log: DataFrame, stages: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean seconds per conversion stage from a timing struct."""
    return log.groupBy(*(by or [])).agg(*[F.avg(f"timing.{s}").alias(f"avg_{s}") for s in stages], F.avg(sum((F.col(f"timing.{s}") for s in stages), F.lit(0.0))).alias("avg_total"))


def pipeline_overview(status: DataFrame, capture: Column, processor: Column) -> DataFrame:
    """Captured, processed and error totals over services; captures fall back to the processed count."""
    captured = F.coalesce(F.sum(F.when(capture, F.col("total"))), F.lit(0))
    processed = F.coalesce(F.sum(F.when(processor, F.col("total"))), F.lit(0))
    errors = F.coalesce(F.sum(F.when(capture | processor, F.col("errors"))), F.lit(0))
    return status.agg(
        F.when(captured == 0, processed).otherwise(captured).alias("captured"), processed.alias("processed"), errors.alias("errors"),
        F.when(errors > 5, "red").otherwise("amber").alias("error_level"),
    )


def batch_summary(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Images, total and mean time of a batch."""
    return log.groupBy(*(by or [])).agg(F.count("*").alias("total_images"), F.sum("secs").alias("total_time"), F.avg("secs").alias("avg_time"))


def assemble_report(sections: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """Report text per key from ``sections(ordinal, body)`` in ordinal order; absent sections leave nothing.

    ``slots`` is the number of sections a report can have, so each is one plain aggregate.
    """
    bodies = [F.max(F.when(F.col("ordinal") == n, F.col("body"))) for n in range(slots)]
    return sections.groupBy(*keys).agg(F.concat_ws("\n", *bodies).alias("report"))


def expired_before(files: DataFrame, modified: str, as_of: Column, days: int) -> DataFrame:
    """Files past their retention age."""
    return files.where(F.col(modified) < as_of - F.make_dt_interval(F.lit(days)))


def retained(files: DataFrame, modified: str, as_of: Column, days: int) -> DataFrame:
    return files.where(F.col(modified) >= as_of - F.make_dt_interval(F.lit(days)))
