"""Value-grid statistics, comparison, quality and model-input geometry on long-form cells.

A cell is (scan_id, row_no, col_no, value). Values are two-decimal palette values, so per-scan
aggregates that keep distinct values (median, distinct count) stay within the palette size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustfront.constants import VALUE_RANGE
from gustfront.functions.geo import box_pixels, pixel_col, pixel_row
from gustfront.functions.health import METRIC_LADDERS, metric_verdict, quality_composite, quality_grade
from gustfront.functions.numbers import min_max_scaled, percent
from gustfront.functions.radar import intensity_band, is_severe


def grid_statistics(cells: DataFrame) -> DataFrame:
    """Shape, extremes, mean, exact median, population deviation and non-zero count per scan."""
    return cells.groupBy("scan_id").agg(
        (F.max("row_no") + 1).alias("height"), (F.max("col_no") + 1).alias("width"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.median("value").alias("median"),
        F.stddev_pop("value").alias("std"), F.count_if(F.col("value") != 0).alias("non_zero_count"), F.count("*").alias("total_pixels"),
    )


def compare_grids(left: DataFrame, right: DataFrame) -> DataFrame:
    """Error metrics of two grids per scan; shapes must agree, else ``same_shape`` is false and metrics NULL.

    The correlation of a constant grid is NaN.
    """
    keys = ["scan_id", "row_no", "col_no"]
    both = left.select(*keys, F.col("value").alias("a")).join(right.select(*keys, F.col("value").alias("b")), keys, "full")
    diff = F.abs(F.col("a") - F.col("b"))
    out = both.groupBy("scan_id").agg(
        (F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("same_shape"), F.avg(diff).alias("mae"), F.max(diff).alias("max_error"),
        F.sqrt(F.avg(diff * diff)).alias("rmse"), percent(F.count_if(diff == 0), F.count("*")).alias("exact_matches"), F.coalesce(F.covar_pop("a", "b") / F.nullif(F.stddev_pop("a") * F.stddev_pop("b"), F.lit(0.0)), F.lit(float("nan"))).alias("correlation"),
    )
    metrics = ["mae", "max_error", "rmse", "exact_matches", "correlation"]
    return out.select("scan_id", "same_shape", *[F.when(F.col("same_shape"), F.col(m)).alias(m) for m in metrics])


def value_histogram(cells: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width bins per scan with the last bin closed; empty bins are present with count 0."""
    span = cells.groupBy("scan_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    span = span.select(
        "scan_id", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    edge = lambda i: F.col("lo") + i * width
    guess = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / width)).cast("int")
    placed = cells.join(span, "scan_id").withColumn("bin", guess)
    fixed = F.when(F.col("value") < edge(F.col("bin")), F.col("bin") - 1).when(
        (F.col("bin") < bins - 1) & (F.col("value") >= edge(F.col("bin") + 1)), F.col("bin") + 1
    ).otherwise(F.col("bin"))
    counts = placed.withColumn("bin", fixed).groupBy("scan_id", "bin").agg(F.count("*").alias("n"))
    spine = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = spine.join(counts, ["scan_id", "bin"], "left")
    return full.select("scan_id", "bin", edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("n"))


_FACTS = ("n", "known", "weather", "near", "pairs", "smooth", "triples")


def raster_facts(cells: DataFrame, weather: Column, near: float = 5.0, smooth: float = 3.0) -> DataFrame:
    """Per scan: cells, values, extremes, distinct values, weather cells and small first and second differences along both axes.

    Cells are exchanged once, by scan, and stream through in raster order. Only the last two lines of a scan are held (the halo
    that the next line's differences reach into), beside its distinct values, so memory does not depend on the raster's height.
    Differences exist between cells that are neighbours and both have a value.
    """
    slim = cells.select("scan_id", F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("long").alias("col_no"), F.col("value").cast("double").alias("value"), F.coalesce(weather, F.lit(False)).alias("weather"))
    ordered = slim.repartition("scan_id").sortWithinPartitions("scan_id", "row_no", "col_no")
    kind = dict(cells.dtypes)["scan_id"]
    schema = f"scan_id {kind}, low double, high double, kinds bigint, " + ", ".join(f"{f} bigint" for f in _FACTS)
    types = [pa.float64(), pa.float64(), pa.int64()] + [pa.int64()] * len(_FACTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_scan = OpenScan()
        names = ["scan_id", "low", "high", "kinds", *_FACTS]
        scan_type = None
        for batch in batches:
            if not batch.num_rows:
                continue
            scan_type = batch.column(0).type
            done = open_scan.take(batch, near, smooth)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [scan_type, *types])], names=names)
        done = open_scan.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [scan_type, *types])], names=names)

    return ordered.mapInArrow(run, schema)


class OpenScan:
    """Sums of the scan that is streaming through, and its last two lines."""

    def __init__(self):
        self.sums, self.values, self.low, self.high, self.id = None, set(), None, None, None
        self.lines = None  # rows, columns and values of the halo

    def take(self, batch: pa.RecordBatch, near: float, smooth: float) -> list[tuple]:
        """Add a batch of ordered cells; the facts of the scans that it ends."""
        ids = batch.column(0)
        codes = ids.dictionary_encode(null_encoding="encode")
        scan = codes.indices.to_numpy(zero_copy_only=False)
        change = np.flatnonzero(np.concatenate([[True], scan[1:] != scan[:-1]]))
        ordinal = np.repeat(np.arange(len(change)), np.diff(np.concatenate([change, [len(scan)]])))
        row, col = (batch.column(n).to_numpy(zero_copy_only=False) for n in (1, 2))
        known = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
        value = batch.column(3).fill_null(0.0).to_numpy(zero_copy_only=False)
        firsts = [ids[int(k)].as_py() for k in change]
        same = self.sums is not None and firsts[0] == self.id
        out = [] if same or self.sums is None else self.close()
        count = len(change)
        halo = self.lines if same else None
        if halo is not None:
            row, col, value, known = (np.concatenate([a, b]) for a, b in zip(halo, (row, col, value, known)))
            ordinal = np.concatenate([np.zeros(len(halo[0]), dtype=ordinal.dtype), ordinal])
        old = 0 if halo is None else len(halo[0])
        width, height = int(col.max()) + 3, int(row.max()) + 3
        key = (ordinal * height + row) * width + col

        def before(step: int, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Value of the cell ``step`` places back in raster order, and whether it is there."""
            at = np.minimum(np.searchsorted(key, key - step), len(key) - 1)
            return value[at], (key[at] == key - step) & known[at] & known & edge

        new = np.arange(len(key)) >= old
        per = {f: np.zeros(count, dtype=np.int64) for f in _FACTS}
        for step, place in ((1, col), (width, row)):
            one, has_one = before(step, (place >= 1) & new)
            two, has_two = before(2 * step, (place >= 2) & new)
            has_two &= has_one
            for name, hit in (("pairs", has_one), ("near", has_one & (np.abs(value - one) < near)), ("triples", has_two), ("smooth", has_two & (np.abs(value - 2 * one + two) < smooth))):
                per[name] += np.bincount(ordinal[hit], minlength=count)
        fresh, sound = ordinal[old:], known[old:]
        per["n"] += np.bincount(fresh, minlength=count)
        per["known"] += np.bincount(fresh[sound], minlength=count)
        per["weather"] += np.bincount(fresh[batch.column(4).to_numpy(zero_copy_only=False).astype(bool)], minlength=count)
        own, real = fresh[sound], value[old:][sound]
        cuts = np.searchsorted(own, np.arange(count + 1))
        for k in range(count):
            if k:
                out += self.close()
            if self.sums is None:
                self.sums, self.id = dict.fromkeys(_FACTS, 0), firsts[k]
            for f in _FACTS:
                self.sums[f] += int(per[f][k])
            found = np.unique(real[cuts[k] : cuts[k + 1]])
            if len(found):
                self.values.update(found.tolist())
                self.low = float(found[0]) if self.low is None else min(self.low, float(found[0]))
                self.high = float(found[-1]) if self.high is None else max(self.high, float(found[-1]))
        stay = (ordinal == count - 1) & (row >= row[-1] - 2)
        self.lines = row[stay], col[stay], value[stay], known[stay]
        return out

    def close(self) -> list[tuple]:
        if self.sums is None:
            return []
        facts = (self.id, self.low, self.high, len(self.values), *self.sums.values())
        self.__init__()
        return [facts]


def neighbour_differences(cells: DataFrame, near: float = 5.0, smooth: float = 3.0) -> DataFrame:
    """Spatial consistency (small first differences) and smoothness (small second differences), percent."""
    return raster_facts(cells, F.lit(False), near, smooth).select(
        "scan_id", percent(F.col("near"), F.col("pairs")).alias("spatial_consistency"), percent(F.col("smooth"), F.col("triples")).alias("gradient_quality")
    )


def grid_quality(cells: DataFrame, radar_type: str = "reflectivity") -> DataFrame:
    """Five quality metrics per scan with the weighted score and its grade, from one pass over the raster."""
    low, high = VALUE_RANGE[radar_type]
    weather = F.col("value") > 5.0 if radar_type == "reflectivity" else F.abs("value") > 2.0
    rated = raster_facts(cells, weather).select(
        "scan_id", ((F.col("high") - F.col("low")) / (high - low) * 100).alias("range_coverage"), (F.col("kinds") / F.least(F.lit(1000), F.col("known")) * 100).alias("value_diversity"),
        percent(F.col("weather"), F.col("known")).alias("weather_coverage"), percent(F.col("near"), F.col("pairs")).alias("spatial_consistency"), percent(F.col("smooth"), F.col("triples")).alias("gradient_quality"),
    )
    score = quality_composite(*[F.col(c) for c in ("range_coverage", "spatial_consistency", "value_diversity", "weather_coverage", "gradient_quality")])
    return rated.withColumn("overall_score", score).withColumn("grade", quality_grade(F.col("overall_score")))


def grid_verdicts(quality: DataFrame) -> DataFrame:
    """One row per scan and metric of ``grid_quality``: metric, value and its label."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), metric_verdict(m, F.col(m)).alias("verdict")) for m in METRIC_LADDERS])
    return quality.select("scan_id", F.explode(each).alias("v")).select("scan_id", "v.*")


def severe_count(cells: DataFrame, radar: Column) -> DataFrame:
    return cells.groupBy("scan_id").agg(F.count_if(is_severe(radar, F.col("value"))).alias("severe_cells"))


def band_counts(cells: DataFrame, radar: Column, by: list[str] | None = None) -> DataFrame:
    return cells.groupBy(*(by or []), intensity_band(radar, F.col("value")).alias("band")).agg(F.count("*").alias("n"))


def scaled_cells(cells: DataFrame) -> DataFrame:
    """Values scaled to [0, 1] by their scan's range, with the row-major position of each cell."""
    span = cells.groupBy("scan_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), (F.max("col_no") + 1).alias("w"))
    return cells.join(span, "scan_id").select(
        "scan_id", (F.col("row_no") * F.col("w") + F.col("col_no")).alias("pos"), min_max_scaled(F.col("value"), F.col("lo"), F.col("hi")).alias("value")
    )


# --- model input geometry ------------------------------------------------------------------------


def crop_boxes(georefs: DataFrame, height: int | Column, width: int | Column, box_km: float = 120.0, keep: list[str] | None = None) -> DataFrame:
    """Crop origin, side and in-bounds share per scan from ``georefs(scan_id, a, e, c, f, lat, lon)``."""
    h = F.lit(height) if isinstance(height, int) else height
    w = F.lit(width) if isinstance(width, int) else width
    boxed = georefs.withColumn("npix", box_pixels(F.col("lat"), F.col("a"), box_km)).select(
        "scan_id", *(keep or []), "npix",
        (F.rint(pixel_row(F.col("lat"), F.col("e"), F.col("f"))).cast("int") - F.floor(F.col("npix") / 2).cast("int")).alias("r0"),
        (F.rint(pixel_col(F.col("lon"), F.col("a"), F.col("c"))).cast("int") - F.floor(F.col("npix") / 2).cast("int")).alias("c0"),
        h.alias("_h"), w.alias("_w"),
    )
    rows = F.greatest(F.lit(0), F.least("_h", F.col("r0") + F.col("npix")) - F.greatest(F.lit(0), "r0"))
    cols = F.greatest(F.lit(0), F.least("_w", F.col("c0") + F.col("npix")) - F.greatest(F.lit(0), "c0"))
    return boxed.withColumn("in_bounds", rows * cols / (F.col("npix") * F.col("npix")).cast("double")).drop("_h", "_w")


def crop_cells(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells inside each scan's box, in box coordinates; cells outside the raster stay absent (zero)."""
    row, col = F.col("row_no") - F.col("r0"), F.col("col_no") - F.col("c0")
    inside = cells.join(boxes, "scan_id").where((row >= 0) & (row < F.col("npix")) & (col >= 0) & (col < F.col("npix")))
    return inside.select("scan_id", "npix", row.alias("row_no"), col.alias("col_no"), "value")


def dense_crop(cropped: DataFrame, boxes: DataFrame) -> DataFrame:
    """The crop with zero padding written out."""
    side = F.sequence(F.lit(0), F.col("npix") - 1)
    spine = boxes.select("scan_id", "npix", F.explode(side).alias("row_no")).withColumn("col_no", F.explode(side))
    full = spine.join(cropped.drop("npix"), ["scan_id", "row_no", "col_no"], "left")
    return full.select("scan_id", "row_no", "col_no", F.coalesce("value", F.lit(0.0)).alias("value"))


def resize_weights(sizes: DataFrame, out: int) -> DataFrame:
    """Triangle-filter weights from ``n`` input to ``out`` output positions, one row per non-zero weight.

    When shrinking, the filter widens with the scale, and each output's weights sum to 1.
    """
    scale = F.col("n") / F.lit(float(out))
    support = F.greatest(scale, F.lit(1.0))
    spread = sizes.select(F.col("n")).distinct().withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(out - 1))))
    spread = spread.withColumn("centre", (F.col("o") + 0.5) * scale)
    first = F.greatest(F.lit(0), F.floor(F.col("centre") - support + 0.5)).cast("int")
    last = F.least(F.col("n"), F.floor(F.col("centre") + support + 0.5)).cast("int") - 1
    spread = spread.withColumn("i", F.explode(F.sequence(first, last)))
    weight = F.greatest(F.lit(0.0), 1 - F.abs((F.col("i") + 0.5 - F.col("centre")) / support))
    raw = spread.withColumn("w", weight).where("w > 0")
    total = raw.groupBy("n", "o").agg(F.sum("w").alias("total"))
    return raw.join(total, ["n", "o"]).select("n", "o", "i", (F.col("w") / F.col("total")).alias("w"))


def resize_bilinear(cropped: DataFrame, boxes: DataFrame, out: int) -> DataFrame:
    """Separable resize of a zero-padded crop: columns first, then rows."""
    weights = resize_weights(boxes.select(F.col("npix").alias("n")), out)
    by_col = weights.select(F.col("n").alias("npix"), F.col("i").alias("col_no"), F.col("o").alias("out_col"), F.col("w").alias("wc"))
    wide = cropped.join(by_col, ["npix", "col_no"]).groupBy("scan_id", "npix", "row_no", "out_col").agg(F.sum(F.col("value") * F.col("wc")).alias("value"))
    by_row = weights.select(F.col("n").alias("npix"), F.col("i").alias("row_no"), F.col("o").alias("out_row"), F.col("w").alias("wr"))
    tall = wide.join(by_row, ["npix", "row_no"]).groupBy("scan_id", "out_row", "out_col").agg(F.sum(F.col("value") * F.col("wr")).alias("value"))
    side = F.sequence(F.lit(0), F.lit(out - 1))
    spine = boxes.select("scan_id", F.explode(side).alias("out_row")).withColumn("out_col", F.explode(side))
    full = spine.join(tall, ["scan_id", "out_row", "out_col"], "left")
    return full.select("scan_id", F.col("out_row").alias("row_no"), F.col("out_col").alias("col_no"), F.coalesce("value", F.lit(0.0)).alias("value"))


def preprocess_report(tensors: DataFrame, echoes: DataFrame, boxes: DataFrame) -> DataFrame:
    """Counts of tensors and independent events with echo means and in-bounds shares.

    ``tensors(event_id, label)``; ``echoes(scan_id, value)``. Echo is the mean over scans of each
    scan's mean positive value. Three one-row results are placed side by side as scalars.
    """
    means = echoes.where(F.col("value") > 0).groupBy("scan_id").agg(F.avg("value").alias("m"))
    events = tensors.groupBy("event_id").agg(F.count("*").alias("n"), F.sum("label").alias("pos"), F.max("label").alias("label"))
    total = events.agg(
        F.sum("n").alias("total"), F.sum("pos").alias("positive"), (F.sum("n") - F.sum("pos")).alias("negative"),
        F.count("*").alias("events"), F.sum("label").alias("positive_events"),
    )
    return (
        total.withColumn("echo_mean", means.select(F.avg("m")).scalar())
        .withColumn("echo_scans", means.select(F.count("*")).scalar())
        .withColumn("in_bounds_mean", boxes.select(F.avg("in_bounds")).scalar())
        .withColumn("in_bounds_min", boxes.select(F.min("in_bounds")).scalar())
    )
