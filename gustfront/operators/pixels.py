"""Reconstruction error, colour census, masks and scale-region profiles on RGB pixels.

A pixel is (scan_id, row_no, col_no, r, g, b). Channel sums are integers, so no explode is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustfront.functions.colour import colour_class, colour_words, is_dark, is_white, tunable_mask, weather_mask
from gustfront.functions.health import ladder, masked_composite, masked_grade
from gustfront.functions.numbers import percent
from gustfront.operators.palette import nearest_colours
from gustfront.session import materialise

_KEYS = ["scan_id", "row_no", "col_no"]


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def _diffs(original: DataFrame, rebuilt: DataFrame) -> tuple[DataFrame, list[Column]]:
    other = rebuilt.select(*_KEYS, *[F.col(c).alias(f"{c}2") for c in "rgb"])
    return original.join(other, _KEYS), [F.abs(F.col(c) - F.col(f"{c}2")) for c in "rgb"]


def channel_error(original: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Error over channels per scan: mean, max, exact share and shares within 5 and 10."""
    joined, diffs = _diffs(original, rebuilt)
    n = F.count("*") * 3
    total = lambda test: F.sum(reduce(lambda a, b: a + b, [test(d).cast("long") for d in diffs]))
    return joined.groupBy("scan_id").agg(
        (F.sum(reduce(lambda a, b: a + b, diffs)) / n).alias("mae"), F.max(F.greatest(*diffs)).alias("max_error"),
        percent(total(lambda d: d == 0), n).alias("exact"), percent(total(lambda d: d <= 5), n).alias("within_5"), percent(total(lambda d: d <= 10), n).alias("within_10"),
    )


def masked_error(original: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Error over weather pixels by their worst channel; all zero where the mask is empty."""
    joined, diffs = _diffs(original, rebuilt)
    keep, worst = weather_mask(*_rgb()), F.greatest(*diffs)
    count = F.count_if(keep)
    share = lambda test: F.coalesce(percent(F.count_if(keep & test), count), F.lit(0.0))
    return joined.groupBy("scan_id").agg(
        F.coalesce(F.sum(F.when(keep, reduce(lambda a, b: a + b, diffs))) / F.nullif(count * 3, F.lit(0)), F.lit(0.0)).alias("mae"),
        F.coalesce(F.max(F.when(keep, worst)), F.lit(0)).alias("max_error"),
        count.alias("weather_pixels"), (F.count("*") - count).alias("ignored_pixels"), percent(count, F.count("*")).alias("weather_percent"),
        share(worst == 0).alias("exact"), *[share(worst <= n).alias(f"within_{n}") for n in (5, 10, 15, 20)],
    )


def graded_masked_error(metrics: DataFrame, sample_rate: int = 1) -> DataFrame:
    score = masked_composite(F.col("within_5"), F.col("within_10"), F.col("within_20"), sample_rate)
    return metrics.withColumn("composite_score", score).withColumn("grade", masked_grade(F.col("composite_score")))


def batch_averages(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("scans"), F.avg("mae").alias("avg_mae"), F.avg("within_10").alias("avg_within_10"))


def _counted(pixels: DataFrame, by: list[str]) -> DataFrame:
    return pixels.groupBy(*by, "r", "g", "b").agg(F.count("*").alias("n"))


def _top_colours(pixels: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` most frequent colours with their share; equal counts go by colour."""
    counts = _counted(pixels, by)
    order = [F.desc("n"), "r", "g", "b"]
    if by:
        totals = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.count("*").alias("colours"))
        ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        return ranked.join(totals, by)
    return _heavy_colours(pixels, k)


#: Colours that a task reports in the first pass.
REPORTED, MOST_REPORTED = 4096, 65_536


def _heavy_colours(pixels: DataFrame, k: int) -> DataFrame:
    """The exact top of all colours in two passes, without exchanging every colour's count.

    In the first pass each task counts its colours and reports only its most frequent ones and the count of the first that
    it left out. A colour's count lies between the sum of its reports and that sum plus what tasks that did not report it may
    have left out. Those that can reach the top are counted exactly in the second pass. If too many could, tasks report more.
    Distinct colours are counted with bitmaps, 4 kB for every 32,768 colours.
    """
    packed = pixels.where("r is not null and g is not null and b is not null").select((F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("long").alias("c"))
    sums = packed.groupBy(F.bitmap_bucket_number("c").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits"), F.count(F.lit(1)).alias("n"))
    whole = sums.agg(F.sum(F.bitmap_count("bits")).alias("colours"), F.sum("n").alias("total")).first()
    most = REPORTED
    while True:
        bounds = _bounded(packed, most)
        floor = bounds.orderBy(F.desc("low")).limit(k).agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("n")).first()
        least = floor["low"] if floor["n"] == k else 0
        chosen = [r["c"] for r in bounds.where(F.col("high") >= F.lit(least)).select("c").limit(most + 1).collect()]
        unseen = bounds.agg(F.max("left_out").alias("x")).first()["x"] or 0  # what a colour that nobody reported may have
        if len(chosen) <= most and unseen < max(1, least):
            break
        most *= 4
        if most > MOST_REPORTED:  # counts so even that nearly every colour can reach the top
            chosen = None
            break
    exact = _counted(pixels.where("r is not null and g is not null and b is not null" if chosen is None else (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("long").isin(chosen)), [])
    order = [F.desc("n"), "r", "g", "b"]
    top = exact.orderBy(*order).limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.withColumn("total", F.lit(whole["total"]).cast("long")).withColumn("colours", F.lit(whole["colours"]).cast("long"))


def _bounded(packed: DataFrame, most: int) -> DataFrame:
    """(c, low, high, left_out) of every reported colour: bounds of its count, and what all tasks together may have left out of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        colours, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:  # at most all 2**24 colours
            c, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
            both, place = np.unique(np.concatenate([colours, c]), return_inverse=True)
            colours, counts = both, np.bincount(place, np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
        best = np.argsort(-counts, kind="stable")[: most + 1]
        rest = int(counts[best[most]]) if len(best) > most else 0
        best = best[:most]
        # the row of colour -1 tells what this task left out
        yield pa.RecordBatch.from_pydict({"c": pa.array(np.append(colours[best], -1), pa.int64()), "n": pa.array(np.append(counts[best], 0), pa.int64()), "rest": pa.array(np.full(len(best) + 1, rest), pa.int64())})

    reports = packed.mapInArrow(run, "c long, n long, rest long").groupBy("c").agg(F.sum("n").alias("low"), F.sum("rest").alias("own"))
    reports = materialise(reports, "colour-bounds")
    left_out = F.coalesce(reports.where("c = -1").select("own").scalar(), F.lit(0))
    return reports.where("c >= 0").select("c", "low", (F.col("low") + left_out - F.col("own")).alias("high"), left_out.alias("left_out"))


def colour_census(pixels: DataFrame, by: list[str] | None = None, k: int = 20) -> DataFrame:
    """Top colours with share and likely meaning, beside the number of distinct colours."""
    top = _top_colours(pixels, by or [], k)
    return top.withColumn("share", percent(F.col("n"), F.col("total"))).withColumn("kind", colour_class(*_rgb())).drop("total")


def background_suggestion(pixels: DataFrame, by: list[str] | None = None, k: int = 20) -> DataFrame:
    """Most frequent mid-range colour among the top ``k``: the likely map background."""
    by = by or []
    r, g, b = _rgb()
    middle = reduce(lambda x, y: x & y, [(c > 100) & (c < 250) for c in (r, g, b)])
    top = _top_colours(pixels, by, k).where(middle)
    best = top.groupBy(*by).agg(F.min_by(F.struct("r", "g", "b", "n", "total"), "rank").alias("c"))
    return best.where("c is not null").select(*by, "c.r", "c.g", "c.b", "c.n", percent(F.col("c.n"), F.col("c.total")).alias("share"))


def pixel_breakdown(pixels: DataFrame, by: list[str] | None = None, overlapping: bool = False) -> DataFrame:
    """Counts of background, white, dark and weather pixels with a verdict on the weather share.

    Classes are exclusive (white, dark, then background) unless ``overlapping``, where a white pixel
    also counts as background and the weather count can fall short.
    """
    r, g, b = _rgb()
    white, dark, ground = is_white(r, g, b), is_dark(r, g, b), (r > 200) & (g > 190) & (b > 150)
    if not overlapping:
        ground = ground & ~white
    counts = pixels.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), F.count_if(ground).alias("background"), F.count_if(white).alias("white"), F.count_if(dark).alias("dark")
    )
    weather = F.col("total") - F.col("background") - F.col("white") - F.col("dark")
    rated = counts.withColumn("weather", weather).withColumn("weather_percent", percent(F.col("weather"), F.col("total")))
    return rated.withColumn("verdict", ladder(F.col("weather_percent"), [(50, "HIGH"), (30, "MODERATE")], "LOW"))


def _weather_colours(pixels: DataFrame, by: list[str], first: int) -> DataFrame:
    """The first weather-like colours in colour order."""
    r, g, b = _rgb()
    ground = (F.abs(r - 247) < 30) & (F.abs(g - 246) < 30) & (F.abs(b - 213) < 30)
    colours = pixels.select(*by, "r", "g", "b").where(~ground & ~is_white(r, g, b, 245) & ~is_dark(r, g, b)).distinct()
    if by:
        return colours.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("r", "g", "b"))).where(F.col("_n") <= first).drop("_n")
    return colours.orderBy("r", "g", "b").limit(first)


def palette_match_rate(pixels: DataFrame, palette: DataFrame, by: list[str] | None = None, first: int = 100, within: float = 20.0) -> DataFrame:
    """Share of the first 100 weather-like colours (in colour order) that lie near the palette."""
    by = by or []
    chosen = _weather_colours(pixels, by, first)
    near = nearest_colours(chosen.select("r", "g", "b").distinct(), palette)
    rated = chosen.join(near, ["r", "g", "b"]).groupBy(*by).agg(
        F.count("*").alias("checked"), F.count_if(F.sqrt("colour_d2") < within).alias("matched")
    )
    rate = percent(F.col("matched"), F.col("checked"))
    return rated.withColumn("match_rate", rate).withColumn("verdict", ladder(rate, [(80, "GOOD"), (60, "MODERATE")], "POOR", strict=True))


def unmatched_colours(pixels: DataFrame, palette: DataFrame, by: list[str] | None = None, first: int = 100, within: float = 20.0, show: int = 10) -> DataFrame:
    """The first ten of those colours that lie far from the palette, with the closest entry and its distance."""
    by = by or []
    chosen = _weather_colours(pixels, by, first)
    near = nearest_colours(chosen.select("r", "g", "b").distinct(), palette).where(F.sqrt("colour_d2") >= within)
    far = chosen.join(near, ["r", "g", "b"]).select(*by, "r", "g", "b", "palette_x", F.sqrt("colour_d2").alias("distance"))
    # at most ``first`` rows per group, and ``first`` in all without one
    return far.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("r", "g", "b"))).where(F.col("_n") <= show).drop("_n")


def mask_coverage(pixels: DataFrame, by: list[str] | None = None, tolerance: int = 25, dark: int = 50, white: int = 245) -> DataFrame:
    """Share of pixels a tuned mask keeps, with feedback on too strict or too loose settings."""
    kept = F.count_if(tunable_mask(*_rgb(), tolerance, dark, white))
    cover = pixels.groupBy(*(by or [])).agg(F.count("*").alias("total"), kept.alias("included"))
    cover = cover.withColumn("included_percent", percent(F.col("included"), F.col("total")))
    share = F.col("included_percent")
    return cover.withColumn("feedback", F.when(share < 20, "too strict").when(share > 80, "too loose").otherwise("reasonable"))


def scale_bar_row(pixels: DataFrame, bottom: int = 150, bar: int = 40, max_width: int = 400) -> DataFrame:
    """Row of highest colour variance near the bottom of each frame, and the region around it.

    Variance is taken over all channel values of a row from integer sums; the first maximum wins.
    """
    r, g, b = _rgb()
    rows = pixels.groupBy("scan_id", "row_no").agg(
        (F.count("*") * 3).alias("n"), F.sum(r + g + b).alias("s"), F.sum(r * r + g * g + b * b).alias("q"), (F.max("col_no") + 1).alias("w")
    )
    size = rows.groupBy("scan_id").agg((F.max("row_no") + 1).alias("height"), F.max("w").alias("width"))
    low = rows.join(size, "scan_id").where(F.col("row_no") >= F.col("height") - bottom)
    variance = (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * F.col("n"))
    best = low.withColumn("v", variance).groupBy("scan_id").agg(
        F.min(F.struct((-F.col("v")).alias("nv"), "row_no", "height", "width")).alias("m")
    )
    return best.select(
        "scan_id", F.col("m.row_no").alias("best_row"), (-F.col("m.nv")).alias("variance"),
        F.greatest(F.lit(0), F.col("m.row_no") - bar).alias("y_top"), F.col("m.row_no").alias("y_bottom"), F.least(F.lit(max_width), F.col("m.width")).alias("x_right"),
    )


def _in_region(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    inside = pixels.where(F.col("col_no").between(x, x + width - 1) & F.col("row_no").between(y, y + height - 1))
    return inside.withColumn("col_no", F.col("col_no") - x).withColumn("row_no", F.col("row_no") - y)


def region_profile(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """Distinct colours and brightness hints of one cropped region per scan."""
    box = _in_region(pixels, x, y, width, height)
    bright = (F.col("r") + F.col("g") + F.col("b")) / F.lit(3.0)
    part = lambda test: F.avg(F.when(test, bright))
    facts = box.groupBy("scan_id").agg(
        F.count_distinct("r", "g", "b").alias("colours"), part(F.col("row_no") == 0).alias("top_mean"),
        part(F.col("col_no") < 20).alias("left_mean"), part(F.col("col_no") >= width - 20).alias("right_mean"),
    )
    hint = F.when(F.col("colours") < 300, "few colours").when(F.col("colours") > 800, "good variety").otherwise("")
    return facts.select(
        "*", hint.alias("variety"), F.coalesce(F.col("top_mean") < 100, F.lit(False)).alias("dark_top"),
        F.coalesce(F.col("left_mean") > F.col("right_mean") + 50, F.lit(False)).alias("missing_right"),
    )


def gradient_samples(pixels: DataFrame, x: int, y: int, width: int, height: int, parts: int = 6) -> DataFrame:
    """Colours at evenly spaced positions of the region's middle row, with their description."""
    spots = sorted({width * i // parts for i in range(parts)} | {width - 1})
    row = _in_region(pixels, x, y, width, height).where((F.col("row_no") == height // 2) & F.col("col_no").isin(spots))
    return row.select("scan_id", F.col("col_no").alias("position"), "r", "g", "b", colour_words(*_rgb()).alias("words"))
