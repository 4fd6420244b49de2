"""Colour-scale build and nearest-colour lookups without pairwise joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustfront.constants import VALUE_RANGE
from gustfront.functions.numbers import round_even
from gustfront.operators.timeline import neighbours
from gustfront.session import deal_out, materialise

CUBE = 16
_PLACE_BITS = 31
#: Lists of candidates up to this length are compared entry by entry in compiled code.
SHORT_LIST = 8


def build_palette(scale: DataFrame, radar_type: str, by: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """Colours of the middle row of a scale picture with values linear in x.

    ``x / width`` never reaches 1, so the top of the range is never produced.
    """
    by = by or []
    low, high = VALUE_RANGE[radar_type]
    height, width = (F.max("row_no") + 1).alias("h"), (F.max("col_no") + 1).alias("w")
    if by:
        joined = scale.join(scale.groupBy(*by).agg(height, width), by)
    else:
        joined = scale.withColumn("h", scale.select(height).scalar()).withColumn("w", scale.select(width).scalar())
    middle = joined.where(F.col("row_no") == F.floor(F.col("h") / 2))
    return middle.select(
        *by, *(extra or []), F.lit(radar_type).alias("radar_type"), F.col("col_no").alias("x"), "r", "g", "b",
        (F.lit(low) + F.lit(high - low) * (F.col("col_no") / F.col("w"))).alias("value"),
    )


def duplicate_colours(palette: DataFrame) -> DataFrame:
    """Colours that stand for several positions: the later ones can never be found."""
    return palette.groupBy("r", "g", "b").agg(F.count("*").alias("entries"), F.min("x").alias("first_x")).where("entries > 1")


def _cube(channel: Column) -> Column:
    return F.shiftright(channel, CUBE.bit_length() - 1)


def _cube_id(r: Column, g: Column, b: Column) -> Column:
    side = 256 // CUBE
    return (_cube(r) * side + _cube(g)) * side + _cube(b)


def _can_be_nearest(entries: DataFrame, side: int) -> DataFrame:
    """Cut each cube (corner ``lr, lg, lb``) into cubes of ``side``, four per axis, and keep per cube
    the entries that are somewhere in it no farther than the entry nearest to its middle.

    The difference of two squared distances is linear in the colour, so its least value in the cube is exact.
    """
    part = F.col("part")
    cut = entries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(63))))
    cut = cut.withColumn("lr", F.col("lr") + F.shiftright(part, 4) * side).withColumn("lg", F.col("lg") + F.shiftright(part, 2) % 4 * side).withColumn("lb", F.col("lb") + part % 4 * side)
    twice = {c: 2 * F.col(f"l{c}") + (side - 1) for c in "rgb"}  # the middle, doubled to stay whole
    from_middle = sum(((2 * F.col(c) - twice[c]) * (2 * F.col(c) - twice[c]) for c in "rgb"), F.lit(0))
    best = F.min_by(F.struct("r", "g", "b"), from_middle).over(Window.partitionBy("lr", "lg", "lb"))
    farther = F.lit(0)
    for c in "rgb":
        step = F.col(c) - F.col(f"best.{c}")
        farther = farther + step * (F.col(c) + F.col(f"best.{c}") - twice[c]) - F.abs(step) * (side - 1)
    return cut.withColumn("best", best).where(farther <= 0).drop("part", "best")


def cube_candidates(palette: DataFrame) -> DataFrame:
    """For each of 4096 colour cubes, the palette entries that can be nearest to some colour inside it.

    Two rounds of cutting (64 cubes, then 64 in each) keep the work far below palette times cubes;
    what a large cube rules out is ruled out for its parts.
    """
    first = palette.groupBy("r", "g", "b").agg(F.min("x").alias("x"), F.min_by("value", "x").alias("value"))
    whole = first.withColumn("lr", F.lit(0)).withColumn("lg", F.lit(0)).withColumn("lb", F.lit(0))
    kept = _can_be_nearest(_can_be_nearest(whole, 4 * CUBE), CUBE)
    return kept.select(_cube_id(F.col("lr"), F.col("lg"), F.col("lb")).alias("cube"), "x", "r", "g", "b", "value")


def _squared(entry, r: Column, g: Column, b: Column) -> Column:
    dr, dg, db = entry["r"] - r, entry["g"] - g, entry["b"] - b
    return (dr * dr + dg * dg + db * db).cast("long")


def palette_lookup(pixels: DataFrame, palette: DataFrame, by_colour: bool = False) -> DataFrame:
    """Add ``value``, ``palette_x`` and ``colour_d2`` of the nearest palette colour to every pixel.

    The candidates of each cube are one array, joined on the cube without a hint: while statistics say
    the table is small the engine broadcasts it and pixels are only mapped. The palette is stored first, so its
    size is known before the pixels' exchange by cube could begin. ``by_colour`` reduces
    pixels to distinct colours (at most 2**24) first and joins the answers back, for frames drawn in
    few colours. Equal distances go to the smallest x.
    """
    if not by_colour:
        candidates = cube_candidates(materialise(palette.select("x", "r", "g", "b", "value"), "palette"))
        table = candidates.groupBy("cube").agg(F.array_sort(F.collect_list(F.struct("x", "r", "g", "b", "value"))).alias("near"))
        found = pixels.withColumn("cube", _cube_id(F.col("r"), F.col("g"), F.col("b"))).join(table, "cube")
        # squared distance and place in the x-ordered list share one integer; a function over an array is interpreted
        # for each entry, so short lists are spelled out (what lies past their end is NULL, which least passes over)
        code = lambda p, n: _squared(p, F.col("r"), F.col("g"), F.col("b")) * (1 << _PLACE_BITS) + n
        short = F.least(*[code(F.get("near", F.lit(n)), n) for n in range(SHORT_LIST)])
        found = found.withColumn("code", F.when(F.size("near") <= SHORT_LIST, short).otherwise(F.array_min(F.transform("near", code))))
        best = F.get("near", (F.col("code") % (1 << _PLACE_BITS)).cast("int"))
        found = found.withColumn("best", best)
        return found.select(*pixels.columns, F.col("best.value").alias("value"), F.col("best.x").alias("palette_x"), F.shiftright("code", _PLACE_BITS).alias("colour_d2"))
    return pixels.join(nearest_colours(pixels.select("r", "g", "b").distinct(), palette), ["r", "g", "b"]).select(
        *pixels.columns, "value", "palette_x", "colour_d2"
    )


def nearest_colours(colours: DataFrame, palette: DataFrame) -> DataFrame:
    """Nearest palette entry of each distinct colour, by equality join on the colour cube."""
    candidates = cube_candidates(palette).select("cube", "x", "value", *[F.col(c).alias(f"p_{c}") for c in "rgb"])
    joined = colours.withColumn("cube", _cube_id(F.col("r"), F.col("g"), F.col("b"))).join(candidates, "cube")
    d2 = F.lit(0)
    for c in "rgb":
        d2 = d2 + (F.col(c) - F.col(f"p_{c}")) * (F.col(c) - F.col(f"p_{c}"))
    best = joined.groupBy("r", "g", "b").agg(F.min(F.struct(d2.cast("long").alias("d2"), "x", "value")).alias("best"))
    return best.select("r", "g", "b", "best.value", F.col("best.x").alias("palette_x"), F.col("best.d2").alias("colour_d2"))


def value_to_colour(cells: DataFrame, palette: DataFrame, radar_type: str = "reflectivity", bins: int = 1024, by_value: bool = False) -> DataFrame:
    """Add the colour whose scale value is closest to the (clamped) cell value; first x wins ties.

    Every palette value owns the stretch up to the middle between it and its neighbours, found by
    range-partitioned order, and is listed only for the bins that its stretch touches: the table has about as
    many rows as palette values and bins together. Cells meet it on the bin without a hint.
    ``by_value`` reduces cells to distinct values first and joins the answers back.
    """
    low, high = VALUE_RANGE[radar_type]
    width = (high - low) / bins
    clamped = F.least(F.lit(high), F.greatest(F.lit(low), F.col("value")))
    bin_of = lambda v: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((v - low) / width))).cast("int")
    first = palette.groupBy("value").agg(F.min_by(F.struct("x", "r", "g", "b"), "x").alias("p")).select("value", "p.*")
    sided = neighbours(first, "value")
    # one bin more on either side absorbs rounding of the middles
    start = F.coalesce(bin_of((F.col("before") + F.col("value")) / 2) - 1, F.lit(0))
    end = F.coalesce(bin_of((F.col("after") + F.col("value")) / 2) + 1, F.lit(bins - 1))
    kept = sided.withColumn("slot", F.explode(F.sequence(F.greatest(start, F.lit(0)), F.least(end, F.lit(bins - 1))))).drop("before", "after")
    if by_value:
        keyed = cells.withColumn("_v", clamped)
        values = keyed.select(F.col("_v"), bin_of(clamped).alias("slot")).distinct().join(kept.withColumnRenamed("value", "p_value"), "slot")
        nearest = values.groupBy("_v").agg(F.min(F.struct(F.abs(F.col("p_value") - F.col("_v")).alias("d"), "x", "r", "g", "b")).alias("best"))
        return keyed.join(nearest, "_v").select(*cells.columns, "best.r", "best.g", "best.b")
    table = kept.groupBy("slot").agg(F.collect_list(F.struct("value", "x", "r", "g", "b")).alias("entries"))
    best = F.array_min(
        F.transform("entries", lambda p: F.struct(F.abs(p["value"] - clamped).alias("d"), p["x"].alias("x"), p["r"].alias("r"), p["g"].alias("g"), p["b"].alias("b")))
    )
    shaped = deal_out(cells).withColumn("slot", bin_of(clamped)).join(table, "slot")
    return shaped.withColumn("best", best).select(*cells.columns, "best.r", "best.g", "best.b")


def stride_sample(frames: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th row and column, renumbered densely."""
    if step <= 1:
        return frames
    kept = frames.where((F.col("row_no") % step == 0) & (F.col("col_no") % step == 0))
    return kept.withColumn("row_no", F.floor(F.col("row_no") / step).cast("int")).withColumn("col_no", F.floor(F.col("col_no") / step).cast("int"))


def convert_frames(pixels: DataFrame, palette: DataFrame, sample_rate: int = 1, few_colours: bool = False) -> DataFrame:
    """Pixels to grid cells: stride first, then lookup, values to two decimals."""
    found = palette_lookup(stride_sample(pixels, sample_rate), palette, by_colour=few_colours)
    return found.select("scan_id", "row_no", "col_no", round_even(F.col("value"), 2).alias("value"))


def upscale_nearest(cells: DataFrame, factor: int, values: list[str]) -> DataFrame:
    """Repeat each cell ``factor`` times both ways."""
    grown = cells.withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    return grown.select(
        "scan_id", (F.col("row_no") * factor + F.col("dy")).alias("row_no"), (F.col("col_no") * factor + F.col("dx")).alias("col_no"), *values
    )
