"""Queries over rasters: palettes, grids, pixels and model inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustfront.catalog.registry import query, rnd, sql_rnd
from gustfront.constants import REFLECTIVITY_CODES, VELOCITY_CODES
from gustfront.functions import colour, geo, radar
from gustfront.operators import grids, palette, pixels, sampling, tensors

D2 = "(p.r - s.r) * (p.r - s.r) + (p.g - s.g) * (p.g - s.g) + (p.b - s.b) * (p.b - s.b)"
FOUND = f"""found as (select scan_id, row_no, col_no, d2, x, value from (select p.scan_id, p.row_no, p.col_no, {D2} as d2, s.x, s.value,
  row_number() over (partition by p.scan_id, p.row_no, p.col_no order by {D2}, s.x) as n from {{pixels}} p cross join {{palette}} s) t where n = 1)"""


@query("j10_palette_lookup", f"with {FOUND} select scan_id, row_no, col_no, x as palette_x, cast(d2 as bigint) as colour_d2, {sql_rnd('value')} as value from found")
def _(i):
    got = palette.palette_lookup(i.pixels, i.palette)
    return got.select("scan_id", "row_no", "col_no", "palette_x", "colour_d2", rnd("value").alias("value"))


@query("j10_palette_lookup_large_palette", f"with {FOUND} select scan_id, row_no, col_no, x as palette_x, cast(d2 as bigint) as colour_d2, {sql_rnd('value')} as value from found")
def _(i):
    got = palette.palette_lookup(i.pixels, i.palette, by_colour=True)
    return got.select("scan_id", "row_no", "col_no", "palette_x", "colour_d2", rnd("value").alias("value"))


@query("f01_convert_frames", f"with {FOUND} select scan_id, row_no, col_no, round_even(value * 100, 0) / 1e2 as value from found")
def _(i):
    return palette.convert_frames(i.pixels, i.palette)


@query(
    "p11_stride_downsample",
    "select scan_id, cast(row_no / 2 as int) as row_no, cast(col_no / 2 as int) as col_no, r, g, b from {pixels} where row_no % 2 = 0 and col_no % 2 = 0",
)
def _(i):
    return palette.stride_sample(i.pixels, 2)


@query(
    "j11_value_to_colour",
    """with v as (select scan_id, row_no, col_no, least(70e0, greatest(-20e0, value * 3)) as v from {cells})
    select scan_id, row_no, col_no, r, g, b from (select v.*, p.r, p.g, p.b, row_number() over (partition by scan_id, row_no, col_no order by abs(p.value - v.v), p.x) as n
      from v cross join {palette} p) t where n = 1""",
)
def _(i):
    return palette.value_to_colour(i.cells.withColumn("value", F.col("value") * 3), i.palette).select("scan_id", "row_no", "col_no", "r", "g", "b")


@query(
    "a17_palette_build",
    f"""with d as (select max(row_no) + 1 as h, max(col_no) + 1 as w from {{pixels}})
    select p.scan_id, p.col_no as x, p.r, p.g, p.b, {sql_rnd('-20e0 + 90e0 * (p.col_no / cast(d.w as double))')} as value from {{pixels}} p, d where p.row_no = floor(d.h / 2)""",
)
def _(i):
    return palette.build_palette(i.pixels, "reflectivity", extra=["scan_id"]).drop("radar_type").withColumn("value", rnd("value"))


@query(
    "f04_duplicate_palette_colours",
    "select r, g, b, count(*) as entries, min(x) as first_x from (select x, r - r % 64 as r, g - g % 64 as g, b - b % 64 as b from {palette}) t group by 1, 2, 3 having count(*) > 1",
)
def _(i):
    coarse = i.palette.select("x", *[(F.col(c) - F.col(c) % 64).alias(c) for c in "rgb"])
    return palette.duplicate_colours(coarse)


@query(
    "a01_grid_statistics",
    f"""select scan_id, max(row_no) + 1 as height, max(col_no) + 1 as width, {sql_rnd('min(value)')} as min, {sql_rnd('max(value)')} as max, {sql_rnd('avg(value)')} as mean,
    {sql_rnd('median(value)')} as median, {sql_rnd('stddev_pop(value)')} as std, cast(count_if(value <> 0) as bigint) as non_zero_count, count(*) as total_pixels from {{cells}} group by 1""",
)
def _(i):
    s = grids.grid_statistics(i.cells)
    return s.select("scan_id", "height", "width", *[rnd(c).alias(c) for c in ("min", "max", "mean", "median", "std")], "non_zero_count", "total_pixels")


@query(
    "a02_compare_grids",
    f"""with b as (select c.scan_id, c.value as a, case when c.scan_id % 7 = 0 and c.row_no = 7 then null when c.col_no = 3 then c.value else c.value * 0.9e0 + 0.5e0 end as b from {{cells}} c),
    m as (select scan_id, count_if(b is null) = 0 as same_shape, avg(abs(a - b)) as mae, max(abs(a - b)) as max_error, sqrt(avg(abs(a - b) * abs(a - b))) as rmse,
      count_if(abs(a - b) = 0) * 100e0 / count(*) as exact_matches, corr(a, b) as correlation from b group by 1)
    select scan_id, same_shape, case when same_shape then {sql_rnd('mae')} end as mae, case when same_shape then {sql_rnd('max_error')} end as max_error,
      case when same_shape then {sql_rnd('rmse')} end as rmse, case when same_shape then {sql_rnd('exact_matches')} end as exact_matches, case when same_shape then {sql_rnd('correlation')} end as correlation from m""",
)
def _(i):
    other = i.cells.where(~((F.col("scan_id") % 7 == 0) & (F.col("row_no") == 7))).withColumn(
        "value", F.when(F.col("col_no") == 3, F.col("value")).otherwise(F.col("value") * 0.9 + 0.5)
    )
    got = grids.compare_grids(i.cells, other)
    return got.select("scan_id", "same_shape", *[rnd(c).alias(c) for c in ("mae", "max_error", "rmse", "exact_matches", "correlation")])


@query(
    "a03_value_histogram",
    f"""with s as (select scan_id, min(value) as lo, max(value) as hi, (max(value) - min(value)) / 10 as w from {{cells}} group by 1),
    b as (select s.scan_id, s.lo, s.w, x.bin from s, (select unnest(range(0, 10)) as bin) x)
    select b.scan_id, cast(b.bin as int) as bin, {sql_rnd('b.lo + b.bin * b.w')} as bin_start, {sql_rnd('b.lo + (b.bin + 1) * b.w')} as bin_end,
      (select count(*) from {{cells}} c where c.scan_id = b.scan_id and (c.value >= b.lo + b.bin * b.w or b.bin = 0) and (c.value < b.lo + (b.bin + 1) * b.w or b.bin = 9)) as n from b""",
)
def _(i):
    h = grids.value_histogram(i.cells, 10)
    return h.select("scan_id", "bin", rnd("bin_start").alias("bin_start"), rnd("bin_end").alias("bin_end"), "n")


NEIGHBOURS = """d1 as (select a.scan_id, abs(b.value - a.value) as d from {cells} a join {cells} b on a.scan_id = b.scan_id and ((b.row_no = a.row_no and b.col_no = a.col_no + 1) or (b.col_no = a.col_no and b.row_no = a.row_no + 1))),
 d2 as (select a.scan_id, abs(c.value - 2 * b.value + a.value) as d from {cells} a join {cells} b on a.scan_id = b.scan_id and ((b.row_no = a.row_no and b.col_no = a.col_no + 1) or (b.col_no = a.col_no and b.row_no = a.row_no + 1))
   join {cells} c on c.scan_id = a.scan_id and c.row_no = 2 * b.row_no - a.row_no and c.col_no = 2 * b.col_no - a.col_no),
 n1 as (select scan_id, count_if(d < 5) * 100e0 / count(*) as spatial_consistency from d1 group by 1),
 n2 as (select scan_id, count_if(d < 3) * 100e0 / count(*) as gradient_quality from d2 group by 1)"""


@query("w02_w03_neighbour_differences", f"with {NEIGHBOURS} select scan_id, {sql_rnd('spatial_consistency')} as spatial_consistency, {sql_rnd('gradient_quality')} as gradient_quality from n1 join n2 using (scan_id)")
def _(i):
    got = grids.neighbour_differences(i.cells)
    return got.select("scan_id", rnd("spatial_consistency").alias("spatial_consistency"), rnd("gradient_quality").alias("gradient_quality"))


@query(
    "a07_a08_grid_quality",
    f"""with {NEIGHBOURS}, base as (select scan_id, (max(value) - min(value)) / 90e0 * 100 as range_coverage, count(distinct value) / least(1000, count(*)) * 100e0 as value_diversity,
      count_if(value > 5) * 100e0 / count(*) as weather_coverage from {{cells}} group by 1),
    q as (select *, range_coverage * 0.15e0 + spatial_consistency * 0.35e0 + value_diversity * 0.20e0 + least(100, weather_coverage / 0.30e0 * 100) * 0.15e0 + gradient_quality * 0.15e0 as score
      from base join n1 using (scan_id) join n2 using (scan_id))
    select scan_id, {sql_rnd('range_coverage')} as range_coverage, {sql_rnd('value_diversity')} as value_diversity, {sql_rnd('weather_coverage')} as weather_coverage, {sql_rnd('score')} as overall_score,
      case when score >= 80 then 'A - EXCELLENT' when score >= 70 then 'B - GOOD' when score >= 60 then 'C - ACCEPTABLE' else 'D - NEEDS WORK' end as grade from q""",
)
def _(i):
    q = grids.grid_quality(i.cells)
    return q.select("scan_id", *[rnd(c).alias(c) for c in ("range_coverage", "value_diversity", "weather_coverage", "overall_score")], "grade")


@query(
    "a07_metric_verdicts",
    f"""with {NEIGHBOURS}, base as (select scan_id, (max(value) - min(value)) / 90e0 * 100 as range_coverage, count(distinct value) / least(1000, count(*)) * 100e0 as value_diversity,
      count_if(value > 5) * 100e0 / count(*) as weather_coverage from {{cells}} group by 1), q as (select * from base join n1 using (scan_id) join n2 using (scan_id)),
    u as (select scan_id, 'range_coverage' as metric, case when range_coverage > 50 then 'GOOD' else 'LIMITED' end as verdict from q
      union all select scan_id, 'spatial_consistency', case when spatial_consistency > 70 then 'EXCELLENT' when spatial_consistency > 50 then 'GOOD' else 'WEAK' end from q
      union all select scan_id, 'value_diversity', case when value_diversity > 30 then 'EXCELLENT' when value_diversity > 15 then 'GOOD' else 'LIMITED' end from q
      union all select scan_id, 'weather_coverage', case when weather_coverage > 30 then 'SUBSTANTIAL' when weather_coverage > 10 then 'MODERATE' else 'LIGHT' end from q
      union all select scan_id, 'gradient_quality', case when gradient_quality > 70 then 'SMOOTH' when gradient_quality > 50 then 'ACCEPTABLE' else 'NOISY' end from q)
    select * from u""",
)
def _(i):
    return grids.grid_verdicts(grids.grid_quality(i.cells)).select("scan_id", "metric", "verdict")


@query("p10_severe_cells", "select scan_id, cast(case when scan_id % 2 = 0 then count_if(value * 5 > 50) else count_if(abs(value * 5) > 50) end as bigint) as severe_cells from {cells} group by scan_id")
def _(i):
    kind = F.when(F.col("scan_id") % 2 == 0, "reflectivity").otherwise("velocity")
    return grids.severe_count(i.cells.withColumn("value", F.col("value") * 5), kind)


@query(
    "a35_intensity_bands",
    """select kind, case when kind = 'reflectivity' then case when v < 0 then 'low' when v < 40 then 'moderate' else 'high' end
      else case when v < -20 then 'away' when v <= 20 then 'neutral' else 'toward' end end as band, count(*) as n
    from (select case when scan_id % 2 = 0 then 'reflectivity' else 'velocity' end as kind, value * 5 as v from {cells}) t group by 1, 2""",
)
def _(i):
    cells = i.cells.select(F.when(F.col("scan_id") % 2 == 0, "reflectivity").otherwise("velocity").alias("kind"), (F.col("value") * 5).alias("value"))
    return grids.band_counts(cells, F.col("kind"), ["kind"])


@query(
    "h22_scaled_cells",
    f"select c.scan_id, c.row_no * 8 + c.col_no as pos, {sql_rnd('(value - lo) / (hi - lo)')} as value from {{cells}} c join (select scan_id, min(value) as lo, max(value) as hi from {{cells}} group by 1) s on s.scan_id = c.scan_id",
)
def _(i):
    return grids.scaled_cells(i.cells).select("scan_id", "pos", rnd("value").alias("value"))


@query(
    "h21_upscale_nearest",
    "select scan_id, row_no * 2 + y as row_no, col_no * 2 + x as col_no, r from {pixels}, (select unnest([0, 1]) as y) a, (select unnest([0, 1]) as x) b",
)
def _(i):
    return palette.upscale_nearest(i.pixels, 2, ["r"])


# --- model input ---------------------------------------------------------------------------------


@query(
    "h16_index_normalisation",
    f"""select scan_id, row_no, col_no, {sql_rnd('case when refl_idx = 0 then 0 else least(1, greatest(0, refl_idx / 255e0)) end')} as refl,
    {sql_rnd('case when vel_idx in (0, 15) then 0 else least(1, greatest(0, vel_idx / 15e0)) end')} as vel from {{index_cells}}""",
)
def _(i):
    return i.index_cells.select(
        "scan_id", "row_no", "col_no", rnd(radar.normalised_index(F.col("refl_idx"), REFLECTIVITY_CODES)).alias("refl"),
        rnd(radar.normalised_index(F.col("vel_idx"), VELOCITY_CODES)).alias("vel"),
    )


BOX = """g as (select *, abs(a) * 111e0 * cos(radians(lat)) as km, (lat - f) / e as prow, (lon - c) / a as pcol from {georefs}),
 box as (select scan_id, cast(greatest(8, round_even(120e0 / greatest(km, 1e-6), 0)) as int) as npix, prow, pcol, km from g),
 crop as (select scan_id, npix, km, cast(round_even(prow, 0) as int) - npix // 2 as r0, cast(round_even(pcol, 0) as int) - npix // 2 as c0 from box)"""


@query(
    "h17_georeferenced_box",
    f"""with {BOX} select scan_id, npix, r0, c0, {sql_rnd('km')} as km,
    {sql_rnd('greatest(0, least(8, r0 + npix) - greatest(0, r0)) * greatest(0, least(8, c0 + npix) - greatest(0, c0)) / cast(npix * npix as double)')} as in_bounds from crop""",
)
def _(i):
    boxes = grids.crop_boxes(i.georefs, 8, 8, keep=["lat", "a"])
    return boxes.select("scan_id", "npix", "r0", "c0", rnd(geo.km_per_pixel(F.col("lat"), F.col("a"))).alias("km"), rnd("in_bounds").alias("in_bounds"))


SHARE = "case when refl_idx = 0 then 0e0 else refl_idx / 255e0 end"


@query(
    "h18_crop_with_padding",
    f"""with {BOX}, spine as (select scan_id, r0, c0, y.v as row_no, x.v as col_no from crop, (select unnest(range(0, 40)) as v) y, (select unnest(range(0, 40)) as v) x where y.v < npix and x.v < npix)
    select s.scan_id, cast(s.row_no as int) as row_no, cast(s.col_no as int) as col_no, {sql_rnd(f'coalesce({SHARE}, 0e0)')} as value
    from spine s left join {{index_cells}} i on i.scan_id = s.scan_id and i.row_no = s.row_no + s.r0 and i.col_no = s.col_no + s.c0""",
)
def _(i):
    boxes = grids.crop_boxes(i.georefs, 8, 8)
    cells = i.index_cells.withColumn("value", radar.normalised_index(F.col("refl_idx"), REFLECTIVITY_CODES))
    dense = grids.dense_crop(grids.crop_cells(cells, boxes), boxes)
    return dense.select("scan_id", "row_no", "col_no", rnd("value").alias("value"))


def _resized(share: str, name: str) -> str:
    return f"""with {BOX}, n as (select distinct npix as n from crop),
    raw as (select n, o, i, greatest(0e0, 1 - abs((i + 0.5e0 - (o + 0.5e0) * (n / 16e0)) / greatest(1e0, n / 16e0))) as w from n, (select unnest(range(0, 16)) as o) o, (select unnest(range(0, 40)) as i) i where i < n),
    wt as (select n, o, i, w / sum(w) over (partition by n, o) as w from raw),
    src as (select c.scan_id, c.npix, i.row_no - c.r0 as y, i.col_no - c.c0 as x, {share} as v from crop c join {{index_cells}} i on i.scan_id = c.scan_id
      and i.row_no - c.r0 between 0 and npix - 1 and i.col_no - c.c0 between 0 and npix - 1),
    px as (select s.scan_id, r.o as row_no, c.o as col_no, sum(s.v * r.w * c.w) as v from src s join wt r on r.n = s.npix and r.i = s.y and r.w > 0 join wt c on c.n = s.npix and c.i = s.x and c.w > 0 group by 1, 2, 3)
    select k.scan_id, cast(y.v as int) as row_no, cast(x.v as int) as col_no, {sql_rnd('coalesce(px.v, 0e0) + 1.234e-9', 8)} as {name}
    from crop k cross join (select unnest(range(0, 16)) as v) y cross join (select unnest(range(0, 16)) as v) x left join px on px.scan_id = k.scan_id and px.row_no = y.v and px.col_no = x.v"""


@query("h19_bilinear_resize", _resized(SHARE, "value"))
def _(i):
    boxes = grids.crop_boxes(i.georefs, 8, 8)
    cells = i.index_cells.withColumn("value", radar.normalised_index(F.col("refl_idx"), REFLECTIVITY_CODES))
    small = grids.resize_bilinear(grids.crop_cells(cells, boxes), boxes, 16)
    return small.select("scan_id", "row_no", "col_no", rnd(F.col("value") + 1.234e-9, 8).alias("value"))


def index_frames(i):
    """Palette-index rasters as arrays at rest, straight from the embedding arrays."""
    scaled = F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 1e3).cast("int"))
    arrays = i.embeddings.select(
        F.col("vec_id").alias("scan_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform(scaled, lambda v: v % 256).alias("refl"),
        F.when(F.col("vec_id") % 4 != 0, F.transform(scaled, lambda v: v % 16)).alias("vel"),
    )
    return arrays.join(i.georefs, "scan_id")


@query(
    "f02_model_tensors",
    f"""with {BOX} select scan_id, 2 * 16 * 16 as size, scan_id % 4 <> 0 as has_velocity,
    {sql_rnd('greatest(0, least(8, r0 + npix) - greatest(0, r0)) * greatest(0, least(8, c0 + npix) - greatest(0, c0)) / cast(npix * npix as double)')} as in_bounds from crop""",
)
def _(i):
    built = tensors.build_tensors(index_frames(i), out=16)
    return built.select("scan_id", F.size("tensor").alias("size"), "has_velocity", rnd("in_bounds").alias("in_bounds"))


@query("f02_tensor_values", f"with {BOX} select scan_id, 256 + case when scan_id % 4 <> 0 then 256 else 0 end as near_cells from crop")
def _(i):
    # every value of the array form beside the long form, whose values h19_bilinear_resize checks; single precision allows 2e-6
    boxes = grids.crop_boxes(i.georefs, 8, 8)
    built = tensors.build_tensors(index_frames(i), out=16)
    flat = built.select("scan_id", F.posexplode("tensor").alias("at", "t")).select("scan_id", F.floor(F.col("at") / 256).alias("plane"), F.floor(F.col("at") % 256 / 16).cast("int").alias("row_no"), (F.col("at") % 16).cast("int").alias("col_no"), "t")
    every = None
    for plane, (column, codes) in enumerate((("refl_idx", REFLECTIVITY_CODES), ("vel_idx", VELOCITY_CODES))):
        cells = i.index_cells.withColumn("value", radar.normalised_index(F.col(column), codes))
        part = grids.resize_bilinear(grids.crop_cells(cells, boxes), boxes, 16).select("scan_id", F.lit(plane).cast("long").alias("plane"), "row_no", "col_no", "value")
        every = part if every is None else every.unionByName(part)
    both = flat.join(every, ["scan_id", "plane", "row_no", "col_no"]).where("plane = 0 or scan_id % 4 <> 0")
    return both.groupBy("scan_id").agg(F.count_if(F.abs(F.col("t") - F.col("value")) < 2e-6).cast("int").alias("near_cells"))


@query(
    "h20_two_channel_stack",
    f"""select vec_id, len(embedding) * 2 as size, {sql_rnd("list_sum(embedding) + case when vec_id % 3 = 0 then 0 else list_sum(embedding) end", 4)} as total from {{embeddings}}""",
)
def _(i):
    stack = radar.stacked_channels(F.col("embedding"), F.when(F.col("vec_id") % 3 != 0, F.col("embedding")), F.size("embedding"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return i.embeddings.select("vec_id", stack.alias("s")).select("vec_id", F.size("s").alias("size"), rnd(total, 4).alias("total"))


@query(
    "a21_preprocess_report",
    f"""with {BOX}, e as (select subtype || '_' || cast(report_id % 500 as string) as event_id, label from {{tensor_rows}}),
    ev as (select event_id, count(*) as n, sum(label) as pos, max(label) as label from e group by 1),
    m as (select scan_id, avg(value) as m from {{cells}} where value > 0 group by 1),
    ib as (select greatest(0, least(8, r0 + npix) - greatest(0, r0)) * greatest(0, least(8, c0 + npix) - greatest(0, c0)) / cast(npix * npix as double) as v from crop)
    select cast(sum(n) as bigint) as total, cast(sum(pos) as bigint) as positive, cast(sum(n) - sum(pos) as bigint) as negative, count(*) as events, cast(sum(label) as bigint) as positive_events,
      (select {sql_rnd('avg(m)')} from m) as echo_mean, (select count(*) from m) as echo_scans, (select {sql_rnd('avg(v)')} from ib) as in_bounds_mean, (select {sql_rnd('min(v)')} from ib) as in_bounds_min from ev""",
)
def _(i):
    rows = i.tensor_rows.select(F.concat("subtype", F.lit("_"), (F.col("report_id") % 500).cast("string")).alias("event_id"), "label")
    got = grids.preprocess_report(rows, i.cells, grids.crop_boxes(i.georefs, 8, 8))
    return got.select("total", "positive", "negative", "events", "positive_events", "echo_scans", *[rnd(c).alias(c) for c in ("echo_mean", "in_bounds_mean", "in_bounds_min")])


# --- pixels --------------------------------------------------------------------------------------

REBUILT = """rebuilt as (select *, case when (row_no + col_no) % 3 = 0 then r else least(255, r + r * 7 % 19) end as r2, case when col_no % 2 = 0 then g else greatest(0, g - g % 11) end as g2, b as b2 from {pixels}),
 diffs as (select *, abs(r - r2) as dr, abs(g - g2) as dg, abs(b - b2) as db, greatest(abs(r - r2), abs(g - g2), abs(b - b2)) as worst,
   not (r >= 250 and g >= 250 and b >= 245) and not (r <= 40 and g <= 40 and b <= 40) as keep from rebuilt)"""


def rebuilt(i):
    return i.pixels.select(
        "scan_id", "row_no", "col_no", F.when((F.col("row_no") + F.col("col_no")) % 3 == 0, F.col("r")).otherwise(F.least(F.lit(255), F.col("r") + F.col("r") * 7 % 19)).alias("r"),
        F.when(F.col("col_no") % 2 == 0, F.col("g")).otherwise(F.greatest(F.lit(0), F.col("g") - F.col("g") % 11)).alias("g"), "b",
    )


def _within(n: int) -> str:
    return sql_rnd(f"sum((dr <= {n})::int + (dg <= {n})::int + (db <= {n})::int) * 100e0 / (3 * count(*))")


@query(
    "a04_channel_error",
    f"with {REBUILT} select scan_id, {sql_rnd('sum(dr + dg + db) / (3e0 * count(*))')} as mae, max(worst) as max_error, {_within(0)} as exact, {_within(5)} as within_5, {_within(10)} as within_10 from diffs group by 1",
)
def _(i):
    got = pixels.channel_error(i.pixels, rebuilt(i))
    return got.select("scan_id", "max_error", *[rnd(c).alias(c) for c in ("mae", "exact", "within_5", "within_10")])


def _kept(n: int) -> str:
    return f"coalesce(count_if(keep and worst <= {n}) * 100e0 / nullif(count_if(keep), 0), 0)"


MASKED = f"""m as (select scan_id, coalesce(sum(case when keep then dr + dg + db end) / nullif(3e0 * count_if(keep), 0), 0) as mae, coalesce(max(case when keep then worst end), 0) as max_error, count_if(keep) as weather_pixels,
 count(*) - count_if(keep) as ignored_pixels, count_if(keep) * 100e0 / count(*) as weather_percent, {_kept(0)} as exact, {_kept(5)} as within_5, {_kept(10)} as within_10, {_kept(15)} as within_15, {_kept(20)} as within_20 from diffs group by 1)"""


@query(
    "a05_masked_error",
    f"""with {REBUILT}, {MASKED} select scan_id, {sql_rnd('mae')} as mae, max_error, cast(weather_pixels as bigint) as weather_pixels, cast(ignored_pixels as bigint) as ignored_pixels, {sql_rnd('weather_percent')} as weather_percent,
    {sql_rnd('exact')} as exact, {sql_rnd('within_5')} as within_5, {sql_rnd('within_10')} as within_10, {sql_rnd('within_15')} as within_15, {sql_rnd('within_20')} as within_20 from m""",
)
def _(i):
    got = pixels.masked_error(i.pixels, rebuilt(i))
    return got.select("scan_id", "max_error", "weather_pixels", "ignored_pixels", *[rnd(c).alias(c) for c in ("mae", "weather_percent", "exact", "within_5", "within_10", "within_15", "within_20")])


@query(
    "a08_masked_grade",
    f"""with {REBUILT}, {MASKED}, c as (select scan_id, least(100, (within_5 * 0.4e0 + within_10 * 0.3e0 + within_20 * 0.3e0) * (1 + 3 * 0.15e0)) as s from m)
    select scan_id, {sql_rnd('s')} as composite_score, case when s >= 85 then 'A' when s >= 70 then 'B' when s >= 55 then 'C' when s >= 40 then 'D' else 'F' end as grade from c""",
)
def _(i):
    got = pixels.graded_masked_error(pixels.masked_error(i.pixels, rebuilt(i)), sample_rate=4)
    return got.select("scan_id", rnd("composite_score").alias("composite_score"), "grade")


@query(
    "a06_batch_verification",
    f"""with {REBUILT}, e as (select scan_id, sum(dr + dg + db) / (3e0 * count(*)) as mae, sum((dr <= 10)::int + (dg <= 10)::int + (db <= 10)::int) * 100e0 / (3 * count(*)) as w from diffs group by 1)
    select count(*) as scans, {sql_rnd('avg(mae)')} as avg_mae, {sql_rnd('avg(w)')} as avg_within_10,
      case when avg(w) > 95 then 'EXCELLENT' when avg(w) > 85 then 'GOOD' when avg(w) > 70 then 'FAIR' else 'POOR' end as verdict from e""",
)
def _(i):
    from gustfront.functions.health import accuracy_verdict

    got = pixels.batch_averages(pixels.channel_error(i.pixels, rebuilt(i)))
    return got.select("scans", rnd("avg_mae").alias("avg_mae"), rnd("avg_within_10").alias("avg_within_10"), accuracy_verdict(F.col("avg_within_10")).alias("verdict"))


CLASS = """case when r between 200 and 240 and g between 190 and 230 and b between 150 and 200 then 'ground' when r > 240 and g > 240 and b > 240 then 'blank'
 when r < 50 and g < 50 and b < 50 then 'ink' when b > r and b > g and b > 100 then 'class 1' when g > r and g > b and g > 100 then 'class 2'
 when r > 150 and g > 100 and b < 100 then 'class 3' when r > 150 and b > 100 and g < 100 then 'class 4' else 'other' end"""
WORDS = """case when r < 60 and g < 60 and b < 60 then 'near black' when b > r + 30 and b > g + 30 and b > 150 then 'strong blue' when b > r + 30 and b > g + 30 then 'blue'
 when g > r + 20 and g > b + 20 then 'green' when r > 150 and g > 150 and b < 100 then 'yellow' when r > 200 and g < 150 then 'red'
 when r > 150 and g < 150 then 'orange' when r > 100 and b > 100 and g < 100 then 'purple' when abs(r - g) < 20 and abs(g - b) < 20 then 'gray' else 'other' end"""


@query("h14_colour_ladders", f"select scan_id, row_no, col_no, {CLASS} as kind, {WORDS} as words from {{pixels}}")
def _(i):
    c = (F.col("r"), F.col("g"), F.col("b"))
    return i.pixels.select("scan_id", "row_no", "col_no", colour.colour_class(*c).alias("kind"), colour.colour_words(*c).alias("words"))


COARSE = """small as (select scan_id, row_no, col_no, r - r % 16 as r, g - g % 16 as g, b - b % 16 as b from {pixels})"""


def coarse(i):
    """Colours reduced to 16 levels per channel, so that colours repeat within and across scans."""
    return i.pixels.select("scan_id", "row_no", "col_no", *[(F.col(c) - F.col(c) % 16).alias(c) for c in "rgb"])


@query(
    "a09_colour_census",
    f"""with {COARSE}, c as (select r, g, b, count(*) as n from small group by 1, 2, 3), t as (select *, row_number() over (order by n desc, r, g, b) as rank, sum(n) over () as total, count(*) over () as colours from c)
    select r, g, b, n, cast(rank as int) as rank, cast(colours as bigint) as colours, {sql_rnd('n * 100e0 / total')} as share, {CLASS} as kind from t where rank <= 20""",
)
def _(i):
    return pixels.colour_census(coarse(i)).withColumn("share", rnd("share"))


@query(
    "a09_colour_census_per_scan",
    f"""with {COARSE}, c as (select scan_id, r, g, b, count(*) as n from small group by 1, 2, 3, 4), t as (select *, row_number() over (partition by scan_id order by n desc, r, g, b) as rank, sum(n) over (partition by scan_id) as total from c)
    select scan_id, cast(rank as int) as rank, r, g, b, n, {sql_rnd('n * 100e0 / total')} as share from t where rank <= 20""",
)
def _(i):
    return pixels.colour_census(coarse(i), ["scan_id"]).select("scan_id", "rank", "r", "g", "b", "n", rnd("share").alias("share"))


@query(
    "a12_background_suggestion",
    f"""with {COARSE}, m as (select *, (row_no + col_no) % 3 as ground from small),
    c as (select case when ground = 1 then 176 else r end as r, case when ground = 1 then 160 else g end as g, case when ground = 1 then 192 else b end as b, count(*) as n from m where ground <> 2 or r > 96 group by 1, 2, 3),
    t as (select *, row_number() over (order by n desc, r, g, b) as rank, sum(n) over () as total from c)
    select r, g, b, n, {sql_rnd('n * 100e0 / total')} as share from t where rank <= 20 and r > 100 and r < 250 and g > 100 and g < 250 and b > 100 and b < 250 order by rank limit 1""",
)
def _(i):
    # a third of every scan is one map colour
    ground = (F.col("row_no") + F.col("col_no")) % 3
    drawn = coarse(i).where((ground != 2) | (F.col("r") > 96))
    mapped = drawn.select("scan_id", *[F.when(ground == 1, v).otherwise(F.col(c)).alias(c) for c, v in (("r", 176), ("g", 160), ("b", 192))])
    return pixels.background_suggestion(mapped).withColumn("share", rnd("share"))


def _breakdown(ground: str) -> str:
    return f"""with c as (select scan_id % 50 as part, count(*) as total, count_if({ground}) as background, count_if(r > 240 and g > 240 and b > 240) as white, count_if(r < 50 and g < 50 and b < 50) as dark from {{pixels}} group by 1),
    w as (select *, total - background - white - dark as weather from c)
    select part, total, cast(background as bigint) as background, cast(white as bigint) as white, cast(dark as bigint) as dark, cast(weather as bigint) as weather, {sql_rnd('weather * 100e0 / total')} as weather_percent,
      case when weather * 100e0 / total >= 50 then 'HIGH' when weather * 100e0 / total >= 30 then 'MODERATE' else 'LOW' end as verdict from w"""


@query("a10_pixel_breakdown", _breakdown("r > 200 and g > 190 and b > 150 and not (r > 240 and g > 240 and b > 240)"))
def _(i):
    return pixels.pixel_breakdown(i.pixels.withColumn("part", F.col("scan_id") % 50), ["part"]).withColumn("weather_percent", rnd("weather_percent"))


@query("a10_pixel_breakdown_overlapping", _breakdown("r > 200 and g > 190 and b > 150"))
def _(i):
    parts = i.pixels.withColumn("part", F.col("scan_id") % 50)
    return pixels.pixel_breakdown(parts, ["part"], overlapping=True).withColumn("weather_percent", rnd("weather_percent"))


@query(
    "a11_palette_match_rate",
    f"""with c as (select distinct scan_id % 20 as part, r, g, b from {{pixels}} where not (abs(r - 247) < 30 and abs(g - 246) < 30 and abs(b - 213) < 30) and not (r > 245 and g > 245 and b > 245) and not (r < 50 and g < 50 and b < 50)),
    k as (select * from (select *, row_number() over (partition by part order by r, g, b) as n from c) t where n <= 100),
    d as (select k.part, k.r, k.g, k.b, min(sqrt({D2.replace('p.', 'k.')})) as d from k cross join {{palette}} s group by 1, 2, 3, 4)
    select part, count(*) as checked, cast(count_if(d < 20) as bigint) as matched, {sql_rnd('count_if(d < 20) * 100e0 / count(*)')} as match_rate,
      case when count_if(d < 20) * 100e0 / count(*) > 80 then 'GOOD' when count_if(d < 20) * 100e0 / count(*) > 60 then 'MODERATE' else 'POOR' end as verdict from d group by 1""",
)
def _(i):
    parts = i.pixels.withColumn("part", F.col("scan_id") % 20)
    return pixels.palette_match_rate(parts, i.palette, ["part"]).withColumn("match_rate", rnd("match_rate"))


@query(
    "a11_unmatched_colours",
    f"""with c as (select distinct scan_id % 20 as part, r, g, b from {{pixels}} where not (abs(r - 247) < 30 and abs(g - 246) < 30 and abs(b - 213) < 30) and not (r > 245 and g > 245 and b > 245) and not (r < 50 and g < 50 and b < 50)),
    k as (select * from (select *, row_number() over (partition by part order by r, g, b) as n from c) t where n <= 100),
    d as (select k.part, k.r, k.g, k.b, min(sqrt({D2.replace('p.', 'k.')})) as d from k cross join {{palette}} s group by 1, 2, 3, 4)
    select part, r, g, b, {sql_rnd('d')} as distance from (select *, row_number() over (partition by part order by r, g, b) as n from d where d >= 20) t where n <= 10""",
)
def _(i):
    parts = i.pixels.withColumn("part", F.col("scan_id") % 20)
    return pixels.unmatched_colours(parts, i.palette, ["part"]).select("part", "r", "g", "b", rnd("distance").alias("distance"))


@query(
    "a13_mask_coverage",
    f"""with m as (select scan_id % 50 as part, count(*) as total, count_if(not (abs(r - 220) <= 35 and abs(g - 210) <= 35 and abs(b - 175) <= 35) and not (r >= 245 and g >= 245 and b >= 245) and not (r <= 60 and g <= 60 and b <= 60)) as included from {{pixels}} group by 1)
    select part, total, cast(included as bigint) as included, {sql_rnd('included * 100e0 / total')} as included_percent,
      case when included * 100e0 / total < 20 then 'too strict' when included * 100e0 / total > 80 then 'too loose' else 'reasonable' end as feedback from m""",
)
def _(i):
    parts = i.pixels.withColumn("part", F.col("scan_id") % 50)
    return pixels.mask_coverage(parts, ["part"], tolerance=35, dark=60).withColumn("included_percent", rnd("included_percent"))


WIDE = """wide as (select scan_id % 20 as scan_id, cast(floor(scan_id / 20) % 200 as int) as row_no, row_no * 16 + col_no as col_no, r, g, b from {pixels})"""


def wide(i):
    """Pixels gathered into 20 tall frames, so that rows and regions hold many pixels."""
    return i.pixels.select((F.col("scan_id") % 20).alias("scan_id"), (F.floor(F.col("scan_id") / 20) % 200).cast("int").alias("row_no"), (F.col("row_no") * 16 + F.col("col_no")).alias("col_no"), "r", "g", "b")


@query(
    "a14_scale_bar_row",
    f"""with {WIDE}, ch as (select scan_id, row_no, col_no, unnest([r, g, b]) as v from wide), s as (select scan_id, max(row_no) + 1 as h, max(col_no) + 1 as w from wide group by 1),
    rv as (select scan_id, row_no, var_pop(v) as v from ch group by 1, 2),
    b as (select rv.*, s.w, row_number() over (partition by rv.scan_id order by round(rv.v, 6) desc, rv.row_no) as n from rv join s on s.scan_id = rv.scan_id where rv.row_no >= s.h - 150)
    select scan_id, row_no as best_row, {sql_rnd('v', 4)} as variance, greatest(0, row_no - 40) as y_top, row_no as y_bottom, least(400, w) as x_right from b where n = 1""",
)
def _(i):
    return pixels.scale_bar_row(wide(i)).withColumn("variance", rnd("variance", 4))


@query(
    "a15_region_profile",
    f"""with {WIDE}, c as (select scan_id, row_no - 10 as y, col_no - 5 as x, r, g, b, (r + g + b) / 3e0 as l from wide where col_no between 5 and 64 and row_no between 10 and 49),
    p as (select scan_id, count(distinct {{{{'r': r, 'g': g, 'b': b}}}}) as colours, avg(case when y = 0 then l end) as t, avg(case when x < 20 then l end) as le, avg(case when x >= 40 then l end) as ri from c group by 1)
    select scan_id, colours, {sql_rnd('t')} as top_mean, {sql_rnd('le')} as left_mean, {sql_rnd('ri')} as right_mean, case when colours < 300 then 'few colours' when colours > 800 then 'good variety' else '' end as variety,
      coalesce(t < 100, false) as dark_top, coalesce(le > ri + 50, false) as missing_right from p""".replace("{{", "{").replace("}}", "}"),
)
def _(i):
    got = pixels.region_profile(wide(i), 5, 10, 60, 40)
    return got.select("scan_id", "colours", "variety", "dark_top", "missing_right", *[rnd(c).alias(c) for c in ("top_mean", "left_mean", "right_mean")])


@query(
    "a15_gradient_samples",
    f"with {WIDE}, c as (select distinct scan_id, col_no - 5 as position, r, g, b from wide where row_no = 30 and col_no - 5 in (0, 10, 20, 30, 40, 50, 59)) select scan_id, position, r, g, b, {WORDS} as words from c",
)
def _(i):
    return pixels.gradient_samples(wide(i), 5, 10, 60, 40).distinct()


@query(
    "a16_scale_match",
    f"""with {COARSE}, o as (select distinct r, g, b from small where scan_id % 3 <> 0), e as (select distinct r, g, b from small where scan_id % 3 = 0), m as (select * from o intersect select * from e)
    select (select count(*) from o) as original_colours, (select count(*) from e) as extracted_colours, (select count(*) from m) as matching,
      {sql_rnd('(select count(*) from m) * 100e0 / (select count(*) from o)')} as match_rate, (select count(*) from m) * 100e0 / (select count(*) from o) < 50 as low_match""",
)
def _(i):
    got = sampling.scale_match(coarse(i).where("scan_id % 3 <> 0"), coarse(i).where("scan_id % 3 = 0"))
    return got.withColumn("match_rate", rnd("match_rate"))


@query(
    "u02_colour_set_overlap",
    """with p as (select distinct r, g, b from {pixels}), s as (select distinct r, g, b from (select * from {palette} union all select 0, r, g, b, 0 from {pixels} where scan_id % 2 = 0) t)
    select *, 'matching' as found from (select * from p intersect select * from s) union all select *, 'frame_only' from (select * from p except select * from s)
    union all select *, 'scale_only' from (select * from s except select * from p)""",
)
def _(i):
    scale = i.palette.select("r", "g", "b").unionByName(i.pixels.where("scan_id % 2 = 0").select("r", "g", "b"))
    return sampling.colour_overlap(i.pixels, scale)


@query(
    "h15_weather_mask",
    f"with {REBUILT} select scan_id, row_no, col_no, keep from diffs",
)
def _(i):
    return i.pixels.select("scan_id", "row_no", "col_no", colour.weather_mask(F.col("r"), F.col("g"), F.col("b")).alias("keep"))


@query(
    "h24_difference_map",
    f"with {REBUILT} select scan_id, row_no, col_no, case when keep then least(255, dr * 10) else 128 end as shown_r, least(255, dg * 10) as plain_g from diffs",
)
def _(i):
    other = rebuilt(i).select("scan_id", "row_no", "col_no", F.col("r").alias("r2"), F.col("g").alias("g2"))
    joined = i.pixels.join(other, ["scan_id", "row_no", "col_no"])
    keep = colour.weather_mask(F.col("r"), F.col("g"), F.col("b"))
    return joined.select(
        "scan_id", "row_no", "col_no", colour.difference_map(F.abs(F.col("r") - F.col("r2")), keep).alias("shown_r"), colour.difference_map(F.abs(F.col("g") - F.col("g2"))).alias("plain_g")
    )
