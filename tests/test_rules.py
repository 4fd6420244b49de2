"""Tie, boundary and rounding rules on small hand-made inputs, and brute-force properties."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gustfront import session
from gustfront.constants import REFLECTIVITY_CODES
from gustfront.functions import health, numbers, radar, text
from gustfront.functions.geo import haversine_km
from gustfront.operators import evaluation, grids, lookups, merkle, pairing, palette, pixels, proximity, sampling, suppression, tensors, timeline

T0 = datetime(2024, 5, 1, 12, 0)


def at(minutes=0.0):
    return T0 + timedelta(minutes=minutes)


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- scalars ---


@pytest.mark.parametrize("value,digits", [(6.55, 1), (0.125, 2), (2.675, 2), (11.5, 0), (12.5, 0), (-3.25, 1), (99.995, 2), (1e6 + 0.5, 0), (0.0, 1), (43.79, 1)])
def test_fixed_text_rounds_the_binary_value(spark, value, digits):
    assert one(spark, numbers.fixed_text(F.lit(value), digits)) == f"{value:.{digits}f}"


def test_fixed_text_on_random_values(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.uniform(1, 2000), rng.randrange(10, 99999) / 100, rng.randrange(8, 9999) / 8]) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[numbers.fixed_text(F.col("v"), d).alias(f"t{d}") for d in (0, 1, 2)]).collect()
    for r in rows:
        assert (r.t0, r.t1, r.t2) == (f"{r.v:.0f}", f"{r.v:.1f}", f"{r.v:.2f}")


def test_fixed_text_below_one(spark):
    steps = spark.range(-10_000, 10_001).select((F.col("id") / 10_000).alias("v"))
    rng = random.Random(4)
    more = [k / 2**e for e in (1, 3, 9, 14, 30, 60) for k in (1, 3, 5)] + [rng.random() * 10.0 ** -rng.randrange(8) for _ in range(2000)] + [0.00005, 0.00015, 5e-5 - 1e-20, 1e15 + 0.5, 2.0**60]
    rows = steps.union(spark.createDataFrame([(v,) for v in more], "v double")).select("v", *[numbers.fixed_text(F.col("v"), d).alias(f"t{d}") for d in range(5)]).collect()
    for r in rows:
        assert [r[f"t{d}"] for d in range(5)] == [f"{r.v:.{d}f}" for d in range(5)], r.v


def test_magnitude_truncates_toward_zero(spark):
    rows = spark.createDataFrame([("1.9",), ("-1.9",), ("",), (None,), ("EF2",)], "m string").select(numbers.truncated_magnitude(F.col("m")).alias("x")).collect()
    assert [r.x for r in rows] == [1, -1, -9, -9, None]


def test_event_code_fallbacks(spark):
    events = ["Tornado Warning", "Dust Storm Advisory For Everyone Here", "  ", "high Surf Advisory"]
    rows = spark.createDataFrame([(e,) for e in events], "e string").select(text.event_code(F.col("e")).alias("x")).collect()
    assert [r.x for r in rows] == ["TO.W", "DSAF", "ALRT", "HSA"]


def test_model_state_bounds(spark):
    rows = spark.createDataFrame(
        [(0.8, "running", 1800), (0.7999, "running", 0), (0.9, "running", 1801), (0.9, "stale", 5), (None, "running", 5), (0.9, "error", 5), (0.9, None, 5), (0.9, "running", None)],
        "s double, st string, a long",
    ).select(text.model_state(F.col("s"), F.col("st"), F.col("a"), 0.8).alias("x"), text.shown_score(F.col("s"), F.col("st")).alias("shown")).collect()
    assert [r.x for r in rows] == ["elevated", "not elevated"] + ["unavailable"] * 6
    assert [r.shown for r in rows] == [0.8, 0.7999, 0.9, 0.9, None, None, None, 0.9]


def test_wind_and_pressure_lines_skip_zero(spark):
    assert one(spark, text.wind_line(F.lit(10.0), F.lit(0.0))) == "Wind: 6.2 mph"
    assert one(spark, text.wind_line(F.lit(10.0), F.lit(270.0))) == "Wind: 6.2 mph from 270°"
    assert one(spark, text.pressure_line(F.lit(0.0))) is None
    assert one(spark, text.temperature_text(F.lit(None).cast("double"))) == "N/A"


def test_report_sections(spark):
    none = F.lit(None).cast("double")
    got = one(spark, text.current_section(F.lit("2024-05-01 18:05:00").cast("timestamp"), F.lit("x/KDFW"), F.lit(20.0), none, F.lit(50.0), none, none, F.lit("Clear"), none, none, "TOWN"))
    assert got.split("\n") == ["=" * 60, "CURRENT WEATHER — TOWN", "=" * 60, "Observation: 2024-05-01 06:05 PM UTC", "Station: KDFW", "Temperature: 68.0°F (20.0°C)", "Dewpoint: N/A", "Humidity: 50%", "Conditions: Clear", "=" * 60]
    period = F.struct(F.lit("Tonight").alias("name"), F.lit(60).alias("temperature"), F.lit("F").alias("temperatureUnit"), F.lit("5 mph").alias("windSpeed"), F.lit("S").alias("windDirection"), F.lit("Clear").alias("shortForecast"))
    out = one(spark, text.forecast_section(F.array(*[period] * 7), "TOWN"))
    assert out.count("Tonight:") == 5 and "  Temp: 60°F\n  Wind: 5 mph S\n  Clear" in out
    assert one(spark, text.alert_lines(F.lit("Flood Warning"), F.lit("Severe"), F.lit("Now"))) == "\n\U0001f6a8 Flood Warning (Severe)\n   Now"


def test_daylight_saving(spark):
    stamps = ["2024-03-10 07:59:59", "2024-03-10 08:00:00", "2024-11-03 06:59:59", "2024-11-03 07:00:00"]
    rows = spark.createDataFrame([(s,) for s in stamps], "s string").select(text.central_text(F.col("s").cast("timestamp")).alias("x")).collect()
    assert [r.x for r in rows] == ["2024-03-10 01:59:59 CST", "2024-03-10 03:00:00 CDT", "2024-11-03 01:59:59 CDT", "2024-11-03 01:00:00 CST"]


def test_accuracy_verdict_is_strict(spark):
    assert [one(spark, health.accuracy_verdict(F.lit(v))) for v in (95.0, 95.1, 85.0, 70.0)] == ["GOOD", "EXCELLENT", "FAIR", "POOR"]


# --- joins ---


@pytest.mark.parametrize("row_by_row", [False, True])
def test_nearest_station_brute_force_and_ties(spark, row_by_row):
    rng = random.Random(1)
    sites = [(f"S{n:03d}", rng.uniform(-80, 80), rng.uniform(-180, 180)) for n in range(300)] + [("ZTIE", 10.0, 20.0), ("ATIE", 10.0, 20.0)]
    events = [(n, rng.uniform(-80, 80), rng.uniform(-180, 180)) for n in range(600)] + [(900, 10.1, 20.1), (901, 70.0, 179.9), (902, 70.0, -179.9)]
    sites += [("DATE", 70.0, -179.95)]
    got = proximity.nearest_station(spark.createDataFrame(events, "report_id long, lat double, lon double"), spark.createDataFrame(sites, "station string, lat double, lon double"), 800.0, row_by_row=row_by_row)
    found = {r.report_id: (r.station, round(r.dist_km, 6)) for r in got.collect()}
    want = {}
    for n, lat, lon in events:
        d, s = min((km(lat, lon, a, b), s) for s, a, b in sites)
        if d <= 800:
            want[n] = (s, round(d, 6))
    assert found == want and found[900][0] == "ATIE" and found[901][0] == found[902][0] == "DATE"


@pytest.mark.parametrize("row_by_row", [False, True])
def test_dense_sites_meet_few_events_each(spark, row_by_row):
    rng = random.Random(2)
    sites = [(f"S{n:04d}", rng.uniform(30, 33), rng.uniform(-1, 2)) for n in range(400)] + [(f"T{n:04d}", 31.2 + rng.random() / 5, 0.1 + rng.random() / 5) for n in range(100)]
    sites += [("ZTIE", 31.0, 0.5), ("ATIE", 31.0, 0.5)]
    events = [(n, rng.uniform(28, 35), rng.uniform(-3, 4)) for n in range(1000)] + [(n, 31.2 + rng.random() / 4, 0.1 + rng.random() / 4) for n in range(1000, 1300)] + [(2000, 31.0, 0.5)]
    events_df = spark.createDataFrame(events, "report_id long, lat double, lon double")
    sites_df = spark.createDataFrame(sites, "station string, lat double, lon double")
    tree, depth, crowded = proximity._site_tree(sites_df, 150.0)
    assert depth > 1 and not crowded
    assert tree.groupBy("level", "cell_y", "cell_x").count().agg(F.max("count")).first()[0] <= proximity.CROWDED
    found = {r.report_id: (r.station, round(r.dist_km, 6)) for r in proximity.nearest_station(events_df, sites_df, row_by_row=row_by_row).collect()}
    want = {}
    for n, lat, lon in events:
        d, s = min((km(lat, lon, a, b), s) for s, a, b in sites)
        if d <= 150:
            want[n] = (s, round(d, 6))
    assert found == want and found[2000][0] == "ATIE"


def test_sites_too_close_for_cells(spark, monkeypatch):
    monkeypatch.setattr(proximity, "DEEPEST", 2)
    sites = [(f"S{n:02d}", 35.0 + n * 1e-6, -97.0) for n in range(40)]
    got = proximity.nearest_station(spark.createDataFrame([(1, 35.1, -97.0), (2, 34.9, -97.0)], "report_id long, lat double, lon double"), spark.createDataFrame(sites, "station string, lat double, lon double"))
    assert {r.report_id: r.station for r in got.collect()} == {1: "S39", 2: "S00"}


def test_exclusion_bounds_are_inclusive(spark):
    warn = [(1, at(), 35.0, -97.0), (2, at(), 40.0, -97.0), (3, at(), 35.0, -90.0)]
    torn = [(at(45), 35.0, -97.0), (at(45.01), 40.0, -97.0), (at(), 35.0, -90.0 + math.degrees(30.01 / 6371 / math.cos(math.radians(35))))]
    got = proximity.exclude_near(spark.createDataFrame(warn, "id int, event_ts timestamp, lat double, lon double"), spark.createDataFrame(torn, "event_ts timestamp, lat double, lon double"))
    assert sorted(r.id for r in got.collect()) == [2, 3]


def test_exclusion_brute_force(spark):
    rng = random.Random(5)
    place = lambda: (at(rng.randrange(-3000, 3000)), rng.uniform(34, 36), rng.uniform(-98, -96))
    warn, torn = [(n, *place()) for n in range(400)], [place() for _ in range(150)]
    got = proximity.exclude_near(spark.createDataFrame(warn, "id int, event_ts timestamp, lat double, lon double"), spark.createDataFrame(torn, "event_ts timestamp, lat double, lon double"))
    want = [n for n, t, a, b in warn if not any(abs((t - u).total_seconds()) <= 2700 and km(a, b, c, d) <= 30 for u, c, d in torn)]
    assert sorted(r.id for r in got.collect()) == want and 0 < len(want) < 400


def test_closest_scans_window_and_order(spark):
    ev = spark.createDataFrame([(1, "K1", at())], "report_id int, station string, event_ts timestamp")
    scans = spark.createDataFrame([("K1", n, at(m)) for n, m in enumerate((-30.0, -30.02, 10.0, 10.02, -5.0, 5.0, -1.0, 2.0))], "station string, scan_id int, scan_ts timestamp")
    assert sorted(r.scan_id for r in pairing.closest_scans(ev, scans, 9).collect()) == [0, 2, 4, 5, 6, 7]
    # -5 and +5 tie: the earlier one is kept
    assert sorted(r.scan_id for r in pairing.closest_scans(ev, scans, 3).collect()) == [4, 6, 7]


def test_shared_event_id_keeps_first_report_with_scans(spark):
    ev = spark.createDataFrame([(1, "K9", "x", at()), (2, "K1", "x", at()), (3, "K1", "x", at())], "report_id int, station string, event_id string, event_ts timestamp")
    scans = spark.createDataFrame([("K1", 7, at(1)), ("K1", 8, at(2))], "station string, scan_id int, scan_ts timestamp")
    got = pairing.closest_scans(ev, scans, 5, identity="event_id").collect()
    assert sorted((r.report_id, r.scan_id) for r in got) == [(2, 7), (2, 8)]


def test_nearest_pairing_brute_force(spark):
    rng = random.Random(8)
    left = [(n, f"K{n % 3}", at(n * 3.7)) for n in range(200)]
    right = sorted({(f"K{rng.randrange(3)}", at(rng.randrange(0, 800))) for _ in range(150)})
    cand = [(n, s, t) for n, (s, t) in enumerate(right)]
    got = pairing.pair_velocity(spark.createDataFrame(left, "scan_id long, station string, scan_ts timestamp"), spark.createDataFrame(cand, "scan_id long, station string, scan_ts timestamp"))
    for r in got.collect():
        near = sorted((abs((t - r.scan_ts).total_seconds()), t, n) for n, s, t in cand if s == r.station and abs((t - r.scan_ts).total_seconds()) <= 480)
        assert r.pair_id == (near[0][2] if near else None)
        assert r.pair_ts == (near[0][1] if near else None)


def test_last_known_across_slots(spark):
    facts = spark.createDataFrame([(1, at(0), 0.1), (2, at(200), 0.2), (3, at(200), 0.3)], "id int, ts timestamp, v double")
    asks = spark.createDataFrame([(at(-1),), (at(0),), (at(199),), (at(200),), (at(9000),)], "t timestamp")
    got = {r.t: r.fact.v if r.fact else None for r in pairing.last_known(asks, facts, "t", "ts", "id").collect()}
    assert [got[at(m)] for m in (-1, 0, 199, 200, 9000)] == [None, 0.1, 0.1, 0.3, 0.3]


def test_reconcile_actions(spark):
    rows = spark.createDataFrame([(t, "K1") for t in "abcde"] + [("f", "K2")], "tensor string, station string")
    stored = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("b", True), ("c", False), ("d", False), ("f", True)], "tensor string, loadable boolean")
    listed = spark.createDataFrame([("a",), ("d",), ("f",)], "tensor string")
    got = {r.tensor: r.action for r in lookups.reconcile(rows, stored, listed, spark.createDataFrame([("K1",)], "station string")).collect()}
    assert got == {"a": "reused", "b": "healed_orphan", "c": "healed_corrupt", "d": "healed_corrupt", "e": "new", "f": "skipped_no_georef"}


# --- palette ---


@pytest.mark.parametrize("by_colour", [False, True])
def test_palette_lookup_brute_force(spark, by_colour):
    rng = np.random.default_rng(4)
    scale = rng.integers(0, 256, (60, 3))
    scale[40] = scale[7]
    px = rng.integers(0, 256, (800, 3))
    px[0] = scale[7]
    pal = spark.createDataFrame([(n, *map(int, c), float(n)) for n, c in enumerate(scale)], "x int, r int, g int, b int, value double")
    pix = spark.createDataFrame([(n, *map(int, c)) for n, c in enumerate(px)], "id int, r int, g int, b int")
    got = {r.id: r.palette_x for r in palette.palette_lookup(pix, pal, by_colour).collect()}
    d2 = ((px[:, None, :] - scale[None, :, :]) ** 2).sum(axis=2)
    assert got == {n: int(x) for n, x in enumerate(d2.argmin(axis=1))} and got[0] == 7


@pytest.mark.parametrize("by_value", [False, True])
def test_value_to_colour_brute_force(spark, by_value):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.uniform(-60, 110, 500), [-20.0, 70.0, 25.0]])
    pal = [(x, x, 0, 255 - x, -20 + 90 * (x / 200)) for x in range(200)]
    got = palette.value_to_colour(spark.createDataFrame([(n, float(v)) for n, v in enumerate(values)], "id int, value double"), spark.createDataFrame(pal, "x int, r int, g int, b int, value double"), by_value=by_value)
    scale = np.array([p[4] for p in pal])
    for r in got.collect():
        assert r.r == int(np.abs(scale - min(70, max(-20, values[r.id]))).argmin())


def test_palette_lookup_of_crowded_cubes(spark):
    """Lists of candidates on both sides of the length up to which they are spelled out, with repeated colours and ties."""
    rng = random.Random(7)
    crowd = [(rng.randrange(64, 96), rng.randrange(64, 80), rng.randrange(64, 80)) for _ in range(60)]
    colours = crowd + crowd[:9] + [(rng.randrange(256), rng.randrange(256), rng.randrange(256)) for _ in range(25)] + [(None, 70, 70)]
    pal = spark.createDataFrame([(x, *c, x / 4) for x, c in enumerate(colours)], "x int, r int, g int, b int, value double")
    asked = [(n, *(rng.randrange(60, 100) if n % 2 else rng.randrange(256) for _ in range(3))) for n in range(1500)]
    got = {r.id: (r.palette_x, r.colour_d2, r.value) for r in palette.palette_lookup(spark.createDataFrame(asked, "id int, r int, g int, b int"), pal).collect()}
    sizes = [r["count"] for r in palette.cube_candidates(pal).groupBy("cube").count().collect()]
    assert len(sizes) == 4096 and min(sizes) <= palette.SHORT_LIST < max(sizes)
    for n, *c in asked:
        d2, x = min((sum((p - q) ** 2 for p, q in zip(c, known)), x) for x, known in enumerate(colours) if None not in known)
        assert got[n] == (x, d2, x / 4)


def test_few_palette_entries_are_left_in_a_cube(spark):
    """Entries that another one beats all over a cube are not compared there."""
    pal = spark.range(350).selectExpr("cast(id as int) x", "cast(id * 37 % 256 as int) r", "cast(id * 91 % 256 as int) g", "cast(id * 151 % 256 as int) b", "id / 4d value")
    assert palette.cube_candidates(pal).count() < 5 * 4096


def test_palette_never_reaches_top(spark):
    scale = spark.createDataFrame([(y, x, x, y, 0) for y in range(3) for x in range(10)], "row_no int, col_no int, r int, g int, b int")
    got = sorted(palette.build_palette(scale, "velocity").collect(), key=lambda r: r.x)
    assert [r.g for r in got] == [1] * 10 and got[0].value == -100 and got[-1].value == pytest.approx(80)


# --- grids ---


def cells_of(spark, arrays):
    rows = [(n, y, x, float(v)) for n, a in enumerate(arrays) for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "scan_id int, row_no int, col_no int, value double")


def test_grid_measures_against_arrays(spark):
    rng = np.random.default_rng(9)
    arrays = [np.round(rng.normal(10, 6, (7, 9)), 2), np.full((4, 4), 3.0), np.round(rng.uniform(-20, 70, (5, 3)), 2)]
    c = cells_of(spark, arrays)
    stats = {r.scan_id: r for r in grids.grid_statistics(c).collect()}
    diffs = {r.scan_id: r for r in grids.neighbour_differences(c).collect()}
    hist = {}
    for r in grids.value_histogram(c, 7).collect():
        hist.setdefault(r.scan_id, {})[r.bin] = r.n
    for n, a in enumerate(arrays):
        s = stats[n]
        assert (s.height, s.width) == a.shape and s.std == pytest.approx(a.std()) and s.median == pytest.approx(np.median(a)) and s.mean == pytest.approx(a.mean())
        h, v = np.abs(np.diff(a, axis=1)), np.abs(np.diff(a, axis=0))
        assert diffs[n].spatial_consistency == pytest.approx(((h < 5).sum() + (v < 5).sum()) / (h.size + v.size) * 100)
        h2, v2 = np.abs(np.diff(a, 2, axis=1)), np.abs(np.diff(a, 2, axis=0))
        assert diffs[n].gradient_quality == pytest.approx(((h2 < 3).sum() + (v2 < 3).sum()) / (h2.size + v2.size) * 100)
        assert [hist[n][b] for b in range(7)] == np.histogram(a, bins=7)[0].tolist()


def test_shape_mismatch_is_reported(spark):
    a, b = cells_of(spark, [np.ones((2, 2)), np.ones((2, 2))]), cells_of(spark, [np.ones((2, 3)), np.full((2, 2), 1.5)])
    got = {r.scan_id: r for r in grids.compare_grids(a, b).collect()}
    assert not got[0].same_shape and got[0].mae is None and got[1].same_shape and got[1].mae == 0.5


def test_array_and_long_form_tensors_agree(spark):
    rng = np.random.default_rng(6)
    frames, idx = [], []
    for n in range(6):
        raster = rng.integers(0, 256, (20, 24))
        frames.append((n, 20, 24, raster.ravel().tolist(), None if n == 0 else (raster % 16).ravel().tolist(), 0.05 + n * 0.02, -0.06, -98.0, 33.0, 32.6, -97.5))
        idx += [(n, y, x, int(v)) for (y, x), v in np.ndenumerate(raster)]
    df = spark.createDataFrame(frames, "scan_id int, height int, width int, refl array<int>, vel array<int>, a double, e double, c double, f double, lat double, lon double")
    built = {r.scan_id: r for r in tensors.build_tensors(df, out=32).collect()}
    boxes = grids.crop_boxes(df, 20, 24)
    long = spark.createDataFrame(idx, "scan_id int, row_no int, col_no int, i int").withColumn("value", radar.normalised_index(F.col("i"), REFLECTIVITY_CODES))
    small = grids.resize_bilinear(grids.crop_cells(long, boxes), boxes, 32)
    for r in small.collect():
        assert built[r.scan_id].tensor[r.row_no * 32 + r.col_no] == pytest.approx(r.value, abs=2e-6)
    assert not built[0].has_velocity and max(built[0].tensor[1024:]) == 0.0


def test_resize_weights(spark):
    assert np.allclose(tensors.weight_matrix(4, 4), np.eye(4))
    got = {(r.o, r.i): r.w for r in grids.resize_weights(spark.createDataFrame([(10,)], "n int"), 4).collect()}
    want = tensors.weight_matrix(10, 4)
    assert all(got.get((o, i), 0.0) == pytest.approx(want[o, i]) for o in range(4) for i in range(10))


def test_masked_error_with_empty_mask(spark):
    px = spark.createDataFrame([(1, 0, 0, 255, 255, 255), (2, 0, 0, 100, 100, 100)], "scan_id int, row_no int, col_no int, r int, g int, b int")
    got = {r.scan_id: r for r in pixels.masked_error(px, px.withColumn("g", F.col("g") - 15)).collect()}
    assert got[1].weather_pixels == 0 and got[1].mae == 0 and got[1].within_20 == 0
    assert got[2].mae == 5 and got[2].within_10 == 0 and got[2].within_15 == 100


# --- evaluation ---


def test_average_precision_against_loop(spark):
    rng = random.Random(7)
    rows = [(rng.random() < 0.3, round(rng.random(), rng.choice([1, 2, 6]))) for _ in range(2000)]
    df = spark.createDataFrame([(int(y), s) for y, s in rows], "label int, score double")
    got = evaluation.ranking_metrics(df).first()
    p, n = sum(y for y, _ in rows), sum(not y for y, _ in rows)
    ap = tp = fp = 0
    for s in sorted({s for _, s in rows}, reverse=True):
        hit = sum(y for y, v in rows if v == s)
        tp, fp = tp + hit, fp + sum(not y for y, v in rows if v == s)
        ap += hit / p * tp / (tp + fp)
    wins = sum((a > b) + 0.5 * (a == b) for y, a in rows if y for z, b in rows if not z)
    assert got.average_precision == pytest.approx(ap, abs=1e-12) and got.roc_auc == pytest.approx(wins / (p * n), abs=1e-12)


def test_one_class_gives_nan(spark):
    got = evaluation.ranking_metrics(spark.createDataFrame([(1, 0.5), (1, 0.6)], "label int, score double")).first()
    assert math.isnan(got.average_precision) and math.isnan(got.roc_auc) and got.base_rate == 1


def test_split_keeps_groups_together(spark):
    rows = [(f"2024-01-{d:02d}", f"K{s}", int(rng % 5 == 0)) for rng, (d, s) in enumerate((d, s) for d in range(1, 29) for s in range(10) for _ in range(3))]
    got = evaluation.split_by_group(spark.createDataFrame(rows, "date string, station string, label int")).collect()
    where = {}
    for r in got:
        where.setdefault((r.date, r.station), set()).add(r.split)
    assert len(got) == len(rows) and all(len(s) == 1 for s in where.values())
    positive = {k for k in where if any(r.label for r in got if (r.date, r.station) == k)}
    for groups in (positive, set(where) - positive):
        count = lambda name: sum(where[k] == {name} for k in groups)
        assert count("test") == count("val") == int(len(groups) * 0.15)


def test_fingerprints(spark):
    import hashlib

    ids = [f"tensors/{n}.npy" for n in range(50)]
    df = spark.createDataFrame([(i,) for i in ids], "tensor string")
    assert merkle.exact_fingerprint(df, "tensor", parts=1).first().fingerprint == hashlib.sha256("".join(sorted(ids)).encode()).hexdigest()[:16]
    whole = merkle.exact_fingerprint(df, "tensor").first()
    assert whole.n == 50 and whole == merkle.exact_fingerprint(df.repartition(7), "tensor").first()
    for other in (df.where("tensor <> 'tensors/7.npy'"), df.union(df.limit(1)), df.union(spark.createDataFrame([(None,)], "tensor string"))):
        assert merkle.exact_fingerprint(other, "tensor").first().fingerprint != whole.fingerprint
    a, b = evaluation.fingerprint(df, "tensor").first(), evaluation.fingerprint(df.orderBy(F.desc("tensor")).repartition(5), "tensor").first()
    assert a == b and a != evaluation.fingerprint(df.where("tensor <> 'tensors/7.npy'"), "tensor").first()


# --- order-dependent ---


def test_global_rank_with_one_hot_key(spark):
    rows = [(1 if n % 3 else n, n) for n in range(3000)]
    got = timeline.global_rank(spark.createDataFrame(rows, "k int, id int").repartition(7), ["k", "id"]).collect()
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows) and sorted(r["rank"] for r in got) == list(range(3000))


def test_stride_sample_matches_slicing(spark):
    for n, cap in ((100, 7), (10, 20), (23, 23), (1000, 33), (5, 0)):
        df = spark.range(n).withColumnRenamed("id", "k")
        want = list(range(n))[:: max(1, n // cap)][:cap] if cap else list(range(n))
        assert sorted(r.k for r in sampling.stride_cap(df, cap, ["k"], "k").collect()) == want


def test_recent_sends_cutoff_is_inclusive(spark):
    ledger = spark.createDataFrame([("t", at(0), "sent"), ("t", at(10), "suppressed_daily_cap"), ("u", at(5), "sent")], "event_type string, sent_at timestamp, outcome string")
    asks = spark.createDataFrame([("t", at(1440)), ("t", at(1440.01)), ("u", at(4)), ("t", at(0))], "event_type string, at timestamp")
    got = {(r.event_type, r.at): r.recent for r in timeline.recent_sends(asks, ledger, "at", ["event_type"]).collect()}
    assert got == {("t", at(1440)): True, ("t", at(1440.01)): False, ("u", at(4)): False, ("t", at(0)): True}


# --- suppression ---


def alerts_of(spark, rows):
    return spark.createDataFrame([Row(scope=s, alert_id=a, event=e, cycle_ts=t, feed_pos=p, delivered=d) for s, a, e, t, p, d in rows], "scope string, alert_id string, event string, cycle_ts timestamp, feed_pos long, delivered boolean")


def test_suppression_layers(spark):
    fl, to = "Flood Warning", "Tornado Warning"
    rows = [
        ("s", "a", fl, at(0), 0, True), ("s", "b", to, at(0), 1, True), ("s", "c", "High Wind Warning", at(0), 2, True),  # cool-off starts within the cycle, tornado bypasses
        ("s", "a", fl, at(5), 0, True), ("s", "d", fl, at(5), 1, True), ("s", "c", "High Wind Warning", at(5), 2, True),  # repeat, daily cap, still cooling
        ("s", "c", "High Wind Warning", at(30), 0, True),  # cutoff inclusive: still cooling
        ("s", "c", "High Wind Warning", at(31), 0, False), ("s", "c", "High Wind Warning", at(32), 0, True),  # all deliveries fail, then one succeeds
        ("s", "e", fl, at(1440), 0, True), ("s", "f", fl, at(1441), 0, True), ("s", "d", fl, at(1442), 0, True),  # cap inclusive, then free, then known id
        ("s", "d", fl, at(5 + 2881), 0, True),  # past 48 h the id is forgotten, and 24 h after 'f' its type is free
        ("t", "a", fl, at(1), 0, True),
    ]
    got = [(r.scope, r.alert_id, r.cycle_ts, r.outcome) for r in suppression.replay_suppression(alerts_of(spark, rows)).orderBy("scope", "cycle_ts", "feed_pos").collect()]
    assert got == [
        ("s", "a", at(0), "sent"), ("s", "b", at(0), "sent"), ("s", "c", at(0), "deferred_cool_off"), ("s", "d", at(5), "suppressed_daily_cap"), ("s", "c", at(5), "deferred_cool_off"),
        ("s", "c", at(30), "deferred_cool_off"), ("s", "c", at(31), "delivery_failed"), ("s", "c", at(32), "sent"), ("s", "e", at(1440), "suppressed_daily_cap"),
        ("s", "f", at(1441), "sent"), ("s", "d", at(2886), "sent"), ("t", "a", at(1), "sent"),
    ]


def test_cycle_cap_defers_before_other_rules(spark):
    rows = [("s", f"a{n}", f"E{n}", at(0), n, True) for n in range(7)] + [("s", "a6", "E6", at(40), 0, True)]
    policy = suppression.Policy(bypass=tuple(f"E{n}" for n in range(7)))
    got = {(r.alert_id, r.cycle_ts): r.outcome for r in suppression.replay_suppression(alerts_of(spark, rows), policy).collect()}
    assert got == {**{(f"a{n}", at(0)): "sent" for n in range(5)}, ("a5", at(0)): "deferred_cycle_cap", ("a6", at(0)): "deferred_cycle_cap", ("a6", at(40)): "sent"}


def naive_replay(rows, policy):
    ledger, out = [], []
    cycle, sent = None, 0
    for scope, alert, event, now, pos, ok in rows:
        if now != cycle:
            cycle, sent = now, 0
        ledger = [r for r in ledger if (now - r[2]).total_seconds() <= policy.keep_seconds]
        if any(r[0] == alert for r in ledger):
            continue
        sends = [r for r in ledger if r[3] == "sent"]
        if sent >= policy.cycle_cap:
            outcome = "deferred_cycle_cap"
        elif any(r[1] == event and (now - r[2]).total_seconds() <= policy.cap_seconds for r in sends):
            outcome = "suppressed_daily_cap"
        elif event not in policy.bypass and any((now - r[2]).total_seconds() <= policy.cool_off_seconds for r in sends):
            outcome = "deferred_cool_off"
        else:
            outcome = "sent" if ok else "delivery_failed"
        if outcome in ("sent", "suppressed_daily_cap"):
            ledger.append((alert, event, now, outcome))
        sent += outcome == "sent"
        out.append((scope, alert, now, pos, outcome))
    return out


def random_polls(seed, scope, cycles=150, gaps=(5, 5, 30, 200, 5000)):
    rng, rows, now = random.Random(seed), [], 0
    for _ in range(cycles):
        now += rng.choice(gaps)
        for pos in range(rng.randrange(0, 9)):
            rows.append((scope, f"{scope}{rng.randrange(60)}", rng.choice(["Tornado Warning", "Flood Warning", "High Wind Warning", "Ice Storm Warning", "A", "B", "C", "D"]), at(now), pos, rng.random() > 0.1))
    return rows


def test_replay_equals_naive_policy(spark):
    policy = suppression.Policy(cap_seconds=4 * 3600, cool_off_seconds=600, cycle_cap=2)
    parts = [random_polls(n, f"s{n}") for n in range(6)]
    got = suppression.replay_suppression(alerts_of(spark, [r for p in parts for r in p]), policy)
    mine = sorted((r.scope, r.alert_id, r.cycle_ts, r.feed_pos, r.outcome) for r in got.collect())
    assert mine == sorted(r for p in parts for r in naive_replay(p, policy))


@pytest.mark.parametrize("chunk_polls", [3, 10**9])
def test_busy_scope_is_replayed_in_chunks(spark, chunk_polls):
    policy = suppression.Policy(cap_seconds=4 * 3600, cool_off_seconds=600, cycle_cap=2)
    parts = [random_polls(7, "hot", 50, (5, 5, 30, 90)), random_polls(8, "calm", 40), random_polls(9, "warm", 20, (5, 30))]
    decided, rounds = suppression.replay_in_rounds(alerts_of(spark, [r for p in parts for r in p]), policy, chunk_polls)
    mine = sorted((r.scope, r.alert_id, r.cycle_us, r.outcome) for r in decided.where("outcome is not null").collect())
    micros = lambda t: int((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert mine == sorted((s, a, micros(t), o) for p in parts for s, a, t, _, o in naive_replay(p, policy))
    assert (len(rounds) > 1 and rounds == sorted(rounds, reverse=True)) if chunk_polls < 10**9 else len(rounds) == 1


def test_state_text_drops_what_no_longer_matters():
    policy = suppression.Policy(cap_seconds=100, cool_off_seconds=10, keep_seconds=200)
    s = 1_000_000
    late = suppression.ScopeState({"old": 0, "b": 250 * s, "a": 250 * s}, {"E": 199 * s, "F": 200 * s}, 289 * s, 300 * s, 4)
    assert suppression.state_text(late, policy) == '[[[250000000, "a"], [250000000, "b"]], [["F", 200000000]], null]'
    back = suppression.state_from(suppression.state_text(late, policy))
    assert back.seen == {"a": 250 * s, "b": 250 * s} and back.by_type == {"F": 200 * s} and back.last is None and back.cycle is None
    assert suppression.state_text(suppression.ScopeState(), policy) == suppression.EMPTY_STATE


def test_recent_sends_in_one_busy_slot_and_many_slots(spark):
    rng = random.Random(4)
    sends = sorted({rng.choice([rng.randrange(0, 500), rng.randrange(0, 400_000)]) for _ in range(400)})
    asks = sorted({rng.choice([rng.randrange(0, 500), rng.randrange(0, 500_000)]) for _ in range(400)} | {s + 86400 for s in sends[:20]})
    ledger = spark.createDataFrame([(None if n % 3 else "T", s, "sent") for n, s in enumerate(sends)] + [("T", 7, "suppressed_daily_cap")], "event_type string, s long, outcome string").withColumn("sent_at", F.timestamp_seconds("s"))
    asked = spark.createDataFrame([(k, a) for a in asks for k in (None, "T")], "event_type string, a long").withColumn("at", F.timestamp_seconds("a"))
    got = {(r.event_type, r.a): (r.f, r.l, r.recent) for r in timeline.recent_sends(asked, ledger, "at", ["event_type"]).select("event_type", F.unix_seconds("at").alias("a"), F.unix_seconds("first_sent").alias("f"), F.unix_seconds("latest_sent").alias("l"), "recent").collect()}
    assert len(got) == 2 * len(asks)
    for (k, a), found in got.items():
        own = [s for n, s in enumerate(sends) if (None if n % 3 else "T") == k and a - 86400 <= s <= a]
        assert found == ((own[0], own[-1], True) if own else (None, None, False))


@pytest.mark.parametrize("size", [7, 64, 100_000])
def test_raster_facts_whatever_the_batches(size):
    import pyarrow as pa

    rng = random.Random(size)
    cells = [(s, r, c, rng.choice([None, 0.0, 1.0, 4.0, 9.5]) if s != "b" else 2.0) for s in ("a", "b", "c", None) for r in range(6) for c in range(5) if rng.random() < 0.9]
    cells.sort(key=lambda x: (x[0] is not None, x[0] or "", x[1], x[2]))
    held, got = grids.OpenScan(), []
    for k in range(0, len(cells), size):
        part = cells[k : k + size]
        got += held.take(pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.string()), *(pa.array([x[n] for x in part], pa.int64()) for n in (1, 2)), pa.array([x[3] for x in part], pa.float64()), pa.array([x[3] == 9.5 for x in part])], names=["s", "r", "c", "v", "w"]), 5.0, 3.0)
    got += held.close()
    want = []
    for s in (None, "a", "b", "c"):
        at = {(r, c): v for t, r, c, v in cells if t == s}
        near = pairs = smooth = triples = 0
        for (r, c), v in at.items():
            for dr, dc in ((0, 1), (1, 0)):
                one, two = at.get((r - dr, c - dc)), at.get((r - 2 * dr, c - 2 * dc))
                if v is not None and one is not None:
                    pairs, near = pairs + 1, near + (abs(v - one) < 5)
                    if two is not None:
                        triples, smooth = triples + 1, smooth + (abs(v - 2 * one + two) < 3)
        known = [v for v in at.values() if v is not None]
        want.append((s, min(known), max(known), len(set(known)), len(at), len(known), known.count(9.5), near, pairs, smooth, triples))
    assert got == want


def test_merkle_tree_updates_and_names_differences(spark):
    keys = [f"k{n}" for n in range(300)] + ["k7", "k7", None, ""]
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    other = spark.createDataFrame([(k,) for k in keys if k != "k50"] + [("new",), ("k7",)], "k string")
    changed = spark.createDataFrame([("k50",), ("new",), ("k7",)], "k string")
    leaves, others = merkle.merkle_leaves(rows, "k").cache(), merkle.merkle_leaves(other, "k").cache()
    want = {r.leaf for r in changed.select(merkle.range_of(F.col("k")).alias("leaf")).collect()}
    found = merkle.differing_ranges(leaves, others).collect()
    assert {r.leaf for r in found} == want and sorted(r.right_n - r.left_n for r in found) == [-1, 1, 1]
    again = merkle.updated_leaves(leaves, other, changed, "k")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, others.collect()))
    root = lambda x: merkle.tree_fingerprint(merkle.merkle_tree(x)).first()
    assert root(again) == root(others) and root(leaves).n == 304 and root(leaves).fingerprint != root(others).fingerprint
    assert root(merkle.merkle_leaves(rows.repartition(5), "k")) == root(leaves)
    nulls = [merkle.merkle_leaves(spark.createDataFrame([(k,)], "k string"), "k").first().digest for k in (None, "")]
    assert nulls[0] != nulls[1] and merkle.merkle_tree(merkle.merkle_leaves(rows.limit(0), "k")).count() == 0
    tree = merkle.merkle_tree(leaves, 12)
    assert {r.level for r in tree.select("level").distinct().collect()} == {0, 1, 2, 3}


@pytest.mark.parametrize("most", [4, 64])
def test_heavy_colours_in_two_passes(spark, most, monkeypatch):
    monkeypatch.setattr(pixels, "REPORTED", most)
    rng = random.Random(most)
    colours = [(rng.randrange(4), rng.randrange(5), min(4, int(rng.expovariate(1)))) for _ in range(4000)] + [(9, 9, 9)] * 700
    rng.shuffle(colours)
    df = spark.createDataFrame(colours, "r int, g int, b int").repartition(7)
    counts = sorted(((-n, *c) for c, n in Counter(colours).items()))[:20]
    got = pixels._top_colours(df, [], 20).orderBy("rank").collect()
    assert [(-r.n, r.r, r.g, r.b) for r in got] == counts and {(r.total, r.colours) for r in got} == {(4700, len(set(colours)))}
    assert pixels._top_colours(df.limit(0), [], 20).collect() == []


def test_haversine_symmetry(spark):
    a = one(spark, haversine_km(F.lit(35.0), F.lit(-97.0), F.lit(36.0), F.lit(-98.0)))
    assert a == pytest.approx(km(35, -97, 36, -98)) and one(spark, haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * 6371)


def test_tasks_of_a_replay_follow_its_polls(spark, monkeypatch):
    polls = alerts_of(spark, [r for n in range(6) for r in random_polls(n, f"s{n}", 40)])
    want = sorted(map(tuple, suppression.replay_suppression(polls).collect()))
    monkeypatch.setattr(suppression, "TASK_POLLS", 10)
    decided, _ = suppression.replay_in_rounds(polls)
    assert decided.rdd.getNumPartitions() == -(-polls.count() // 10)  # adaptive coalescing would leave one
    assert sorted(map(tuple, suppression.replay_suppression(polls).collect())) == want


def test_sides_of_a_large_join_are_dealt_by_size(spark, monkeypatch):
    left, right = spark.range(1000).withColumnRenamed("id", "k"), spark.range(500).select(F.col("id").alias("k"), F.lit("x" * 20).alias("v"))
    assert session.dealt_alike(left, right, "k") == (left, right)
    monkeypatch.setattr(session, "ONE_SPLIT", 1000)
    monkeypatch.setattr(session, "JOIN_SPLIT", 1000)
    one, other = session.dealt_alike(left, right, "k")
    assert one.rdd.getNumPartitions() == other.rdd.getNumPartitions() > 8
    assert one.join(other, "k").count() == 500
