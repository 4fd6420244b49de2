"""Physical plans: pruned scans, no pairwise joins, no hidden broadcast."""

import re

import pytest

from gustfront.catalog.load import registered

FOLDER = "/root/testdata/sf0.001"
RUNS = registered()
LAZY = sorted(n for n in RUNS if not n.startswith(("k0", "t0")) and not n.endswith("_stream"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_join(spark, name):
    text = plan(RUNS[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filter_and_columns_reach_the_scan(spark):
    from gustfront.operators import timeline

    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    text = plan(timeline.keep_last(events.where("event_type = 'error'"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id"))
    assert "EqualTo(event_type,error)" in text and "WindowGroupLimit" in text
    assert "props" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_site_lookup_adds_no_shuffle_to_large_inputs(spark, monkeypatch):
    from gustfront import session
    from gustfront.operators import proximity

    monkeypatch.setattr(session, "ONE_SPLIT", -1)
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").selectExpr("o_orderkey report_id", "30d lat", "-97d lon")
    sites = spark.read.parquet(f"{FOLDER}/supplier.parquet").selectExpr("concat('K', s_suppkey) station", "31d lat", "-97d lon")
    text = plan(proximity.nearest_station(orders, sites))
    assert text.count("Exchange hashpartitioning") == 1 and "Exchange RoundRobin" not in text  # only the site table is grouped


def test_large_sides_are_not_broadcast_by_hint(spark):
    text = plan(RUNS["j01_nearest_station_large_site_table"](spark, FOLDER))
    assert "ResolvedHint" not in text and "strategy=broadcast" not in text


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


def test_look_back_shuffles_five_times_at_most(spark):
    asked = spark.createDataFrame([("a", "2024-01-01")], "event_type string, t string").selectExpr("event_type", "to_timestamp(t) as at")
    ledger = asked.selectExpr("event_type", "at as sent_at", "'sent' as outcome")
    from gustfront.operators import timeline

    assert exchanges(timeline.recent_sends(asked, ledger, "at", ["event_type"])) <= 5


def test_pixels_of_a_streamed_frame_are_not_shuffled(spark):
    from gustfront.streaming import frames

    images = spark.createDataFrame([("radar_base_velocity_1.png", 1, 1, 3, bytearray(3))], "origin string, height int, width int, nChannels int, data binary")
    palette = spark.createDataFrame([(0, 1, 2, 3, 4.0)], "x int, r int, g int, b int, value double")
    text = plan(frames.frame_grids(images, {"velocity": palette}, 1))
    assert "row_no" not in text and text.count("MapInPandas") == 1


@pytest.mark.parametrize("name", ["a07_a08_grid_quality", "a07_metric_verdicts", "w02_w03_neighbour_differences"])
def test_rasters_are_exchanged_once(spark, name):
    assert exchanges(RUNS[name](spark, FOLDER)) == 1


def test_differences_need_no_window(spark):
    assert "Window" not in plan(RUNS["w02_w03_neighbour_differences"](spark, FOLDER))


def test_palette_reaches_python_as_flat_arrays(spark, monkeypatch):
    from gustfront.streaming import frames

    images = spark.createDataFrame([("radar_base_velocity_1.png", 1, 1, 3, bytearray(3))], "origin string, height int, width int, nChannels int, data binary")
    palette = spark.createDataFrame([(1, 9, 9, 9, 7.0), (0, 1, 2, 3, 4.0)], "x int, r int, g int, b int, value double")
    seen, plain = [], type(images).mapInPandas
    monkeypatch.setattr(type(images), "mapInPandas", lambda self, *a, **k: seen.append(self.schema.simpleString()) or plain(self, *a, **k))
    assert frames.frame_grids(images, {"velocity": palette}, 1).first()["data"] == [[4.0]]
    assert seen and "array<struct" not in seen[0]


def test_appended_manifest_is_computed_once(spark, monkeypatch):
    from gustfront.sinks import tables

    read, plain = [], tables.append_events
    monkeypatch.setattr(tables, "append_events", lambda part, *a, **k: read.extend(part.inputFiles()) or plain(part, *a, **k))
    RUNS["k01_committed_append"](spark, FOLDER)
    assert read and not any("orders.parquet" in f for f in read)


def test_grid_sink_exchanges_pixels_once(spark, monkeypatch):
    from gustfront.sinks import tables

    plans, plain = [], tables.write_grids
    monkeypatch.setattr(tables, "write_grids", lambda grids, *a, **k: plans.append(plan(grids)) or plain(grids, *a, **k))
    RUNS["k02_grid_sink"](spark, FOLDER)
    assert sum(plans[0].count(f"Exchange hashpartitioning({key}") for key in ("l_orderkey", "scan_id")) == 1


def test_lookup_knows_the_size_of_its_palette(spark):
    """A palette drawn from a large table must not send the pixels over the network by colour cube."""
    from gustfront.catalog.views import Inputs
    from gustfront.operators import palette

    inputs, key = Inputs(spark, FOLDER), "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "10000")  # between the estimates for the stored palette and for one drawn from lineitem
    try:
        text = plan(palette.palette_lookup(inputs.pixels, inputs.palette))
    finally:
        spark.conf.set(key, old)
    assert text.count("Exchange hashpartitioning(cube") == 1  # the candidates are grouped; pixels stay where they are
