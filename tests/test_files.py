"""Sources, sinks and streams on real files in temporary folders."""

import json
import os
import random
import struct
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustfront.operators import suppression
from gustfront.schemas import SCORE_STATUS, TENSOR_MANIFEST_TEXT
from gustfront.session import materialise
from gustfront.sinks import log, tables
from gustfront.sources import feeds, frames, reports
from gustfront.streaming import feeds as live
from gustfront.streaming import frames as live_frames
from gustfront.streaming import settled, stateful
from tests.test_rules import alerts_of, at, random_polls


def png(array: np.ndarray) -> bytes:
    """A plain RGB PNG."""
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in array)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", array.shape[1], array.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 0)) + chunk(b"IEND", b"")


def put(folder, name, content, age=0):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    if age:
        os.utime(path, (path.stat().st_mtime - age,) * 2)
    return path


def test_yearly_reports(spark, tmp_path):
    head = "yr,date,time,mag,slat,slon,st\n"
    put(tmp_path, "2023_hail.csv", head + "2023,2023-05-01,18:05:00,1.75,35.1,-97.2, ok \n2022,2023-05-01,18:05:00,1,35.1,-97.2,OK\n2023,bad,18:05:00,1,35.1,-97.2,OK\n2023,2023-05-01,,1,35.1,-97.2,OK\n2023,2023-05-02,01:00:00,,0,-97.2,OK\n2023,2023-05-02,01:00:00,,35,-97.2,TX\n")
    put(tmp_path, "2025_hail.csv", "st,yr,date,time,mag,slat,slon\nKS,2025,2025-06-01,00:00:00,-0.5,38.0,-98.0\n")
    got = reports.read_yearly_reports(spark, str(tmp_path), "hail", [2023]).orderBy("event_ts").collect()
    assert [(r.event_ts, r.mag, r.st, r.label, r.subtype) for r in got] == [(datetime(2023, 5, 1, 18, 5), 1, "OK", "no_tornado", "hail"), (datetime(2023, 5, 2, 1), -9, "TX", "no_tornado", "hail")]
    assert reports.read_yearly_reports(spark, str(tmp_path), "hail", [2025]).first().mag == 0
    assert reports.read_yearly_reports(spark, str(tmp_path), "wind", [2023, 2024]).count() == 0
    put(tmp_path, "torn.csv", head + "2023,2023-05-01,18:05:00,0,35.1,-97.2,OK\n2023,2023-05-01,18:05:00,2,35.1,-97.2,OK\n")
    assert [r.mag for r in reports.read_tornadoes(spark, str(tmp_path / "torn.csv"), [2023]).collect()] == [2]


def test_report_time_zone(spark):
    raw = spark.createDataFrame([("2023", "2023-07-01", "12:00:00", "1", "35", "-97", "ok")], "yr string, date string, time string, mag string, slat string, slon string, st string")
    assert reports.parse_reports(raw, [2023], "tornado", "tornado", source_tz="America/Chicago").first().event_ts == datetime(2023, 7, 1, 17)


def test_stations_and_fallback(spark, tmp_path):
    site = lambda i, lon, lat: {"id": i, "geometry": {"coordinates": [lon, lat]}}
    good = put(tmp_path, "good.json", json.dumps({"features": [site("TLX", -97.3, 35.3), site("EDGE", -125, 40), site("HNL", -157, 21)]}))
    assert [r.station for r in reports.read_stations(spark, str(good)).collect()] == ["KTLX"]
    none = put(tmp_path, "none.json", json.dumps({"features": []}))
    assert reports.read_stations(spark, str(none)).count() == reports.read_stations(spark, str(tmp_path / "absent.json")).count() == 12


def test_listing_pages(spark, tmp_path):
    put(tmp_path, "FWS/N0B/index.html", "FWS_N0B_202401010005.png FWS_N0B_202401010005.png FWS_N0B_202413010005.png TLX_N0B_202401010010.png")
    got = reports.read_listings(spark, str(tmp_path / "*" / "*")).collect()
    assert [(r.station, r.product, r.scan_ts, r.file) for r in got] == [("KFWS", "N0B", datetime(2024, 1, 1, 0, 5), "FWS_N0B_202401010005.png")]


def test_cut_off_manifest(spark, tmp_path):
    path = put(tmp_path, "m.csv", "event_id,label,class\na,1,tornado\nb,0,no_torn\n,1,x\nc,1")
    assert sorted(r.event_id for r in reports.read_manifest(spark, str(path)).collect()) == ["a", "b", "c"]
    assert reports.read_manifest(spark, str(tmp_path / "absent.csv"), TENSOR_MANIFEST_TEXT).count() == 0


def test_frame_scans(spark, tmp_path):
    picture = png(np.full((9, 9, 3), 7))
    put(tmp_path, "radar_base_reflectivity_1.png", picture, age=5000)
    put(tmp_path, "radar_base_velocity_2.png", picture, age=9000)
    put(tmp_path, "radar_base_velocity_3.png", picture)
    put(tmp_path, "radar_base_velocity_4.png", picture[:150], age=9000)
    put(tmp_path, "radar_base_velocity_5.png", b"GIF8" + picture[4:], age=9000)
    put(tmp_path, "sub/base_intensity_scale.png", picture)
    put(tmp_path, "sub/other.png", picture, age=9000)
    files = frames.read_frame_files(spark, str(tmp_path))
    now = F.lit(datetime.now()).cast("timestamp")
    ready = live_frames.ready_frames(files, now).collect()
    assert [r.path.rsplit("_", 1)[1] for r in ready] == ["2.png", "1.png"] and [r.radar_type for r in ready] == ["velocity", "reflectivity"]
    deep = frames.without_scales(frames.read_frame_files(spark, str(tmp_path), recursive=True))
    assert deep.count() == 6


def test_world_files(spark, tmp_path):
    put(tmp_path, "KFWS.wld", "0.005\n0.0\n0.0\n-0.005\n-100.0\n35.5\n")
    put(tmp_path, "KBAD.wld", "nothing here")
    got = frames.read_georefs(spark, str(tmp_path)).collect()
    assert [(r.station, r.a, r.e, r.c, r.f) for r in got] == [("KFWS", 0.005, -0.005, -100.0, 35.5)]


def test_image_pixels(spark, tmp_path):
    rng = np.random.default_rng(0)
    array = rng.integers(0, 256, (5, 7, 3))
    put(tmp_path, "a.png", png(array))
    put(tmp_path, "b.png", b"\x89PNG broken")
    got = frames.image_pixels(frames.read_images(spark, str(tmp_path))).collect()
    assert len(got) == 35 and all(list(array[r.row_no, r.col_no]) == [r.r, r.g, r.b] for r in got)


def test_grid_documents(spark, tmp_path):
    meta = {"radar_type": "reflectivity", "units": "dBZ", "value_range": {"min": -20, "max": 70}}
    put(tmp_path, "a.json", json.dumps({"metadata": meta, "data": [[1, 2, 3], [4, 5, 6]]}))
    put(tmp_path, "b.json", json.dumps({"data": [[1, 2, 3]]}))
    put(tmp_path, "c.json", "{oops")
    got = frames.read_grids(spark, str(tmp_path)).withColumn("problem", frames.grid_problem(5))
    assert {r.file: r.problem for r in got.collect()} == {"a.json": "valid", "b.json": "missing required field: metadata", "c.json": "invalid json"}
    cells = frames.grid_cells(got.where("problem = 'valid'"), "file").collect()
    assert {(r.row_no, r.col_no): r.value for r in cells}[(1, 2)] == 6.0


@pytest.mark.parametrize(("batch", "parts"), [("10000", None), ("7", 3)])
def test_grid_documents_from_cells(spark, batch, parts):
    """Ragged lines, gaps, repeated cells and NULLs, with scans that end in a batch, on its edge or many batches later."""
    rng = random.Random(3)
    cells = [(s, row, col, rng.choice([None, round(rng.uniform(-20, 70), 2)])) for s in [*(f"s{n}" for n in range(30)), None] for row in [None, *rng.sample(range(9), rng.randrange(1, 6))][s != "s3" :] for col in rng.sample([None, 0, 1, 2, 2, 5], rng.randrange(1, 6))]
    cells += [("long", row, col, row * 100.0 + col) for row in range(4) for col in range(40)] + [("one", 3, 3, 1.5)]
    rng.shuffle(cells)
    low = lambda v: (v is not None, v or 0)
    want: dict = {}
    for scan, row, _, value in sorted(cells, key=lambda c: (low(c[1]), low(c[2]), low(c[3]))):
        want.setdefault(scan, {}).setdefault(row, []).append(value)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        got = tables.grid_documents(spark.createDataFrame(cells, "scan_id string, row_no int, col_no int, value double"), "reflectivity", 2, parts=parts).collect()
    finally:
        spark.conf.set(key, old)
    assert len(got) == len(want) and {r.scan_id: r.data for r in got} == {s: list(lines.values()) for s, lines in want.items()}
    assert all((r.metadata.sampled_dimensions.height, r.metadata.original_dimensions.width) == (len(r.data), 2 * len(r.data[0])) for r in got)


def test_alert_feed_and_status(spark, tmp_path):
    feature = lambda i, expires: {"properties": {"id": i, "event": "Tornado Warning", "expires": expires, "areaDesc": "X"}, "geometry": None}
    put(tmp_path, "f/poll1.json", json.dumps({"features": [feature("a", "2030-05-27T19:00:00-05:00"), feature("b", "soon")]}))
    put(tmp_path, "f/poll2.json", json.dumps({"features": []}))
    got = feeds.read_alert_feed(spark, str(tmp_path / "f")).orderBy("feed_pos").collect()
    assert [(r.alert_id, r.expires) for r in got] == [("a", datetime(2030, 5, 28, 0, 0)), ("b", None)]
    assert got[0].expires_text == "2030-05-27T19:00:00-05:00"
    put(tmp_path, "s/ok.json", json.dumps({"status": "running", "last_score": 0.5, "cycle_ms": {"fetch": 5}, "errors": [{"time": "t", "kind": "k", "msg": "m"}]}))
    put(tmp_path, "s/bad.json", '{"status": ')
    status = feeds.read_status(spark, str(tmp_path / "s"), SCORE_STATUS).collect()
    assert len(status) == 1 and status[0].cycle_ms == {"fetch": 5} and feeds.read_status(spark, str(tmp_path / "none")).count() == 0
    put(tmp_path, "l/ledger.json", json.dumps([{"alert_id": "a", "event_type": "x", "sent_at": "2024-01-01T00:00:00Z", "outcome": "sent", "recipients_failed": [{"to": "q", "err": "e"}]}, {"alert_id": "b", "sent_at": "?"}]))
    ledger = feeds.read_ledger(spark, str(tmp_path / "l")).collect()
    assert [r.alert_id for r in ledger] == ["a"] and ledger[0].recipients_failed[0].err == "e"


def test_weather_documents(spark, tmp_path):
    put(tmp_path, "o/1.json", json.dumps({"properties": {"timestamp": "2024-05-01T10:00:00+00:00", "station": "https://x/KDFW", "temperature": {"value": 20.5}, "windSpeed": {"value": None}}}))
    got = feeds.read_observations(spark, str(tmp_path / "o")).first()
    assert (got.station, got.temp_c, got.wind_kmh, got.dew_c) == ("KDFW", 20.5, None, None)
    put(tmp_path, "p/1.json", json.dumps({"properties": {"periods": [{"name": "Tonight", "temperature": 60}]}}))
    assert feeds.read_forecasts(spark, str(tmp_path / "p")).first().periods[0].name == "Tonight"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "event_id string, n int")
    tables.append_events(rows.where("event_id = 'a'"), str(tmp_path / "m"))
    tables.append_events(rows, str(tmp_path / "m"))
    tables.append_events(rows, str(tmp_path / "m"))
    rows.withColumn("event_id", F.lit("c")).write.parquet(str(tmp_path / "m" / "__run=broken"))  # never committed: its event must come in again
    assert sorted(r.n for r in tables.read_events(spark, str(tmp_path / "m")).collect()) == [1, 2, 3]
    tables.append_events(rows.withColumn("event_id", F.lit("c")), str(tmp_path / "m"))
    assert sorted(r.n for r in tables.read_events(spark, str(tmp_path / "m")).collect()) == [1, 1, 2, 2, 3, 3]
    for version in (1, 2, 10):
        tables.write_snapshot(rows.limit(version), str(tmp_path / "s"), version)
    (tmp_path / "s" / "version=10" / "_SUCCESS").unlink()
    assert tables.read_snapshot(spark, str(tmp_path / "s")).count() == 2
    ties = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "label string, n int")
    assert sorted(r.id for r in tables.training_samples(ties, ["label"]).collect()) == [0, 1, 2]
    ledger = lambda day: spark.createDataFrame([(f"2024-01-{day:02d} 10:00:00",), (f"2024-01-{day - 1:02d} 12:00:00",)], "t string").select(F.to_timestamp("t").alias("sent_at"))
    for day in (2, 20):
        tables.save_ledger(ledger(day), str(tmp_path / "l"), F.to_timestamp(F.lit(f"2024-01-{day:02d} 10:00:00")))
    assert {str(r.sent_at)[:10] for r in tables.load_ledger(spark, str(tmp_path / "l")).collect()} == {"2024-01-19", "2024-01-20"}
    for name in "ab":
        (tmp_path / f"{name}.png").write_text(name)
    listed = spark.createDataFrame([(n, str(tmp_path / f"{n}.png")) for n in "ab"], "stem string, path string")
    verified = spark.createDataFrame([("a", "valid"), ("b", "empty")], "stem string, problem string")
    gone = settled.remove_verified(listed, verified, "path", archive=str(tmp_path / "old"), root=str(tmp_path))
    assert gone == 1 and (tmp_path / "old" / "a.png").exists() and (tmp_path / "b.png").exists()
    every = verified.withColumn("problem", F.lit("valid"))
    assert settled.remove_verified(listed, every, "path") == 1 and not (tmp_path / "b.png").exists() and settled.remove_verified(listed, every, "path") == 0
    dated = rows.withColumn("d", F.expr("date'2024-01-01' + n * 10"))
    dated.write.partitionBy("d").parquet(str(tmp_path / "d"))
    tables.drop_old_dates(spark, str(tmp_path / "d"), "d", "2024-02-10", 14)
    assert [r.n for r in spark.read.parquet(str(tmp_path / "d")).collect()] == [3]
    reportless = spark.createDataFrame([("DFW", "c1", "line1\nline2")], "region string, cycle string, report string")
    tables.write_reports(reportless, str(tmp_path / "t"), "region", "cycle")
    assert [r.value for r in spark.read.text(str(tmp_path / "t" / "region=DFW" / "cycle=c1")).collect()] == ["line1", "line2"]
    assert materialise(rows, "t").count() == 3


def test_streamed_suppression_equals_batch(spark, tmp_path):
    policy = suppression.Policy(cap_seconds=4 * 3600, cool_off_seconds=600, cycle_cap=2)
    rows = sorted((r for n in range(3) for r in random_polls(n, f"s{n}", 60)), key=lambda r: r[3])
    live.prepare(spark, 4)
    cuts = [0, len(rows) // 3, 2 * len(rows) // 3, len(rows)]
    for lo, hi in zip(cuts, cuts[1:]):
        while hi < len(rows) and rows[hi][3] == rows[hi - 1][3]:
            hi += 1
        part = [r for r in rows[lo:hi] if not lo or r[3] > rows[lo - 1][3]]
        alerts_of(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.stream_files(spark, str(tmp_path / "in"), alerts_of(spark, rows).schema)
        live.start(stateful.suppress_stream(stream, policy), str(tmp_path / "cp"), path=str(tmp_path / "out")).awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    pick = lambda df: sorted((r.scope, r.alert_id, r.cycle_ts, r.feed_pos, r.outcome) for r in df.collect())
    assert pick(spark.read.parquet(str(tmp_path / "out"))) == pick(suppression.replay_suppression(alerts_of(spark, rows), policy))


def test_alerts_named_once_wait_for_their_turn(spark, tmp_path):
    """A feed that names an alert once decides as one that repeats it, through a restart."""
    policy = suppression.Policy(cap_seconds=4 * 3600, cool_off_seconds=1500, cycle_cap=2, keep_seconds=10 * 3600)
    rng, poll = random.Random(11), 5
    once = []
    for n in range(260):
        start = poll * rng.randrange(0, 600)
        event = rng.choice(["Tornado Warning", "Flood Warning", "High Wind Warning", "Ice Storm Warning", "A", "B", "C"])
        once.append((f"s{n % 3}", f"a{n}", event, start, n, rng.random() > 0.15, start + rng.choice([3, 20, 60, 300])))
    repeated = [(s, a, e, at(t), p, d) for s, a, e, start, p, d, end in once for t in range(start, end, poll)]
    want = suppression.ledger_rows(suppression.replay_suppression(alerts_of(spark, repeated), policy))
    live.prepare(spark, 4)
    schema = "scope string, alert_id string, event string, cycle_ts timestamp, feed_pos long, delivered boolean, expires timestamp"
    rows = [(s, a, e, at(start), p, d, at(end)) for s, a, e, start, p, d, end in once]
    marks = [("mark", None, None, at(t), 0, True, at(t + 1)) for t in (1400, 9000)]
    for lo, hi, last in ((0, 1000, []), (1000, 2000, []), (2000, 4000, marks[:1]), (4000, 9999, marks[1:])):
        part = [r for r in rows if at(lo) <= r[3] < at(hi)] + last
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.stream_files(spark, str(tmp_path / "in"), schema)
        live.start(stateful.suppress_pending_stream(stream, policy, poll * 60), str(tmp_path / "cp"), path=str(tmp_path / "out")).awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    pick = lambda df: sorted((r.scope, r.alert_id, r.cycle_ts, r.feed_pos, r.outcome) for r in df.collect())
    got = spark.read.parquet(str(tmp_path / "out"))
    assert pick(suppression.ledger_rows(got)) == pick(want) and want.count() > 100
    named = spark.createDataFrame(rows, schema).select("alert_id", F.col("cycle_ts").alias("named"))
    assert got.join(named, "alert_id").where("outcome = 'sent' and cycle_ts > named").count() > 10


def test_status_from_observed_metrics(spark, tmp_path):
    rows = sorted((r for n in range(2) for r in random_polls(n, f"s{n}", 40, (5, 30))), key=lambda r: r[3])
    live.prepare(spark, 4)
    listener = stateful.StatusListener(spark, str(tmp_path / "status"))
    spark.streams.addListener(listener)
    half = rows[len(rows) // 2][3]
    try:
        for part in ([r for r in rows if r[3] < half], [r for r in rows if r[3] >= half]):
            alerts_of(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = live.stream_files(spark, str(tmp_path / "in"), alerts_of(spark, rows).schema)
            live.start(stateful.observed(stateful.suppress_stream(stream)), str(tmp_path / "cp"), path=str(tmp_path / "out")).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30000)
    finally:
        spark.streams.removeListener(listener)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    decided = spark.read.parquet(str(tmp_path / "out"))
    sent = decided.where("outcome = 'sent'")
    status = tables.read_snapshot(spark, str(tmp_path / "status")).first()
    assert status.sent_total == sent.count() > 0 and status.last_sent_us == sent.agg(F.unix_micros(F.max("cycle_ts"))).first()[0]
    second = decided.where(F.col("cycle_ts") >= F.lit(half))
    assert (status.sent, status.suppressed, status.deferred) == tuple(second.agg(F.count_if(F.expr("outcome = 'sent'")), F.count_if(F.expr("outcome = 'suppressed_daily_cap'")), F.count_if(F.expr("outcome like 'deferred%'"))).first())
    listener.write(status.batch, {"sent": status.sent, "suppressed": 0, "deferred": 0, "failed": 0, "last_sent_us": None, "last_poll_us": None})  # the batch once more
    assert tables.read_snapshot(spark, str(tmp_path / "status")).first().sent_total == status.sent_total


class MapState(dict):
    containsKey, removeKey, updateValue, getValue = dict.__contains__, dict.__delitem__, dict.__setitem__, dict.__getitem__

    def iterator(self):
        return iter(self.items())


class ValueState(list):
    def exists(self):
        return bool(self)

    def get(self):
        return self[0] if len(self) == 1 else list(self)

    def update(self, value):
        self[:] = [value]

    put = lambda self, values: self.__setitem__(slice(None), values)
    appendList = list.extend


class ListState(ValueState):
    def get(self):
        return list(self)


class Handle:
    """State and timers of one key, without an engine."""

    def __init__(self):
        self.timers = []
        self.registerTimer, self.deleteTimer = self.timers.append, self.timers.remove

    getMapState = staticmethod(lambda *a: MapState())
    getValueState = staticmethod(lambda *a: ValueState())
    getListState = staticmethod(lambda *a: ListState())

    def listTimers(self):
        return iter(self.timers)


def test_answers_wait_for_the_watermark_and_stay(tmp_path):
    import pandas as pd
    from types import SimpleNamespace as At

    p = stateful.AsOfProcessor()
    p.init(Handle())
    columns = ["at_us", "row", "score_id", "score", "status"]
    alert = lambda at, row: (at * 1000, row, None, None, None)
    score = lambda at, id_, value: (at * 1000, None, id_, value, "running")

    def feed(passed, *rows):
        made = next(iter(p.handleInputRows((0,), iter([pd.DataFrame([r], columns=columns) for r in rows]), At(getCurrentWatermarkInMs=lambda: passed))))
        return [(r.row, None if pd.isna(r.score_id) else int(r.score_id)) for r in made.itertuples()]

    assert feed(0, alert(50, "a"), score(40, 1, 0.5), alert(30, "b"), alert(70, "c")) == []
    assert feed(60, score(45, 2, 0.6), score(65, 3, None)) == [("b", None), ("a", 2)]  # both before 60, and all that was known by then
    assert p.handle.timers == [71] and [s[1] for s in p.scores] == [2, 3]
    assert feed(70, score(68, 4, 0.7)) == []  # a row at the watermark may still come
    later = next(iter(p.handleExpiredTimer((0,), At(getCurrentWatermarkInMs=lambda: 71), None)))
    assert later["row"].tolist() == ["c"] and later["score_id"].tolist() == [4] and not p.waiting


def test_alerts_meet_scores_by_slot_and_batch(spark, tmp_path):
    rng = np.random.default_rng(11)
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=int(minute))
    alert_type, score_type = "feed_pos long, cycle_ts timestamp", "score_id long, score_ts timestamp, score double, status string"
    asked, told, batches = [], [], []
    for n, low in enumerate(range(0, 300, 100)):  # every batch repeats its first minutes: ties, and rows that are not late yet
        a = [(1000 * n + k, at(m)) for k, m in enumerate(rng.integers(max(0, low - 5), low + 100, 40))]
        s = [(1000 * n + k, at(m), float(k), "running") for k, m in enumerate(rng.integers(max(3, low - 5), low + 95, 30))]
        batches.append((a + [(-2, None)], s + [(-2, None, 0.0, "running")]))
        asked, told = asked + a, told + s
    batches[2][0].append((-1, at(20)))  # both are far too late
    batches[2][1].append((-1, at(150), 0.0, "running"))
    batches.append(([(-9, at(900))], [(-9, at(900), 1.0, "running")]))

    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    run = live.as_of_batch(state, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    for n, (a, s) in enumerate(batches):
        batch = live.as_of_rows(spark.createDataFrame(a, alert_type), spark.createDataFrame(s, score_type))
        run(batch, n)
        if n == 2:  # taken to be broken off before the engine's commit
            run(batch, n)
        kept = spark.read.parquet(f"{state}/scores/version={n}").collect()
        mark = min(max(x[1] for x in part if x[1]) for part in (a, s)) - timedelta(minutes=10)
        assert sum(r.score_ts < mark for r in kept) == 1 and len(kept) == len({r.score_id for r in kept}) < 40
        assert len(list((tmp_path / "state" / "waiting").glob("version=*"))) <= 2
    got = {r.feed_pos: (r.score, r.score_age) for r in spark.read.parquet(out).collect()}
    want = {}
    for pos, t in asked:
        best = max((x for x in told if x[1] <= t), key=lambda x: (x[1], x[0]), default=None)
        want[pos] = (best[2], int((t - best[1]).total_seconds())) if best else (None, None)
    assert spark.read.parquet(out).count() == len(got) and got == want


def test_ids_are_forgotten_by_the_hour():
    import pandas as pd

    p = stateful.SuppressionProcessor(suppression.Policy(cap_seconds=0, cool_off_seconds=-1))
    p.init(Handle())
    for minute in range(0, 6000, 20):
        rows = pd.DataFrame({"alert_id": [f"a{minute}", f"b{minute}"], "event": ["E", "F"], "cycle_us": [minute * 60_000_000] * 2, "feed_pos": [0, 1], "delivered": [True, True]})
        assert list(next(iter(p.handleInputRows(("s",), iter([rows]), None)))["outcome"]) == ["sent", "sent"]
    assert len(p.seen) <= 2 * 3 * 50 and len(p.hours) <= 50 and len(p.noted) <= 150


@pytest.mark.parametrize("inline", [1000, 8])
def test_state_is_called_by_batch_and_not_by_id(monkeypatch, inline):
    import pandas as pd

    calls = []
    counted = lambda kind, name: lambda *a: (calls.append(name), getattr(kind, name)(*a))[1]
    spied = lambda kind, *names: type("Spy", (kind,), {n: counted(kind, n) for n in names})
    handle = Handle()
    handle.getMapState = lambda *a: spied(MapState, "containsKey", "removeKey", "updateValue", "getValue", "iterator")()
    handle.getValueState = lambda *a: spied(ValueState, "exists", "get", "update")()
    monkeypatch.setattr(stateful.SuppressionProcessor, "INLINE", inline)
    monkeypatch.setattr(stateful.SuppressionProcessor, "BUCKETS", 16)
    policy = suppression.Policy(cap_seconds=3600, cool_off_seconds=600)
    p, whole, rng, got, want = stateful.SuppressionProcessor(policy), suppression.ScopeState(), np.random.default_rng(3), [], []
    p.init(handle)
    for hours in range(0, 400, 8):
        at = np.sort(rng.integers(hours * 60, (hours + 8) * 60, 200)) * 60_000_000
        rows = pd.DataFrame({"alert_id": [f"a{n}" for n in rng.integers(0, 900, 200)], "event": rng.choice(["E", "F", "G"], 200), "cycle_us": at, "feed_pos": np.arange(200), "delivered": rng.random(200) < 0.8})
        before = len(calls)
        made = next(iter(p.handleInputRows(("s",), iter([rows]), None)))
        got += list(zip(made["cycle_us"].tolist(), made["feed_pos"].tolist(), made["outcome"]))
        assert len(calls) - before <= (2 if inline == 1000 else 150)
        for r in rows.itertuples():
            whole.enter(r.cycle_us, policy)
            outcome = whole.decide(r.alert_id, r.event, r.cycle_us, r.delivered, policy)
            want += [(r.cycle_us, r.feed_pos, outcome)] if outcome else []
    assert got == want and len(p.seen) <= 16 and len(p.hours) <= 50
    assert bool(p.seen) == (inline == 8)


def test_frame_stream_from_pictures(spark, tmp_path):
    scale = [(x, 10 * x, 255 - 10 * x, 5 * x) for x in range(25)]
    pal = spark.createDataFrame([(x, r, g, b, -20 + 90 * x / 25) for x, r, g, b in scale], "x int, r int, g int, b int, value double")
    rng = np.random.default_rng(1)
    picks = rng.integers(0, 25, (8, 12))
    array = np.array([scale[x][1:] for x in picks.ravel()]).reshape(8, 12, 3)
    put(tmp_path, "in/radar_base_reflectivity_7.png", png(array))
    put(tmp_path, "in/notes_8.png", png(array))
    put(tmp_path, "in/radar_base_velocity_9.png", png(array)[:60])
    stream = live_frames.stream_frames(spark, str(tmp_path / "in"))
    handle = live_frames.convert_batch({"reflectivity": pal, "velocity": pal}, str(tmp_path / "grids"), str(tmp_path / "log"), sample_rate=2, min_bytes=10)
    live.start(stream, str(tmp_path / "cp"), batch=handle).awaitTermination()
    grid = spark.read.parquet(str(tmp_path / "grids")).collect()
    assert len(grid) == 1
    assert np.allclose(grid[0].data, np.round(-20 + 90 * picks[::2, ::2] / 25, 2)) and grid[0].metadata.sampled_dimensions.width == 6
    log = spark.read.parquet(str(tmp_path / "log")).collect()
    assert sorted((r.filename, r.success, r.error) for r in log) == [("radar_base_reflectivity_7.png", True, None), ("radar_base_velocity_9.png", False, "not a readable picture")]


def test_two_writers_leave_each_event_once(spark, tmp_path, monkeypatch):
    rows = lambda *ids: spark.createDataFrame([(i, w) for i, w in ids], "event_id string, w string")
    path = str(tmp_path / "t")
    mine = log.TransactionLog(spark, path)
    plain, raced = log.TransactionLog.try_commit, []

    def late(self, number, add, remove, schema=None):
        if not raced:  # another writer commits between our snapshot and our commit
            raced.append(number)
            log.TransactionLog(spark, path).append_new(rows(("b", "other"), ("c", "other")), "event_id")
        return plain(self, number, add, remove, schema)

    monkeypatch.setattr(log.TransactionLog, "try_commit", late)
    mine.append_new(rows(("a", "me"), ("b", "me"), ("d", "me"), ("d", "me2")), "event_id")
    assert sorted((r.event_id, r.w) for r in mine.read().collect()) == [("a", "me"), ("b", "other"), ("c", "other"), ("d", "me"), ("d", "me2")]
    assert mine.snapshot()[0] == 2 and not plain(mine, 2, {"x": None}, []) and mine.vacuum() == 0


def test_log_reads_snapshots_replaces_and_compacts(spark, tmp_path):
    table = log.TransactionLog(spark, str(tmp_path / "t"))
    assert table.read() is None and table.snapshot() == (0, {}) and table.compact("k") == 0
    opened = []
    for run in range(12):
        opened.append(len(table.append_new(spark.range(run * 100, run * 100 + 100).select(F.col("id").alias("k"), F.lit(run).alias("run")), "k")))
    assert sum(opened) <= 2  # new keys open hardly any earlier run, however many there are
    again = spark.range(0, 1200).select(F.col("id").alias("k"), F.lit(99).alias("run"))
    assert len(table.append_new(again, "k")) == 12 and table.read().count() == 1200 and table.snapshot()[0] == 12
    before = table.read()
    assert table.compact("k") == 12 and table.read().count() == 1200 == before.count() and len(table.snapshot()[1]) == 1
    assert len(table.append_new(spark.range(500, 501).select(F.col("id").alias("k"), F.lit(1).alias("run")), "k")) == 1 and table.vacuum() >= 12
    table.replace(spark.range(3).select(F.col("id").alias("k"), F.lit(0).alias("run")))
    assert table.read().count() == 3
    (tmp_path / "t/_log" / f"{table.snapshot()[0] + 1:020d}.json").write_text('{"add": {"data-x"')  # a writer died in its commit
    assert table.read().count() == 3
    table.append_new(spark.range(5).select(F.col("id").alias("k"), F.lit(1).alias("run")), "k")
    assert sorted(r.k for r in table.read().collect()) == [0, 1, 2, 3, 4]


def test_key_filters_never_deny_a_key(spark):
    keys = spark.range(5000).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("k"))
    summary = log.summary_of(keys, "k")
    bits = log.filter_bits(summary)
    places = lambda df: log.bit_places(np.array([r.h for r in log._hashed(df, "k").collect()]), len(bits))
    assert bits[places(keys)].all() and summary["rows"] == 5000 and len(bits) == summary["bits"]
    others = spark.range(5000, 10000).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("k"))
    assert bits[places(others)].all(axis=1).mean() < 0.02


def test_settled_files_come_once_in_bounded_batches(spark, tmp_path):
    put(tmp_path, "in/x_other.txt", b"no")
    for n in range(7):
        put(tmp_path, f"in/x_{n}.png", b"p" * n)
        os.utime(tmp_path / f"in/x_{n}.png", (1000 + 10 * (n // 2), 1000 + 10 * (n // 2)))
    seen = []
    note = lambda batch, n: seen.append([r.path.rsplit("/", 1)[1] for r in batch.orderBy("modificationTime", "path").collect()])
    read = lambda as_of: settled.stream_settled(spark, str(tmp_path / "in"), str(tmp_path / "cp"), ["x_*.png"], 600, 3, as_of)
    live.drain(read(1600), str(tmp_path / "cp"), note)
    assert [s for s in seen if s] == []  # the oldest is just 600 seconds old: not settled
    live.drain(read(1621), str(tmp_path / "cp"), note)
    assert [s for s in seen if s] == [["x_0.png", "x_1.png", "x_2.png"], ["x_3.png", "x_4.png", "x_5.png"]]
    put(tmp_path, "in/x_7.png", b"late")
    os.utime(tmp_path / "in/x_7.png", (1100, 1100))
    live.drain(read(9999), str(tmp_path / "cp"), note)  # after a restart it goes on where it was
    assert [s for s in seen if s][2:] == [["x_6.png", "x_7.png"]]


def test_frame_cycle_removes_only_verified_sources(spark, tmp_path):
    pal = spark.createDataFrame([(x, 10 * x, 255 - 10 * x, 5 * x, -20 + 90 * x / 25) for x in range(25)], "x int, r int, g int, b int, value double")
    array = np.zeros((8, 12, 3), dtype=np.uint8) + np.array([10, 245, 5], dtype=np.uint8)
    names = {"radar_base_reflectivity_1.png": png(array), "radar_base_velocity_2.png": png(array), "radar_base_velocity_3.png": png(array)[:-40], "radar_base_velocity_4.png": b"no picture" * 50, "notes_5.png": png(array)}
    for name, data in names.items():
        put(tmp_path, f"in/day1/{name}", data)
        os.utime(tmp_path / "in/day1" / name, (1000, 1000))
    put(tmp_path, "in/day1/radar_base_velocity_6.png", png(array))  # still being written
    handle = settled.frame_cycle({"reflectivity": pal, "velocity": pal}, str(tmp_path / "grids"), str(tmp_path / "log"), str(tmp_path / "old"), str(tmp_path / "in"), sample_rate=2, min_bytes=10)
    for _ in range(2):
        stream = settled.stream_settled(spark, str(tmp_path / "in/day1"), str(tmp_path / "cp"), ["radar_base_reflectivity_*.png", "radar_base_velocity_*.png"])
        live.drain(stream, str(tmp_path / "cp"), handle)
    assert sorted(os.listdir(tmp_path / "in/day1")) == ["notes_5.png", "radar_base_velocity_3.png", "radar_base_velocity_4.png", "radar_base_velocity_6.png"]
    assert sorted(os.listdir(tmp_path / "old/day1")) == ["radar_base_reflectivity_1.png", "radar_base_velocity_2.png"]
    log = {r.filename: (r.success, r.error) for r in spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "log")).collect()}
    assert log == {
        "radar_base_reflectivity_1.png": (True, None), "radar_base_velocity_2.png": (True, None), "radar_base_velocity_3.png": (False, "not a readable picture"),
        "radar_base_velocity_4.png": (False, "not a png"),
    }
    assert spark.read.parquet(str(tmp_path / "grids")).count() == 2


def test_many_files_go_in_tasks(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for n in range(3000):
        (tmp_path / "many" / f"{n}.png").touch()
    listed = spark.range(3000).select(F.concat(F.lit(f"file:{tmp_path}/many/"), F.col("id").cast("string"), F.lit(".png")).alias("path"))
    assert settled.remove_files(listed, archive=str(tmp_path / "old"), root=f"file://{tmp_path}") == 3000
    assert len(os.listdir(tmp_path / "old/many")) == 3000 and settled.remove_files(listed) == 0


def test_worker_code_needs_no_installed_package(tmp_path):
    """Processors and batch functions unpickle in a process that cannot import the package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    path = tmp_path / "f.pkl"
    path.write_bytes(cloudpickle.dumps((stateful.SuppressionProcessor(), stateful.EdgeProcessor(), suppression.ScopeState(), stateful.PendingProcessor())))
    code = f"import pickle; s = pickle.load(open({str(path)!r}, 'rb'))[2]; print(s.decide('a', 'e', 1, True, __import__('types').SimpleNamespace(cycle_cap=5, cap_seconds=1, cool_off_seconds=1, bypass=())))"
    done = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == "sent", done.stderr
