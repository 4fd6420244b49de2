"""Queries of scans and sinks, on documents and files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustfront.catalog.dataset import MANIFEST_SQL, manifest_rows
from gustfront.catalog.operations import as_of
from gustfront.catalog.raster import FOUND
from gustfront.catalog.registry import query, rnd, sql_rnd, sql_stamp, stamp
from gustfront.operators import palette, service
from gustfront.schemas import ALERT_COLLECTION, OBSERVATION, SERVICE_STATUS, STATION_COLLECTION
from gustfront.session import dealt, materialise, parts_of, scratch_path
from gustfront.sinks import tables
from gustfront.sources import feeds, frames, reports

REPORTS = f"""parsed as (select report_id, subtype, try_cast(yr as int) as y, try_strptime(date || ' ' || time, '%Y-%m-%d %H:%M:%S') as event_ts, try_cast(slat as double) as lat, try_cast(slon as double) as lon,
  case when mag = '' then -9 else cast(trunc(try_cast(mag as double)) as int) end as mag, upper(trim(st)) as st from {{raw_reports}}),
 good as (select * from parsed where event_ts is not null and lat is not null and lon is not null and mag is not null and lat <> 0 and lon <> 0)"""


@query(
    "s01_report_scan",
    f"with {REPORTS} select report_id, {sql_stamp('event_ts')} as event_ts, {sql_rnd('lat')} as lat, {sql_rnd('lon')} as lon, mag, st, 'tornado' as label from good where y in (2024, 2025) and mag >= 1 and subtype = 'tornado'",
)
def _(i):
    got = reports.parse_reports(i.raw_reports.where("subtype = 'tornado'"), [2024, 2025], "tornado", "tornado", 1)
    return got.select("report_id", stamp("event_ts").alias("event_ts"), rnd("lat").alias("lat"), rnd("lon").alias("lon"), "mag", "st", "label")


@query(
    "s02_yearly_report_files",
    f"with {REPORTS} select subtype, y as year, count(*) as n, {sql_rnd('sum(lat)', 4)} as lat_sum, cast(sum(mag) as bigint) as mag_sum from good where y in (2023, 2025) and subtype in ('hail', 'wind') group by 1, 2",
)
def _(i):
    # one CSV per year and kind lands in a folder; 2024 is not asked for and 2022 has no file
    folder = scratch_path(i.spark, "reports")
    kept = i.raw_reports.where("subtype in ('hail', 'wind')").drop("report_id")
    for year in (2023, 2024, 2025):
        for kind in ("hail", "wind"):
            rows = kept.where((F.col("yr") == str(year)) & (F.col("subtype") == kind)).drop("subtype")
            rows.write.option("header", True).option("emptyValue", "").csv(f"{folder}/{year}_{kind}.csv")
    read = lambda kind: reports.read_yearly_reports(i.spark, folder, kind, [2022, 2023, 2025])
    both = read("hail").unionByName(read("wind"))
    return both.groupBy("subtype", F.col("file_year").alias("year")).agg(F.count("*").alias("n"), rnd(F.sum("lat"), 4).alias("lat_sum"), F.sum("mag").cast("long").alias("mag_sum"))


@query(
    "s03_listing_scrape",
    f"select distinct station, product, {sql_stamp("date_trunc('minute', scan_ts)")} as scan_ts, substring(station, 2, 4) || '_' || product || '_' || strftime(scan_ts, '%Y%m%d%H%M') || '.png' as file from {{scans}}",
)
def _(i):
    return reports.parse_listings(i.listing_pages).withColumn("scan_ts", stamp("scan_ts"))


@query("s04_station_scan", "select 'K' || cast(s_suppkey as string) as station, lat + 10 as lat, lon + 20 as lon from (select s_suppkey, 24.5e0 + (s_suppkey * 7919 % 2500) / 1e2 as lat, -124.5e0 + (s_suppkey * 104729 % 5800) / 1e2 as lon from {supplier}) t where lat + 10 > 24 and lat + 10 < 50 and lon + 20 > -125 and lon + 20 < -66")
def _(i):
    at = F.array(-124.5 + (F.col("s_suppkey") * 104729 % 5800) / 1e2 + 20, 24.5 + (F.col("s_suppkey") * 7919 % 2500) / 1e2 + 10)
    feature = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.struct(at.alias("coordinates")).alias("geometry"))
    text = i.supplier.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("body"))
    return reports.parse_stations(feeds.from_text(text, STATION_COLLECTION).select("doc.*"))


@query(
    "s05_warning_polygons",
    f"""with p as (select * from {{warning_vertices}} where phenom = 'TO' and sig = 'W' and gtype = 'P'), r as (select wfo, etn, record_id, avg(lon) as lon, avg(lat) as lat, max(issued) as issued from p group by 1, 2, 3),
    f as (select *, row_number() over (partition by wfo, etn order by record_id) as n from r)
    select record_id, wfo as st, etn, {sql_rnd('lat')} as lat, {sql_rnd('lon')} as lon, {sql_stamp("strptime(issued, '%Y%m%d%H%M')")} as event_ts from f where n = 1 and length(issued) = 12""",
)
def _(i):
    got = reports.warning_events(i.warning_vertices)
    return got.select("record_id", "st", "etn", rnd("lat").alias("lat"), rnd("lon").alias("lon"), stamp("event_ts").alias("event_ts"))


@query("s06_manifest_ids_from_lines", "select distinct 'urn:' || cast(event_id % 3000 as string) as event_id from {events} where event_id % 50 <> 0")
def _(i):
    # every seventh line is cut off after the class; every fiftieth has no id
    key = F.when(F.col("event_id") % 50 == 0, "").otherwise(F.concat(F.lit("urn:"), (F.col("event_id") % 3000).cast("string")))
    whole = F.concat_ws(",", key, F.lit("1"), F.lit("tornado"), F.lit("tornado"), F.lit("K0001"), F.lit("2"), F.lit("33.0"), F.lit("-97.0"), F.lit("4.2"), F.lit("2024-01-01"), F.lit("t"), F.lit("a.png"), F.lit(""))
    lines = i.events.select(F.when(F.col("event_id") % 7 == 0, F.substring_index(whole, ",", 3)).otherwise(whole).alias("line"))
    return reports.committed_ids(lines)


# a page's bytes stand for the picture; every seventh is a stub of one byte
_BODY = "case when page_id % 7 = 0 then 'x' else html end"


@query("s07_valid_frames", f"select page_id, octet_length(encode({_BODY})) + 4 as length from {{pages}} where page_id % 3 <> 0 and octet_length(encode({_BODY})) + 4 > 200")
def _(i):
    head = F.when(F.col("page_id") % 3 == 0, F.lit(bytearray(b"GIF8"))).otherwise(F.lit(bytearray(b"\x89PNG")))
    files = i.pages.select("page_id", F.concat(head, F.encode(F.expr(_BODY), "utf-8")).alias("content")).withColumn("length", F.octet_length("content"))
    return frames.valid_frames(files).select("page_id", F.col("length").cast("long").alias("length"))


@query("s08_world_files", f"select s_suppkey, {sql_rnd('s_suppkey / 1e3')} as a, {sql_rnd('-s_suppkey / 1e3')} as e, -97.5e0 as c, 35e0 + s_suppkey as f from {{supplier}} where s_suppkey % 9 <> 0")
def _(i):
    k = F.col("s_suppkey")
    parts = F.concat_ws("\n", (k / 1e3).cast("string"), F.lit("0.0"), F.lit("0.0"), (-k / 1e3).cast("string"), F.lit("-97.5"), (k + 35).cast("string"))
    text = i.supplier.select("s_suppkey", F.when(k % 9 == 0, "not a world file").otherwise(parts).alias("value"))
    return frames.parse_world(text).select("s_suppkey", rnd("a").alias("a"), rnd("e").alias("e"), "c", "f")


@query(
    "s09_alert_feed",
    f"select feed_pos as poll, cast(k as int) as feed_pos, alert_id || '/' || cast(k as string) as alert_id, event, {sql_stamp('expires')} as expires from {{alerts}}, (select unnest([0, 1]) as k) x where feed_pos % 10 <> 0",
)
def _(i):
    # one poll per row with two alerts; every tenth poll has no features
    item = lambda k: F.struct(F.struct(F.concat("alert_id", F.lit(f"/{k}")).alias("id"), "event", F.date_format("expires", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("expires")).alias("properties"))
    features = F.when(F.col("feed_pos") % 10 != 0, F.array(item(0), item(1)))
    polls = i.alerts.select(F.col("feed_pos").alias("poll"), F.to_json(F.struct(features.alias("features"))).alias("body"))
    parsed = feeds.from_text(polls, ALERT_COLLECTION)
    got = feeds.explode_alerts(parsed.select("poll", "doc.features"), keep=["poll"])
    return got.select("poll", "feed_pos", "alert_id", "event", stamp("expires").alias("expires"))


@query(
    "s10_observation_scan",
    f"select obs_id, {sql_stamp('obs_ts')} as obs_ts, station, {sql_rnd('temp_c')} as temp_c, {sql_rnd('humidity')} as humidity, wind_deg, {sql_rnd('pressure_pa')} as pressure_pa, conditions from {{observations}}",
)
def _(i):
    reading = lambda c: F.struct(F.col(c).alias("value"))
    properties = F.struct(
        F.date_format("obs_ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"), F.concat(F.lit("https://stations/"), "station").alias("station"), reading("temp_c").alias("temperature"),
        reading("humidity").alias("relativeHumidity"), reading("wind_deg").alias("windDirection"), reading("pressure_pa").alias("barometricPressure"), F.col("conditions").alias("textDescription"),
    )
    text = i.observations.select("obs_id", F.to_json(F.struct(properties.alias("properties"))).alias("body"))
    got = feeds.from_text(text, OBSERVATION).select("obs_id", *feeds.observation_columns())
    return got.select("obs_id", stamp("obs_ts").alias("obs_ts"), "station", rnd("temp_c").alias("temp_c"), rnd("humidity").alias("humidity"), "wind_deg", rnd("pressure_pa").alias("pressure_pa"), "conditions")


@query(
    "s11_capture_folder",
    f"select file_id, {sql_stamp('done_ts')} as modified from {{conversions}} where (filename like 'radar_base_reflectivity_%.png' or filename like 'radar_base_velocity_%.png') and done_ts < timestamp '2024-01-31 12:00:00' - interval '1200' second",
)
def _(i):
    files = i.conversions.select("file_id", F.concat(F.lit("/input/"), "filename").alias("path"), F.col("done_ts").alias("modificationTime"))
    return frames.settled_frames(files, as_of(), 1200).select("file_id", stamp("modificationTime").alias("modified"))


@query("s12_frames_without_scales", "select file_id from {conversions} where file_id % 6 <> 0")
def _(i):
    tag = F.when(F.col("file_id") % 6 == 0, "base_intensity_scale_").otherwise("")
    files = i.conversions.select("file_id", F.concat(F.lit("/archive/intensity_scale/"), tag, "filename").alias("path"))
    return frames.without_scales(files).select("file_id")


def grid_text(i):
    """Grid documents as JSON text, with every kind of defect among them."""
    data = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.slice("embedding", r * 8 + 1, F.lit(8)), lambda v: F.rint(v.cast("double") * 1e3) / 1e3))
    n = F.col("vec_id") % 10
    kind = F.when(n == 1, "infrared").when(n % 2 == 0, "reflectivity").otherwise("velocity")
    units = F.when(n != 2, "dBZ")
    meta = F.struct(kind.alias("radar_type"), units.alias("units"), F.struct(F.lit(-20.0).alias("min"), F.lit(70.0).alias("max")).alias("value_range"))
    whole = F.to_json(F.struct(meta.alias("metadata"), data.alias("data")))
    body = F.when(n == 3, "{broken").when(n == 4, F.to_json(F.struct(data.alias("data")))).when(n == 5, F.to_json(F.struct(meta.alias("metadata"), F.array().cast("array<array<double>>").alias("data")))).when(
        n == 6, F.to_json(F.struct(meta.alias("metadata"), F.slice("embedding", 1, 8).alias("data")))
    ).otherwise(whole)
    return i.embeddings.select("vec_id", body.alias("body"))


@query(
    "h25_grid_validation",
    """select vec_id, case vec_id % 10 when 1 then 'invalid radar_type' when 2 then 'missing required metadata field: units' when 3 then 'output too small' when 4 then 'missing required field: metadata'
      when 5 then 'data is empty' when 6 then 'data must be a list of lists' else 'valid' end as problem from {embeddings}""",
)
def _(i):
    return frames.parse_grids(grid_text(i)).select("vec_id", frames.grid_problem(50).alias("problem"))


@query("s13_grid_scan", f"select vec_id as scan_id, cast(floor(pos / 8) as int) as row_no, cast(pos % 8 as int) as col_no, round_even(v * 1e3, 0) / 1e3 as value from {{exploded}} where vec_id % 10 not in (1, 2, 3, 4, 5, 6)")
def _(i):
    good = frames.parse_grids(grid_text(i)).where(frames.grid_problem(50) == "valid")
    return frames.grid_cells(good, "vec_id")


@query("s14_status_documents", "select service_id, 'running' as status, total as total_processed from {service_status} where service_id % 5 <> 0")
def _(i):
    body = F.to_json(F.struct(F.lit("running").alias("status"), F.col("total").alias("total_processed")))
    text = i.service_status.select("service_id", F.when(F.col("service_id") % 5 == 0, F.substring(body, 1, 20)).otherwise(body).alias("body"))
    return feeds.readable(text, SERVICE_STATUS).select("service_id", "doc.status", "doc.total_processed")


# --- sinks: write, read back, compare -------------------------------------------------------------


@query("k01_committed_append", MANIFEST_SQL)
def _(i):
    path = scratch_path(i.spark, "manifest")
    rows = materialise(manifest_rows(i), "manifest-rows")  # three runs deliver the same rows
    half = rows.where(F.crc32("event_id") % 2 == 0)
    for part in (half, rows, rows):  # a broken-off run, its resumption, and a run with nothing to do
        tables.append_events(part, path, partition="class")
    return tables.read_events(i.spark, path).select(*rows.columns)


@query("k02_grid_sink", f"with {FOUND} select scan_id, 'reflectivity' as radar_type, count(*) as cells, {sql_rnd('sum(round_even(value * 100, 0) / 1e2)', 4)} as total from found group by 1")
def _(i):
    path = scratch_path(i.spark, "grids")
    # lines lie by scan before they are grouped to pixels, so grouping, lookup and assembly share one exchange
    parts = parts_of(i.lineitem)
    pixels = i.over("pixels", lineitem=dealt(i.lineitem, "l_orderkey", parts))
    cells = palette.convert_frames(pixels, i.palette)
    tables.write_grids(tables.grid_documents(cells, "reflectivity", 1, parts=parts), path)
    back = i.spark.read.parquet(path)
    values = F.flatten("data")
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return back.select("scan_id", "radar_type", F.size(values).cast("long").alias("cells"), rnd(total, 4).alias("total"))


@query("k03_tensor_sink", f"select vec_id as scan_id, label, len(embedding) as size, {sql_rnd('list_sum(embedding)', 4)} as total from {{embeddings}}")
def _(i):
    path = scratch_path(i.spark, "tensors")
    rows = i.embeddings.select(F.col("vec_id").alias("scan_id"), F.concat(F.lit("tensors/"), F.col("vec_id").cast("string"), F.lit(".npy")).alias("tensor_name"), "label", F.col("embedding").alias("tensor"))
    tables.write_tensors(rows.where("scan_id % 3 = 0"), path)
    tables.write_tensors(rows, path)
    total = F.aggregate("tensor", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return tables.read_events(i.spark, path).select("scan_id", "label", F.size("tensor").alias("size"), rnd(total, 4).alias("total"))


@query("k04_versioned_snapshot", "select service_id, total + 1 as total from {service_status} where service_id % 2 = 0")
def _(i):
    path = scratch_path(i.spark, "status")
    tables.write_snapshot(i.service_status.select("service_id", "total"), path, 1)
    tables.write_snapshot(i.service_status.where("service_id % 2 = 0").select("service_id", (F.col("total") + 1).alias("total")), path, 2)
    return tables.read_snapshot(i.spark, path)


@query("k05_ledger_retention", f"select alert_id, {sql_stamp('sent_at')} as sent_at, outcome from {{ledger}} where sent_at >= (select max(sent_at) - interval '48' hour from {{ledger}})")
def _(i):
    path = scratch_path(i.spark, "ledger")
    now = i.ledger.select(F.max("sent_at")).scalar()
    tables.save_ledger(i.ledger, path, now)
    tables.save_ledger(i.ledger, path, now)  # rewriting the same dates changes nothing
    return tables.load_ledger(i.spark, path).select("alert_id", stamp("sent_at").alias("sent_at"), "outcome")


@query("k05_ledger_after_72_hours", f"select alert_id, {sql_stamp("sent_at + interval '72' hour")} as sent_at from {{ledger}} where sent_at >= (select max(sent_at) - interval '48' hour from {{ledger}})")
def _(i):
    path = scratch_path(i.spark, "ledger")
    now = i.ledger.select(F.max("sent_at")).scalar()
    later = i.ledger.withColumn("sent_at", F.col("sent_at") + F.expr("interval 72 hours"))
    tables.save_ledger(i.ledger, path, now)
    tables.save_ledger(i.ledger.unionByName(later), path, now + F.expr("interval 72 hours"))  # all that was there has expired
    return tables.load_ledger(i.spark, path).select("alert_id", stamp("sent_at").alias("sent_at"))


@query("k06_training_export", "select row_number() over (order by label, vec_id) - 1 as id, vec_id, label from {embeddings}")
def _(i):
    path = scratch_path(i.spark, "training")
    tables.write_training_set(i.embeddings.select("label", "vec_id", F.col("embedding").alias("data")), path, ["label"], "vec_id")
    return i.spark.read.parquet(path).select("id", "vec_id", "label")


@query("k07_text_reports", "select station as region, cast(obs_ts as date)::string as cycle, count(*) as lines, md5(string_agg('Observation ' || cast(obs_id as string) || ' of ' || station, '|' order by obs_id)) as text from {observations} group by 1, 2")
def _(i):
    path = scratch_path(i.spark, "text")
    line = F.concat(F.lit("Observation "), F.col("obs_id").cast("string"), F.lit(" of "), "station")
    rows = i.observations.select(F.col("station").alias("region"), F.date_format("obs_ts", "yyyy-MM-dd").alias("cycle"), line.alias("report"))
    tables.write_reports(rows, path, "region", "cycle")
    back = i.spark.read.text(path).select("region", F.col("cycle").cast("string").alias("cycle"), "value", F.split("value", " ")[1].cast("long").alias("n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda e: e["value"])
    return back.groupBy("region", "cycle").agg(F.count("*").alias("lines"), F.md5(F.array_join(lines, "|")).alias("text"))


@query("k08_batch_summary", f"select file_id % 7 as host, count(*) as total_images, {sql_rnd('sum(secs)')} as total_time, {sql_rnd('avg(secs)')} as avg_time from {{conversions}} group by 1")
def _(i):
    path = scratch_path(i.spark, "summary")
    tables.write_summary(service.batch_summary(i.conversions.withColumn("host", F.col("file_id") % 7), ["host"]), path)
    back = i.spark.read.schema("host long, total_images long, total_time double, avg_time double").json(path)
    return back.select("host", "total_images", rnd("total_time").alias("total_time"), rnd("avg_time").alias("avg_time"))


@query("k09_deletable_sources", "select vec_id from {embeddings} where vec_id % 10 not in (1, 2, 3, 4, 5, 6)")
def _(i):
    checked = frames.parse_grids(grid_text(i)).select(F.col("vec_id").alias("stem"), frames.grid_problem(50).alias("problem"))
    return tables.deletable_sources(i.embeddings.select(F.col("vec_id").alias("stem")), checked).select(F.col("stem").alias("vec_id"))


@query(
    "h27_model_gate",
    """select doc_id, case when doc_id % 11 = 0 then 'missing key' when doc_id % 7 = 0 then 'version mismatch' when doc_id % 5 = 0 and doc_id % 2 = 0 then 'fingerprint mismatch' else 'ok' end as gate from {documents}""",
)
def _(i):
    from gustfront.operators.gate import model_gate

    k, real = F.col("doc_id"), F.sha2("text", 256)
    models = i.documents.select("doc_id", F.encode("text", "utf-8").alias("content"))
    manifests = i.documents.select(
        "doc_id", F.when(k % 5 == 0, "stale").otherwise(real).alias("model_sha256"), F.when(k % 7 == 0, "0.9").otherwise("1.0").alias("preprocess_version"),
        F.when(k % 11 != 0, 0.8).alias("threshold_recommended"), F.when((k % 5 == 0) & (k % 2 != 0), real).alias("override"),
    )
    return model_gate(models, manifests, "doc_id").select("doc_id", "gate")
