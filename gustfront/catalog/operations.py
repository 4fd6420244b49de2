"""Queries of service rollups, timelines, reports and health."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gustfront.catalog.registry import query, rnd, sql_rnd, sql_stamp, stamp
from gustfront.functions import health, numbers, text
from gustfront.operators import service, timeline

AS_OF = "timestamp '2024-01-31 12:00:00'"


def as_of():
    return F.lit("2024-01-31 12:00:00").cast("timestamp")


@query(
    "a22_collection_report",
    """with m as (select o.o_orderkey % 2000 as event_id, o.o_orderkey % 2000 % 3 as label, case when l_linenumber % 3 = 0 then '' else 'v' end as vel from {orders} o join {lineitem} l on l.l_orderkey = o.o_orderkey)
    select count(*) as scans, cast(count_if(label = 1) as bigint) as positive, cast(count_if(label <> 1) as bigint) as negative, cast(count_if(vel <> '') as bigint) as with_velocity, count(distinct event_id) as events from m""",
)
def _(i):
    joined = i.lineitem.join(i.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    event = F.col("o_orderkey") % 2000
    return service.collection_report(joined.select(event.alias("event_id"), (event % 3).alias("label"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise("v").alias("vel")))


@query(
    "a24_folder_stats",
    "select page_id % 10 as folder, count(*) as files, round_even(sum(octet_length(encode(html))) / 1048576e0 * 100, 0) / 1e2 as size_mb from {pages} group by 1",
)
def _(i):
    files = i.pages.select((F.col("page_id") % 10).alias("folder"), F.octet_length("html").cast("long").alias("length"))
    return service.folder_stats(files, ["folder"])


@query(
    "a31_batch_progress",
    """with f as (select count_if(success) as p, count_if(not success) as e, 12000 as t, (epoch_us(timestamp '2024-01-31 12:00:00') - epoch_us(timestamp '2024-01-01 00:00:00')) / 1e6 as s from {conversions})
    select cast(t as bigint) as total, cast(p as bigint) as processed, cast(e as bigint) as errors, round_even((p + e) * 100e0 / t, 1) as percent, round_even(s / 60, 1) as elapsed_min, round_even(p / s * 60, 1) as rate_per_min,
      round_even((t - p - e) / (p / s) / 60, 1) as eta_min from f""",
)
def _(i):
    return service.batch_progress(i.conversions, 12000, F.lit("2024-01-01 00:00:00").cast("timestamp"), as_of())


@query(
    "a32_in_flight_progress",
    """select file_id % 400 as worker, count(*) as images, cast(round_even(avg(out_bytes % 101), 0) as bigint) as progress_percent, case when count(*) = 1 then min(filename) else cast(count(*) as string) || ' images' end as current_image
    from {conversions} where file_id % 3 = 0 group by 1""",
)
def _(i):
    work = i.conversions.where("file_id % 3 = 0").select((F.col("file_id") % 400).alias("worker"), "filename", (F.col("out_bytes") % 101).alias("progress"))
    return service.in_flight(work, ["worker"])


@query(
    "a33_throughput",
    f"""with f as (select file_id % 7 as host, count(*) as images, sum(secs) as total_secs, cast(sum(out_bytes * 30) as bigint) as pixels from {{conversions}} where success group by 1)
    select host, images, {sql_rnd('total_secs')} as total_secs, {sql_rnd('total_secs / images')} as secs_per_image, {sql_rnd('pixels / 4e4')} as expected_secs, {sql_rnd('pixels / total_secs')} as pixels_per_second, {sql_rnd('3600e0 * images / total_secs')} as images_per_hour,
      case when total_secs > pixels / 4e4 * 3 then 'extremely slow' when total_secs > pixels / 4e4 * 1.5 then 'slower than expected' else 'normal' end as verdict from f""",
)
def _(i):
    log = i.conversions.select((F.col("file_id") % 7).alias("host"), "secs", (F.col("out_bytes") * 30).alias("pixels"), "success")
    got = service.throughput(log, ["host"])
    return got.select("host", "images", "verdict", *[rnd(c).alias(c) for c in ("total_secs", "secs_per_image", "expected_secs", "pixels_per_second", "images_per_hour")])


@query(
    "a33_stage_timing",
    f"select file_id % 7 as host, {sql_rnd('avg(secs * 0.1e0)')} as avg_init, {sql_rnd('avg(secs * 0.7e0)')} as avg_conversion, {sql_rnd('avg(secs * 0.1e0 + secs * 0.7e0)')} as avg_total from {{conversions}} group by 1",
)
def _(i):
    log = i.conversions.select((F.col("file_id") % 7).alias("host"), F.struct((F.col("secs") * 0.1).alias("init"), (F.col("secs") * 0.7).alias("conversion")).alias("timing"))
    got = service.stage_timing(log, ["init", "conversion"], ["host"])
    return got.select("host", *[rnd(c).alias(c) for c in ("avg_init", "avg_conversion", "avg_total")])


@query(
    "a34_pipeline_overview",
    """with f as (select coalesce(sum(case when service_id % 3 = 0 then total end), 0) as c, coalesce(sum(case when service_id % 3 = 1 then total end), 0) as p, coalesce(sum(case when service_id % 3 < 2 then errors end), 0) as e from {service_status})
    select cast(case when c = 0 then p else c end as bigint) as captured, cast(p as bigint) as processed, cast(e as bigint) as errors, case when e > 5 then 'red' else 'amber' end as error_level from f""",
)
def _(i):
    kind = F.col("service_id") % 3
    return service.pipeline_overview(i.service_status, kind == 0, kind == 1)


@query(
    "w06_keep_last_errors",
    f"select user_id, event_id, {sql_stamp('ts')} as ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from {{events}} where event_type = 'error') t where n <= 5",
)
def _(i):
    got = timeline.keep_last(i.events.where("event_type = 'error'"), ["user_id"], ["ts", "event_id"], 5)
    return got.select("user_id", "event_id", stamp("ts").alias("ts"))


@query("w07_first_record_per_warning", "select wfo, etn, record_id, seq from (select *, row_number() over (partition by wfo, etn order by record_id, seq) as n from {warning_vertices}) t where n = 1")
def _(i):
    return timeline.first_per_key(i.warning_vertices, ["wfo", "etn"], ["record_id", "seq"]).select("wfo", "etn", "record_id", "seq")


@query(
    "w08_health_transitions",
    f"""with h as (select event_id, user_id, ts, case when event_type in ('view', 'click') then 200 when event_type = 'error' then 503 else 500 end as code, event_id % 2 = 0 as up from {{events}}),
    l as (select *, lag(code = 200) over (partition by user_id order by ts, event_id) as before from h)
    select event_id, user_id, {sql_stamp('ts')} as ts, case when code = 200 then 'RECOVERED' when code = 503 then 'STALE' when not up then 'DOWN' else 'ERROR' end as notice from l where (code = 200) <> coalesce(before, true)""",
)
def _(i):
    code = F.when(F.col("event_type").isin("view", "click"), 200).when(F.col("event_type") == "error", 503).otherwise(500)
    samples = i.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), code.alias("code"), (F.col("event_id") % 2 == 0).alias("up"))
    got = timeline.health_transitions(samples, ["user_id"], "ts", "event_id", "code", "up")
    return got.select("event_id", "user_id", stamp("ts").alias("ts"), "notice")


@query(
    "w10_capture_cadence",
    f"""with l as (select event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1e6 as gap from {{events}})
    select event_id, {sql_rnd('gap')} as gap_seconds, coalesce(gap > 600, false) as overrun from l""",
)
def _(i):
    got = timeline.capture_cadence(i.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), ["user_id"], "ts", "event_id")
    return got.select("event_id", rnd("gap_seconds").alias("gap_seconds"), "overrun")


@query(
    "w11_capture_totals",
    f"""select file_id, cast(sum(success::int) over w as bigint) as total_captured, cast(sum((not success)::int) over w as bigint) as total_errors, last_value(case when success then filename end ignore nulls) over w as last_file,
      {sql_stamp('last_value(case when success then done_ts end ignore nulls) over w')} as last_time from {{conversions}} window w as (partition by file_id % 5 order by done_ts, file_id rows between unbounded preceding and current row)""",
)
def _(i):
    log = i.conversions.withColumn("host", F.col("file_id") % 5)
    got = timeline.capture_totals(log, ["host"], "done_ts", "file_id", "success", "filename")
    return got.select("file_id", "total_captured", "total_errors", "last_file", stamp("last_time").alias("last_time"))


@query(
    "h10_central_time",
    """select event_id, strftime(timezone('America/Chicago', timezone('UTC', cast(ts as timestamp) + interval '1' day * (event_id % 400))), '%Y-%m-%d %H:%M:%S')
      || case when epoch_us(cast(ts as timestamp) + interval '1' day * (event_id % 400)) - epoch_us(timezone('America/Chicago', timezone('UTC', cast(ts as timestamp) + interval '1' day * (event_id % 400)))) = 18000000000 then ' CDT' else ' CST' end as local from {events}""",
)
def _(i):
    moved = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") % 400) * 86_400_000_000)
    return i.events.select("event_id", text.central_text(moved).alias("local"))


@query(
    "h11_age_and_short_name",
    f"""with a as (select page_id, url, {AS_OF} - interval '1' minute * (page_id % 200) as at from {{pages}})
    select page_id, case when page_id % 9 = 0 then '—' when page_id % 200 < 1 then 'just now' when page_id % 200 < 60 then cast(page_id % 200 as string) || 'm ago' else cast(page_id % 200 // 60 as string) || 'h ' || cast(page_id % 200 % 60 as string) || 'm ago' end as age,
      case when length(url) <= 30 then url else left(url, 14) || '…' || right(url, 14) end as name from a""",
)
def _(i):
    at = F.when(F.col("page_id") % 9 != 0, F.timestamp_seconds(F.unix_timestamp(as_of()) - (F.col("page_id") % 200) * 60))
    return i.pages.select("page_id", text.age_text(at, as_of()).alias("age"), text.short_name(F.col("url")).alias("name"))


@query(
    "h12_service_tag",
    """select event_id, case when event_id % 5 < 3 then case when event_type = 'error' then 'ERROR' when event_type = 'purchase' then 'PROCESSING' else 'RUNNING' end
      when event_id % 5 = 3 then 'STOPPED' when event_id % 10 = 4 then 'RESTARTING' else 'OFFLINE' end as tag from {events}""",
)
def _(i):
    n = F.col("event_id")
    state = F.when(n % 5 < 3, "running").when(n % 5 == 3, "exited").when(n % 10 == 4, "restarting").otherwise("dead")
    inner = F.when(F.col("event_type") == "purchase", "Processing").when(F.col("event_type") != "view", F.col("event_type"))
    return i.events.select("event_id", text.service_tag(state, inner).alias("tag"))


@query(
    "h13_file_size_text",
    """with s as (select doc_id, cast(n_chars as double) * pow(1024, doc_id % 5) as b from {documents})
    select doc_id, case when b < 1024 then printf('%.1f', b) || ' B' when b < pow(1024, 2) then printf('%.1f', b / 1024) || ' KB' when b < pow(1024, 3) then printf('%.1f', b / pow(1024, 2)) || ' MB'
      when b < pow(1024, 4) then printf('%.1f', b / pow(1024, 3)) || ' GB' else printf('%.1f', b / pow(1024, 4)) || ' TB' end as size from s""",
)
def _(i):
    size = F.col("n_chars") * F.pow(F.lit(1024.0), F.col("doc_id") % 5)
    return i.documents.select("doc_id", numbers.file_size_text(size).alias("size"))


@query(
    "h23_freshness_and_health",
    f"""select service_id, case when epoch_us({AS_OF}) // 1000000 - epoch_us(last_ts) // 1000000 > 86400 then 'stale' else 'running' end as freshness, case when (epoch_us({AS_OF}) - epoch_us(last_ts)) / 6e7 > 1440 then 'unhealthy' else 'healthy' end as health,
      case when (epoch_us({AS_OF}) - epoch_us(last_ts)) / 6e7 > 1440 then 'no processing for ' || cast(cast(floor((epoch_us({AS_OF}) - epoch_us(last_ts)) / 6e7) as bigint) as string) || ' minutes' else 'ok' end as reason from {{service_status}}""",
)
def _(i):
    last = F.col("last_ts")
    return i.service_status.select(
        "service_id", health.score_freshness(F.lit("running"), last, as_of(), 86400).alias("freshness"), health.idle_health(last, as_of(), 1440).alias("health"),
        health.idle_reason(last, as_of(), 1440).alias("reason"),
    )


def _line(cond: str, value: str) -> str:
    return f"case when {cond} then {value} end"


TEMP = "coalesce(printf('%.1f', {c} * 9 / 5 + 32) || '°F (' || printf('%.1f', {c}) || '°C)', 'N/A')"
LINES = {
    "temperature": TEMP.replace("{c}", "temp_c"),
    "humidity": "'Humidity: ' || printf('%.0f', humidity) || '%'",
    "wind": "'Wind: ' || printf('%.1f', wind_kmh * 0.621371e0) || ' mph' || case when wind_deg <> 0 then ' from ' || cast(cast(wind_deg as int) as string) || '°' else '' end",
    "pressure": _line("pressure_pa <> 0", "'Pressure: ' || printf('%.2f', pressure_pa / 3386.39e0) || ' inHg'"),
    "visibility": _line("visibility_m <> 0", "'Visibility: ' || printf('%.1f', visibility_m / 1609.34e0) || ' miles'"),
}


@query("h02_report_units", "select obs_id, " + ", ".join(f"{v} as {k}" for k, v in LINES.items()) + " from {observations}")
def _(i):
    c = F.col
    return i.observations.select(
        "obs_id", text.temperature_text(c("temp_c")).alias("temperature"), text.humidity_line(c("humidity")).alias("humidity"), text.wind_line(c("wind_kmh"), c("wind_deg")).alias("wind"),
        text.pressure_line(c("pressure_pa")).alias("pressure"), text.visibility_line(c("visibility_m")).alias("visibility"),
    )


@query(
    "h09_html_escape",
    "select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) as escaped from {pages}",
)
def _(i):
    return i.pages.select("page_id", F.md5(text.html_escaped(F.col("html"))).alias("escaped"))


@query("h09_truncated_copy", "select page_id, md5(left(html, 4000)) as copy from {pages}")
def _(i):
    return i.pages.select("page_id", F.md5(text.short_copy(F.col("html"), 4000)).alias("copy"))


PERIODS = """list_transform(range(0, n_chars % 8), lambda k: chr(10) || 'Period ' || cast(k as string) || ':' || chr(10) || '  Temp: ' || cast(50 + k as string) || '°F' || chr(10)
      || '  Wind: ' || case when k % 2 = 0 then '10 mph' else 'N/A' end || ' ' || case when k % 3 = 0 then 'NW' else '' end || chr(10) || '  ' || 'Sky ' || cast(doc_id % 5 as string))"""
FORECAST_HEAD = f"chr(10) || '{text.RULE}' || chr(10) || 'FORECAST {text.DASH} Dallas' || chr(10) || '{text.RULE}'"


def periods() -> Column:
    """Forecast periods as a parsed feed gives them, none to seven per document."""
    every = F.transform(
        F.sequence(F.lit(0), F.lit(6)),
        lambda k: F.struct(
            F.concat(F.lit("Period "), k.cast("string")).alias("name"), (k + 50).alias("temperature"), F.lit(None).cast("string").alias("temperatureUnit"),
            F.when(k % 2 == 0, "10 mph").alias("windSpeed"), F.when(k % 3 == 0, "NW").alias("windDirection"), F.concat(F.lit("Sky "), (F.col("doc_id") % 5).cast("string")).alias("shortForecast"),
        ),
    )
    return F.slice(every, F.lit(1), (F.col("n_chars") % 8).cast("int"))


@query(
    "l03_first_forecast_periods",
    f"select doc_id, {FORECAST_HEAD} || coalesce(list_aggregate(list_slice(list_transform({PERIODS}, lambda p: chr(10) || p), 1, 5), 'string_agg', ''), '') || chr(10) || chr(10) || '{text.RULE}' as section from {{documents}}",
)
def _(i):
    return i.documents.select("doc_id", text.forecast_section(periods(), "Dallas").alias("section"))


@query(
    "u03_report_assembly",
    f"""with o as (select obs_id, 'Station: ' || station as head, case when obs_id % 4 <> 0 then {LINES['wind']} end as wind, case when obs_id % 3 <> 0 then {LINES['pressure']} end as pressure from {{observations}})
    select obs_id, md5('Weather Report' || chr(10) || head || coalesce(chr(10) || wind, '') || coalesce(chr(10) || pressure, '') || chr(10) || 'End') as report from o""",
)
def _(i):
    o, c = i.observations, F.col
    wind = F.when(c("obs_id") % 4 != 0, text.wind_line(c("wind_kmh"), c("wind_deg")))
    pressure = F.when(c("obs_id") % 3 != 0, text.pressure_line(c("pressure_pa")))
    bodies = [F.lit("Weather Report"), F.concat(F.lit("Station: "), "station"), wind, pressure, F.lit("End")]
    parts = F.array(*[F.struct(F.lit(n).alias("ordinal"), b.alias("body")) for n, b in enumerate(bodies)])
    sections = o.select("obs_id", F.explode(parts).alias("s")).select("obs_id", "s.*")
    return service.assemble_report(sections, ["obs_id"], len(bodies)).withColumn("report", F.md5("report"))


@query("k10_retention", f"select event_id from {{events}} where ts >= {AS_OF} - interval '14' day")
def _(i):
    return service.retained(i.events.select("event_id", F.col("ts").cast("timestamp").alias("ts")), "ts", as_of(), 14).select("event_id")


@query("k10_expired_files", f"select event_id from {{events}} where ts < {AS_OF} - interval '14' day")
def _(i):
    return service.expired_before(i.events.select("event_id", F.col("ts").cast("timestamp").alias("ts")), "ts", as_of(), 14).select("event_id")


@query(
    "p02_truncated_magnitude",
    """select report_id, case when mag = '' then -9 else cast(trunc(try_cast(mag as double)) as int) end as mag from {raw_reports}""",
)
def _(i):
    return i.raw_reports.select("report_id", numbers.truncated_magnitude(F.col("mag")).alias("mag"))
