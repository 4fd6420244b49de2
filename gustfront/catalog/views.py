"""Stand-in inputs derived from the test tables.

One SQL text per view serves both engines, so a query and its twin start from the same rows.
Only the array explode needs a dialect switch.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

EXPLODED = {
    "spark": "select vec_id, pos, cast(v as double) as v from {embeddings} lateral view posexplode(embedding) t as pos, v",
    "duckdb": "select vec_id, pos - 1 as pos, cast(embedding[pos] as double) as v from "
    "(select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as pos from {embeddings}) t",
}

_ORD = "cast(floor(o_orderkey / 4) as bigint)"

VIEWS: dict[str, str] = {
    "stations": "select concat('K', lpad(cast(s_suppkey as string), 4, '0')) as station, "
    "24.5e0 + (s_suppkey * 7919 % 2500) / 1e2 as lat, -124.5e0 + (s_suppkey * 104729 % 5800) / 1e2 as lon from {supplier}",
    "storm_events": "select o_orderkey as report_id, timestamp '2024-01-01 00:00:00' + interval '1' minute * "
    f"({_ORD} * 29 % 43000 + (o_orderkey % 4) * ({_ORD} % 30)) as event_ts, "
    f"24.5e0 + (({_ORD} % 10 + 1) * 7919 % 2500) / 1e2 + ({_ORD} * 31 % 240) / 1e2 - 1.2e0 + (o_orderkey % 4) * ({_ORD} % 7) * 5e-2 as lat, "
    f"-124.5e0 + (({_ORD} % 10 + 1) * 104729 % 5800) / 1e2 + ({_ORD} * 17 % 240) / 1e2 - 1.2e0 as lon, "
    f"cast({_ORD} % 6 as int) as mag, "
    "case o_orderkey % 4 when 0 then 'tornado' when 1 then 'hail' when 2 then 'wind' else 'warning_no_torn' end as subtype from {orders}",
    # report text as it would sit in a CSV file, some rows malformed in one field
    "raw_reports": "select report_id, case when report_id % 41 = 0 then 'n/a' else cast(2023 + report_id % 3 as string) end as yr, "
    "case when report_id % 17 = 0 then '2024-13-45' else substring(cast(event_ts as string), 1, 10) end as date, "
    "case when report_id % 29 = 0 then '' else substring(cast(event_ts as string), 12, 8) end as time, "
    "case when report_id % 19 = 0 then '' when report_id % 23 = 0 then 'ef?' else cast(mag as string) || '.75' end as mag, "
    "case when report_id % 31 = 0 then '0' else cast(lat as string) end as slat, "
    "case when report_id % 37 = 0 then '' else cast(lon as string) end as slon, "
    "' t' || cast(report_id % 10 as string) || ' ' as st, subtype from {storm_events}",
    "scans": "select event_id as scan_id, concat('K', lpad(cast(user_id % 10 + 1 as string), 4, '0')) as station, "
    "case when event_id % 2 = 0 then 'N0B' else 'N0S' end as product, cast(ts as timestamp) as scan_ts from {events}",
    # one listing page per slot: the file, a copy of it, and a name with an impossible month
    "listing_pages": "select event_id as page_id, substring(station, 2, 4) as site, product, "
    "'<a href=\"' || substring(station, 2, 4) || '_' || product || '_' || t || '.png\">f</a> <a href=\"' || substring(station, 2, 4) "
    "|| '_' || product || '_' || t || '.png\">again</a> <i>' || substring(station, 2, 4) || '_' || product || '_202413' || substring(t, 7, 6) || '.png</i>' as html "
    "from (select scan_id as event_id, station, product, replace(replace(replace(substring(cast(scan_ts as string), 1, 16), '-', ''), ' ', ''), ':', '') as t from {scans}) s",
    "warning_vertices": "select l_orderkey as record_id, concat('W', cast(l_orderkey % 37 as string)) as wfo, cast(floor(l_orderkey / 111) as bigint) as etn, "
    "case when l_orderkey % 5 = 0 then 'SV' else 'TO' end as phenom, 'W' as sig, case when l_orderkey % 11 = 0 then 'C' else 'P' end as gtype, "
    "case when l_orderkey % 13 = 0 then '20240' else '2024' || lpad(cast(l_orderkey % 12 + 1 as string), 2, '0') || lpad(cast(l_orderkey % 28 + 1 as string), 2, '0') || '0930' end as issued, "
    "l_linenumber as seq, -124.5e0 + (l_partkey % 5800) / 1e2 as lon, 24.5e0 + (l_suppkey * 7919 % 2500) / 1e2 as lat from {lineitem}",
    "alerts": "select concat('urn:', cast(event_id % 4000 as string)) as alert_id, case event_type when 'error' then 'Tornado Warning' "
    "when 'purchase' then 'Severe Thunderstorm Warning' when 'signup' then 'Flash Flood Warning' when 'click' then 'Flood Warning' "
    "else 'Wind Advisory' end as event, cast(ts as timestamp) as cycle_ts, cast(ts as timestamp) + interval '1' minute * (event_id % 90 - 15) as expires, "
    "event_id as feed_pos from {events}",
    "scores": "select event_id as score_id, cast(ts as timestamp) as score_ts, case when event_id % 7 = 0 then null else (event_id * 37 % 101) / 1e2 end as score, "
    "case when event_id % 11 = 0 then 'stale' when event_id % 13 = 0 then 'error' else 'running' end as status from {events} where event_type = 'view'",
    "ledger": "select alert_id, event as event_type, cycle_ts as sent_at, case when feed_pos % 3 = 0 then 'suppressed_daily_cap' else 'sent' end as outcome "
    "from {alerts} where event <> 'Wind Advisory'",
    "pixels": "select l_orderkey as scan_id, cast(l_linenumber - 1 as int) as row_no, cast(l_partkey % 16 as int) as col_no, cast(min(l_partkey % 256) as int) as r, "
    "cast(min(l_suppkey % 256) as int) as g, cast(min(l_orderkey % 256) as int) as b from {lineitem} group by l_orderkey, l_linenumber, l_partkey % 16",
    "palette": "select cast(x as int) as x, cast(x * 37 % 256 as int) as r, cast(x * 91 % 256 as int) as g, cast(x * 151 % 256 as int) as b, "
    "-20e0 + 90e0 * (x / 350e0) as value from (select distinct l_linenumber * 50 + l_suppkey % 50 - 50 as x from {lineitem}) t",
    "cells": "select vec_id as scan_id, cast(floor(pos / 8) as int) as row_no, cast(pos % 8 as int) as col_no, v * 4e1 as value from {exploded}",
    # palette-index raster with the missing (0) and range-folded (15) codes present
    "index_cells": "select vec_id as scan_id, cast(floor(pos / 8) as int) as row_no, cast(pos % 8 as int) as col_no, "
    "cast(floor(abs(v) * 1e3) as bigint) % 256 as refl_idx, cast(floor(abs(v) * 1e3) as bigint) % 16 as vel_idx from {exploded}",
    # georeference per scan: about 12 to 20 km per pixel, so the box is near the raster size
    "georefs": "select vec_id as scan_id, 0.11e0 + (vec_id % 9) / 1e2 as a, -0.11e0 - (vec_id % 7) / 1e2 as e, -98e0 as c, 33e0 as f, "
    "33e0 - 0.5e0 - (vec_id % 13) / 4e1 as lat, -98e0 + 0.5e0 + (vec_id % 11) / 4e1 as lon from {embeddings}",
    "predictions": "select l.doc_id as scan_id, l.quality as label, (d.n_chars % 101) / 1e2 as score, d.source as subtype "
    "from {labels} l join {documents} d on l.doc_id = d.doc_id",
    "conversions": "select event_id as file_id, concat(case when event_type in ('click', 'view') then 'radar_base_reflectivity_' "
    "when event_type = 'error' then 'radar_base_velocity_' else 'other_' end, cast(event_id as string), '.png') as filename, event_id % 10 <> 0 as success, "
    "cast(ts as timestamp) as done_ts, (event_id % 50) / 1e1 as secs, event_id * 97 % 5000 as out_bytes from {events}",
    "service_status": "select user_id as service_id, max(cast(ts as timestamp)) as last_ts, count(*) as total, "
    "cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as errors from {events} group by user_id",
    # readings as a weather station would send them; NULL where a sensor is silent
    "observations": "select event_id as obs_id, cast(ts as timestamp) as obs_ts, concat('K', lpad(cast(user_id % 10 + 1 as string), 4, '0')) as station, "
    "case when event_id % 9 = 0 then null else value - 20e0 end as temp_c, case when event_id % 8 = 0 then null else value - 25e0 end as dew_c, "
    "case when event_id % 7 = 0 then null else (event_id % 1000) / 1e1 end as humidity, case when event_id % 6 = 0 then null else value * 2e0 end as wind_kmh, "
    "case when event_id % 5 = 0 then null else cast(event_id % 4 * 90 as double) end as wind_deg, case when event_id % 11 = 0 then null else 99000e0 + event_id % 3000 end as pressure_pa, "
    "case when event_id % 10 = 0 then 0e0 else value * 1e2 end as visibility_m, event_type as conditions from {events}",
    # labelled scans for splitting: site-days as groups
    "tensor_rows": "select report_id, concat(subtype, '_', cast(report_id as string)) as event_id, substring(cast(event_ts as string), 1, 10) as date, "
    "concat('K', lpad(cast(cast(floor(report_id / 4) % 10 + 1 as int) as string), 4, '0')) as station, case when subtype = 'tornado' and mag >= 3 then 1 else 0 end as label, "
    "subtype, concat('tensors/', subtype, '_', cast(report_id as string), '.npy') as tensor from {storm_events}",
}

_DEPS = {
    name: [dep for dep in (*TABLES, "exploded", *VIEWS) if "{" + dep + "}" in text]
    for name, text in {**VIEWS, "exploded": EXPLODED["spark"]}.items()
}


def oracle(body: str) -> str:
    """SQL for the twin engine: views named as ``{view}`` in ``body`` become CTEs."""
    used: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in used:
            return
        for dep in _DEPS[name]:
            visit(dep)
        used.append(name)

    for name in (*VIEWS, "exploded", *TABLES):
        if "{" + name + "}" in body:
            visit(name)

    def plain(text: str) -> str:
        for name in (*TABLES, *VIEWS, "exploded"):
            text = text.replace("{" + name + "}", name)
        return text

    ctes = [f"{n} as ({plain(EXPLODED['duckdb'] if n == 'exploded' else VIEWS[n])})" for n in used]
    body = plain(body).strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive "):
        return "with recursive " + ", ".join(ctes) + ", " + body[len("with recursive "):]
    if body.lower().startswith("with "):
        return "with " + ", ".join(ctes) + ", " + body[len("with "):]
    return "with " + ", ".join(ctes) + " " + body


class Inputs:
    """Tables and stand-in views of one data folder as DataFrames (``inputs.storm_events``)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._seen = spark, folder.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in _DEPS:
                text = EXPLODED["spark"] if name == "exploded" else VIEWS[name]
                df = self.spark.sql(text, **{dep: getattr(self, dep) for dep in _DEPS[name]})
            else:
                raise AttributeError(name)
            self._seen[name] = df
        return self._seen[name]

    def over(self, name: str, **tables: DataFrame) -> DataFrame:
        """A view over the given tables instead of those it would read."""
        return self.spark.sql(VIEWS[name], **{dep: tables[dep] if dep in tables else getattr(self, dep) for dep in _DEPS[name]})
