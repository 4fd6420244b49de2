"""Queries of the dataset builder: sites, exclusion, pairing, manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustfront.catalog.registry import query, rnd, sql_rnd, sql_stamp, stamp
from gustfront.functions.geo import haversine_km
from gustfront.functions.radar import event_key, in_bbox, off_null_island, radar_type, strong_enough, tensor_name
from gustfront.operators import lookups, pairing, proximity
from gustfront.plans import dataset

KM = (
    "(2 * 6371e0 * atan2(sqrt({h}), sqrt(1 - {h})))"
)


def sql_km(a: str, b: str, c: str, d: str) -> str:
    h = (
        f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    )
    return KM.replace("{h}", h)


NEAREST = f"""near as (select report_id, station, km from (
  select e.report_id, s.station, {sql_km('e.lat', 'e.lon', 's.lat', 's.lon')} as km,
         row_number() over (partition by e.report_id order by {sql_km('e.lat', 'e.lon', 's.lat', 's.lon')}, s.station) as n
  from {{storm_events}} e cross join {{stations}} s) t where n = 1 and km <= 150)"""


@query("h01_haversine_km", f"select report_id, {sql_rnd(sql_km('lat', 'lon', '35e0', '-97e0'))} as km from {{storm_events}}")
def _(i):
    return i.storm_events.select("report_id", rnd(haversine_km(F.col("lat"), F.col("lon"), F.lit(35.0), F.lit(-97.0))).alias("km"))


@query("j01_nearest_station", f"with {NEAREST} select report_id, station, {sql_rnd('km')} as dist_km from near")
def _(i):
    near = proximity.nearest_station(i.storm_events, i.stations)
    return near.select("report_id", "station", rnd("dist_km").alias("dist_km"))


@query("j01_nearest_station_large_site_table", f"with {NEAREST} select report_id, station, {sql_rnd('km')} as dist_km from near")
def _(i):
    near = proximity.nearest_station(i.storm_events, i.stations, row_by_row=True)
    return near.select("report_id", "station", rnd("dist_km").alias("dist_km"))


@query(
    "j02_warnings_without_confirmed_event",
    f"""select w.report_id, {sql_stamp('w.event_ts')} as event_ts from {{storm_events}} w where w.subtype = 'warning_no_torn' and not exists (
      select 1 from {{storm_events}} t where t.subtype = 'tornado' and t.mag >= 1 and abs(epoch_us(w.event_ts) - epoch_us(t.event_ts)) <= 2700000000
      and {sql_km('w.lat', 'w.lon', 't.lat', 't.lon')} <= 30)""",
)
def _(i):
    e = i.storm_events
    kept = proximity.exclude_near(e.where("subtype = 'warning_no_torn'"), e.where("subtype = 'tornado' and mag >= 1"))
    return kept.select("report_id", stamp("event_ts").alias("event_ts"))


@query(
    "j02_collectable_events",
    f"""select report_id, subtype from {{storm_events}} where subtype <> 'warning_no_torn' union all select w.report_id, w.subtype from {{storm_events}} w where w.subtype = 'warning_no_torn' and not exists (
      select 1 from {{storm_events}} t where t.subtype = 'tornado' and t.mag >= 3 and abs(epoch_us(w.event_ts) - epoch_us(t.event_ts)) <= 2700000000
      and {sql_km('w.lat', 'w.lon', 't.lat', 't.lon')} <= 30)""",
)
def _(i):
    return dataset.collectable_events(i.storm_events, exclusion_min_mag=3).select("report_id", "subtype")


LISTED = """listed as (select station, product, date_trunc('minute', scan_ts) as scan_ts, min(scan_id) as scan_id from {scans} group by 1, 2, 3)"""
CHOSEN = f"""chosen as (select * from (select r.report_id, r.station, r.km, l.scan_id, l.scan_ts, e.event_ts, e.subtype, e.mag, e.lat, e.lon,
  row_number() over (partition by r.report_id order by abs(epoch_us(l.scan_ts) - epoch_us(e.event_ts)), l.scan_ts) as n
  from near r join {{storm_events}} e on e.report_id = r.report_id join listed l on l.station = r.station and l.product = 'N0B'
   and l.scan_ts between e.event_ts - interval '30' minute and e.event_ts + interval '10' minute) t where n <= 5)"""


@query("j03_closest_scans", f"with {NEAREST}, {LISTED}, {CHOSEN} select report_id, station, scan_id, {sql_stamp('scan_ts')} as scan_ts from chosen")
def _(i):
    listed = pairing.minute_scans(i.scans).where("product = 'N0B'")
    got = pairing.closest_scans(proximity.nearest_station(i.storm_events, i.stations), listed)
    return got.select("report_id", "station", "scan_id", stamp("scan_ts").alias("scan_ts"))


@query(
    "j03_closest_scans_same_day",
    f"""with {NEAREST}, {LISTED}, {CHOSEN.replace("l.product = 'N0B'", "l.product = 'N0B' and cast(l.scan_ts as date) = cast(e.event_ts as date)")}
    select report_id, scan_id from chosen""",
)
def _(i):
    listed = pairing.minute_scans(i.scans).where("product = 'N0B'")
    got = pairing.closest_scans(proximity.nearest_station(i.storm_events, i.stations), listed, same_day_only=True)
    return got.select("report_id", "scan_id")


PAIRED = f"""paired as (select r.scan_id, r.station, r.scan_ts, v.scan_id as pair_id, v.scan_ts as pair_ts,
  row_number() over (partition by r.scan_id order by abs(epoch_us(v.scan_ts) - epoch_us(r.scan_ts)), v.scan_ts) as n
  from listed r left join listed v on v.station = r.station and v.product = 'N0S' and abs(epoch_us(v.scan_ts) - epoch_us(r.scan_ts)) <= 480000000
  where r.product = 'N0B')"""


@query(
    "j04_nearest_velocity_scan",
    f"with {LISTED}, {PAIRED} select scan_id, station, pair_id, {sql_stamp('pair_ts')} as pair_ts, abs(epoch_us(pair_ts) - epoch_us(scan_ts)) / 1e6 as gap_seconds from paired where n = 1",
)
def _(i):
    listed = pairing.minute_scans(i.scans)
    got = pairing.pair_velocity(listed.where("product = 'N0B'").drop("product"), listed.where("product = 'N0S'").drop("product"))
    return got.select("scan_id", "station", "pair_id", stamp("pair_ts").alias("pair_ts"), "gap_seconds")


@query(
    "j05_newest_pair",
    f"""with {LISTED}, lim as (select date_trunc('day', max(scan_ts)) as d from listed),
    recent as (select l.* from listed l, lim where l.scan_ts >= d - interval '1' day and l.scan_ts < d + interval '1' day),
    newest as (select station, max(scan_ts) as scan_ts from recent where product = 'N0B' group by 1),
    p as (select n.station, n.scan_ts, v.scan_ts as pair_ts, row_number() over (partition by n.station order by abs(epoch_us(v.scan_ts) - epoch_us(n.scan_ts)), v.scan_ts) as k
      from newest n left join recent v on v.station = n.station and v.product = 'N0S' and abs(epoch_us(v.scan_ts) - epoch_us(n.scan_ts)) <= 300000000)
    select station, {sql_stamp('scan_ts')} as scan_ts, {sql_stamp('pair_ts')} as pair_ts,
      case when pair_ts is null then 'no velocity within 300s of ' || strftime(scan_ts, '%Y-%m-%dT%H:%M:%SZ') else 'paired' end as reason from p where k = 1""",
)
def _(i):
    listed = pairing.minute_scans(i.scans)
    as_of = listed.select(F.max("scan_ts")).scalar()
    got = pairing.newest_pair(listed.where("product = 'N0B'").drop("product"), listed.where("product = 'N0S'").drop("product"), as_of)
    return got.select("station", stamp("scan_ts").alias("scan_ts"), stamp("pair_ts").alias("pair_ts"), "reason")


@query(
    "j05_newest_pair_of_every_site",
    f"""with {LISTED}, lim as (select date_trunc('day', max(scan_ts)) as d from listed),
    recent as (select l.* from listed l, lim where l.scan_ts >= d - interval '1' day and l.scan_ts < d + interval '1' day and l.station <> 'K0003'),
    newest as (select station, max(scan_ts) as scan_ts from recent where product = 'N0B' group by 1),
    p as (select n.station, n.scan_ts, v.scan_ts as pair_ts, row_number() over (partition by n.station order by abs(epoch_us(v.scan_ts) - epoch_us(n.scan_ts)), v.scan_ts) as k
      from newest n left join recent v on v.station = n.station and v.product = 'N0S' and abs(epoch_us(v.scan_ts) - epoch_us(n.scan_ts)) <= 300000000)
    select s.station, {sql_stamp('pair_ts')} as pair_ts, case when scan_ts is null then 'no recent reflectivity' when pair_ts is null then 'no velocity within 300s of ' || strftime(scan_ts, '%Y-%m-%dT%H:%M:%SZ') else 'paired' end as reason
    from (select distinct station from {{stations}}) s left join (select * from p where k = 1) p on p.station = s.station""",
)
def _(i):
    listed = pairing.minute_scans(i.scans)
    as_of = listed.select(F.max("scan_ts")).scalar()
    seen = listed.where("station <> 'K0003'")  # a site whose feed is down
    got = pairing.newest_pair(seen.where("product = 'N0B'").drop("product"), seen.where("product = 'N0S'").drop("product"), as_of, stations=i.stations)
    return got.select("station", stamp("pair_ts").alias("pair_ts"), "reason")


@query(
    "j09_array_comparison",
    f"""with p as (select vec_id, embedding as a, case when vec_id % 3 = 0 then list_transform(embedding, lambda x: x + cast(0.5 as float)) when vec_id % 7 = 0 then list_slice(embedding, 1, 10) when vec_id % 11 <> 0 then embedding end as b from {{embeddings}}),
    g as (select vec_id, a, b, case when len(a) = len(b) then list_transform(range(1, len(a) + 1), lambda k: abs(cast(a[k] as double) - cast(b[k] as double))) end as d from p)
    select vec_id, coalesce(list_max(d) = 0, false) as equal, {sql_rnd('list_max(d)', 4)} as largest, {sql_rnd('list_sum(d) / len(d)', 4)} as mean from g""",
)
def _(i):
    k, e = F.col("vec_id"), F.col("embedding")
    other = F.when(k % 3 == 0, F.transform(e, lambda x: (x + F.lit(0.5).cast("float")).cast("float"))).when(k % 7 == 0, F.slice(e, 1, 10)).when(k % 11 != 0, e)
    got = lookups.compare_arrays(i.embeddings.select("vec_id", e.alias("a"), other.alias("b")), "a", "b")
    return got.select("vec_id", "equal", rnd("largest_difference", 4).alias("largest"), rnd("mean_difference", 4).alias("mean"))


EVENT_ID = "subtype || '_' || strftime(event_ts, '%Y%m%d_%H%M') || '_' || station"
MANIFEST = f"""ided as (select *, {EVENT_ID} as event_id from chosen),
 owner as (select event_id, min(report_id) as report_id from ided group by 1),
 rows_ as (select i.* from ided i join owner o on i.event_id = o.event_id and i.report_id = o.report_id),
 vels as (select scan_id, station, pair_id from paired where n = 1)"""
CLASS = "case when r.subtype = 'tornado' then 'tornado' else 'no_tornado' end"
FRAME = f"'raw/' || {CLASS} || '/' || r.event_id || '_' || strftime(r.scan_ts, '%Y%m%d_%H%M') || '_'"
MANIFEST_SQL = f"""with {NEAREST}, {LISTED}, {CHOSEN}, {PAIRED}, {MANIFEST}
 select r.event_id, case when r.subtype = 'tornado' then 1 else 0 end as label, {CLASS} as class, r.subtype, r.station, r.mag, r.lat as event_lat, r.lon as event_lon,
  round_even(r.km, 1) as dist_km, strftime(r.event_ts, '%Y-%m-%d') as date, strftime(r.scan_ts, '%Y-%m-%dT%H:%MZ') as scan_time,
  {FRAME} || 'N0B.png' as refl, case when v.pair_id is not null then {FRAME} || 'N0S.png' end as vel
 from rows_ r join vels v on v.scan_id = r.scan_id"""


@query("p08_manifest_rows", MANIFEST_SQL)
def manifest_rows(i):
    return dataset.build_manifest(i.storm_events, i.stations, i.scans)


@query(
    "p07_event_id",
    f"with {NEAREST} select e.report_id, {EVENT_ID.replace('station', 'n.station')} as event_id from {{storm_events}} e join near n on n.report_id = e.report_id",
)
def _(i):
    near = proximity.nearest_station(i.storm_events, i.stations)
    return near.select("report_id", event_key(F.col("subtype"), F.col("event_ts"), F.col("station")).alias("event_id"))


@query(
    "j06_resume_anti_join",
    "select e.report_id from {storm_events} e where not exists (select 1 from {ledger} l where l.alert_id = 'urn:' || cast(e.report_id as string))",
)
def _(i):
    e = i.storm_events.withColumn("event_id", F.concat(F.lit("urn:"), F.col("report_id").cast("string")))
    return lookups.not_yet_done(e, i.ledger.select(F.col("alert_id").alias("event_id"))).select("report_id")


@query(
    "j07_reconcile_artifacts",
    """with m as (select distinct l_orderkey as k from {lineitem} where l_linenumber = 1 and l_orderkey % 5 <> 0)
    select 'T' || cast(o_orderkey as string) as tensor, case when o_custkey % 10 = 0 then 'skipped_no_georef' when a.o_k is null then 'new'
      when not a.ok then 'healed_corrupt' when m.k is not null then 'reused' else 'healed_orphan' end as action
    from {orders} o left join (select distinct l_orderkey as o_k, l_orderkey % 7 <> 0 as ok from {lineitem}) a on a.o_k = o.o_orderkey left join m on m.k = o.o_orderkey""",
)
def _(i):
    name = lambda c: F.concat(F.lit("T"), F.col(c).cast("string")).alias("tensor")
    rows = i.orders.select(name("o_orderkey"), (F.col("o_custkey") % 10).alias("station"))
    artifacts = i.lineitem.select(name("l_orderkey"), (F.col("l_orderkey") % 7 != 0).alias("loadable")).distinct()
    manifest = i.lineitem.where("l_linenumber = 1 and l_orderkey % 5 <> 0").select(name("l_orderkey"))
    sites = i.customer.select((F.col("c_custkey") % 10).alias("station")).where("station <> 0")
    return lookups.reconcile(rows, artifacts, manifest, sites).select("tensor", "action")


@query("j07_unlisted_artifacts", "select distinct l_orderkey as k from {lineitem} where l_orderkey not in (select o_orderkey from {orders} where o_orderkey % 3 = 0)")
def _(i):
    rows = i.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("tensor"))
    stored = i.lineitem.select(F.col("l_orderkey").alias("tensor")).distinct()
    return lookups.unlisted_artifacts(rows, stored).select(F.col("tensor").alias("k"))


@query("j08_dimension_lookup", "select s.scan_id, t.lat, t.lon from {scans} s join {stations} t on t.station = s.station where cast(substring(t.station, 2, 4) as int) % 3 <> 0")
def _(i):
    sites = i.stations.where("cast(substring(station, 2, 4) as int) % 3 <> 0")
    return lookups.lookup_or_drop(i.scans, sites, "station").select("scan_id", "lat", "lon")


@query("j08_lookup_misses", "select station, count(*) as missed from {scans} where station not in (select station from {stations} where cast(substring(station, 2, 4) as int) % 3 <> 0) group by 1")
def _(i):
    return lookups.count_misses(i.scans, i.stations.where("cast(substring(station, 2, 4) as int) % 3 <> 0"), "station")


@query(
    "j09_composite_key_with_reason",
    """select l_orderkey, l_linenumber, case when o.o_orderkey is null then 'no manifest row' when o.o_totalprice > 200000 then 'missing artifact' else 'ok' end as reason
    from {lineitem} l left join (select * from {orders} where o_orderkey % 4 <> 0) o on o.o_orderkey = l.l_orderkey and o.o_custkey % 7 = l.l_linenumber % 7""",
)
def _(i):
    manifest = i.orders.where("o_orderkey % 4 <> 0").select(
        F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 7).alias("part"), F.when(F.col("o_totalprice") <= 200000, "x.png").alias("refl")
    )
    sample = i.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 7).cast("long").alias("part"))
    return lookups.join_with_reason(sample, manifest, ["l_orderkey", "part"], ["refl"]).select("l_orderkey", "l_linenumber", "reason")


@query(
    "j14_alias_resolution",
    """with tried as (select c_custkey, a.pos, a.name from (select c_custkey, unnest([{'pos': 0, 'name': 'N' || cast(c_custkey % 40 as string)},
      {'pos': 1, 'name': 'N' || cast(c_custkey % 29 as string)}, {'pos': 2, 'name': 'N' || cast(c_custkey % 31 as string)}]) as a from {customer}) t),
    hit as (select c_custkey, arg_min(t.name, pos) as matched, arg_min(n.n_regionkey, pos) as state from tried t join {nation} n on t.name = 'N' || cast(n.n_nationkey as string) group by 1)
    select c.c_custkey, coalesce(cast(h.state as string), 'not_found') as state, h.matched from {customer} c left join hit h on h.c_custkey = c.c_custkey""",
)
def _(i):
    alias = lambda n: F.concat(F.lit("N"), (F.col("c_custkey") % n).cast("string"))
    wanted = i.customer.select("c_custkey", F.array(alias(40), alias(29), alias(31)).alias("aliases"))
    present = i.nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_regionkey").cast("string").alias("state"))
    return lookups.resolve_alias(wanted, present, "c_custkey", "aliases").drop("aliases")


@query(
    "j13_status_merge",
    """select s.service_id, case when service_id % 4 <> 0 then 'exited' when service_id % 8 = 0 or errors > 20 or total > 0 then 'running' else 'not_found' end as state,
      case when service_id % 3 = 0 then 'running' else 'reported' end as status,
      case when service_id % 3 = 0 then case when errors > 5 then errors else total end else total + 1 end as total_captured,
      case when service_id % 3 = 0 then 0 else errors end as total_errors, service_id % 3 = 0 as synthetic
    from {service_status} s""".replace("case when service_id % 4 <> 0 then 'exited' when service_id % 8 = 0 or errors > 20 or total > 0 then 'running' else 'not_found' end",
    "case when service_id % 3 = 0 then 'running' when service_id % 4 = 0 then (case when service_id % 8 = 0 then 'running' else 'not_found' end) else 'exited' end"),
)
def _(i):
    s = i.service_status
    seen = F.when(F.col("service_id") % 4 != 0, "exited").otherwise("not_found")
    inner = F.when(F.col("service_id") % 8 == 0, "Idle").otherwise("error")
    own = F.col("service_id") % 3 != 0
    capture = s.select(
        "service_id", lookups.effective_state(seen, inner).alias("state"), F.when(own, F.col("total") + 1).alias("total_captured"),
        F.when(own, F.col("errors")).alias("total_errors"), F.when(F.col("errors") > 5, F.col("errors")).otherwise(0).alias("files"), F.lit(None).cast("string").alias("last_file"),
    )
    processor = s.select("service_id", F.col("total").alias("total_processed"), F.lit("x").alias("last_processed"))
    return lookups.fill_capture_status(capture, processor, "service_id").drop("last_file")


# --- predicates and small projections --------------------------------------------------------------


@query(
    "p01_year_and_magnitude_filter",
    "select report_id from {storm_events} where extract(year from event_ts - interval '1' day * (400 * (report_id % 4))) in (2021, 2023) and (subtype <> 'tornado' or mag >= 2)",
)
def _(i):
    aged = F.col("event_ts") - F.expr("interval '1' day * (400 * (report_id % 4))")  # four years of reports
    return i.storm_events.where(F.year(aged).isin(2021, 2023) & strong_enough(F.col("subtype"), F.col("mag"), 2)).select("report_id")


@query("p03_null_island_filter", "select report_id from {storm_events} where floor(lat) - 30 <> 0 and floor(lon) + 100 <> 0")
def _(i):
    return i.storm_events.where(off_null_island(F.floor("lat") - 30, F.floor("lon") + 100)).select("report_id")


@query("p04_bbox_filter", "select report_id from {storm_events} where lon - 5 > -125 and lon - 5 < -66 and lat + 15 > 24 and lat + 15 < 50")
def _(i):
    return i.storm_events.where(in_bbox(F.col("lat") + 15, F.col("lon") - 5)).select("report_id")


@query(
    "p06_radar_type_from_name",
    "select file_id, case when contains(lower(filename), 'reflectivity') then 'reflectivity' when contains(lower(filename), 'velocity') then 'velocity' else 'unknown' end as radar_type from {conversions}",
)
def _(i):
    return i.conversions.select("file_id", radar_type(F.col("filename")).alias("radar_type"))


@query(
    "p09_tensor_name",
    """select page_id, 'tensors/' || replace(regexp_replace(regexp_extract(url || '_N0B.png', '[^/]*$', 0), '\\.[^.]*$', ''), '_N0B', '') || '.npy' as tensor, page_id % 3 <> 0 as has_velocity from {pages}""",
)
def _(i):
    vel = F.when(F.col("page_id") % 3 != 0, F.col("url"))
    return i.pages.select("page_id", tensor_name(F.concat("url", F.lit("_N0B.png"))).alias("tensor"), vel.isNotNull().alias("has_velocity"))
