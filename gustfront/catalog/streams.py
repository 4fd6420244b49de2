"""Streaming queries: tables land as files, a stream reads them to the end, the sink is read back."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustfront.catalog.alerting import ALLOWED, KNOWN, REPLAY, SCOPED, scoped_alerts
from gustfront.catalog.dataset import LISTED, PAIRED
from gustfront.catalog.registry import query, rnd, sql_rnd, sql_stamp, stamp
from gustfront.constants import ALLOWED_EVENTS
from gustfront.operators import pairing, suppression
from gustfront.session import scratch_path
from gustfront.sinks.tables import read_snapshot, write_snapshot
from gustfront.sources.frames import image_pixels
from gustfront.streaming import feeds, frames, settled, stateful


def replay(name: str, slices: Iterable[DataFrame], plan: Callable[[DataFrame], DataFrame], batch=None) -> DataFrame | None:
    """Land each slice, run the stream over what is new, stop; state carries over by checkpoint."""
    slices = list(slices)
    spark = slices[0].sparkSession
    landing, checkpoint, out = (scratch_path(spark, f"{name}-{part}") for part in ("in", "cp", "out"))
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    feeds.prepare(spark, spark.sparkContext.defaultParallelism)
    try:
        for part in slices:
            part.write.mode("append").parquet(landing)
            stream = plan(feeds.stream_files(spark, landing, part.schema))
            feeds.start(stream, checkpoint, batch=batch, path=None if batch else out).awaitTermination()
    finally:
        spark.conf.set(key, before)
    return None if batch else spark.read.parquet(out)


def halves(df: DataFrame, ts: str) -> list[DataFrame]:
    """Timeline before and from mid-month on."""
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    return [df.where(F.col(ts) < cut), df.where(F.col(ts) >= cut)]


@query("t01_polled_alert_feed", f"select feed_pos, alert_id from {{alerts}} where {ALLOWED} and expires > cycle_ts")
def _(i):
    return replay("polls", halves(i.alerts, "cycle_ts"), lambda s: suppression.allowed_active(s, F.col("cycle_ts")).select("feed_pos", "alert_id"))


@query("t02_alert_dedupe_stream", "select 'urn:' || cast(feed_pos as string) as alert_id from {alerts}")
def _(i):
    # every alert stays active for a second poll, and the final day's polls arrive once more
    named = i.alerts.select(F.concat(F.lit("urn:"), F.col("feed_pos").cast("string")).alias("alert_id"), "cycle_ts")
    polls = named.unionByName(named.withColumn("cycle_ts", F.col("cycle_ts") + F.expr("interval 5 minutes")))
    last = i.alerts.select(F.max("cycle_ts") - F.expr("interval 24 hours")).scalar()
    return replay("dedupe", [polls, named.where(F.col("cycle_ts") > last)], lambda s: feeds.dedupe_alerts(s).select("alert_id"))


@query("t03_suppression_stream", REPLAY + " select scope, alert_id, feed_pos, outcome from run where n > 0 and outcome <> 'duplicate'")
def _(i):
    got = replay("suppress", halves(scoped_alerts(i), "cycle_ts"), stateful.suppress_stream)
    return got.select("scope", "alert_id", "feed_pos", "outcome")


POLL = 900
ONCE = f"""once as (select cast(e.user_id % 40 as string) as scope, 'f' || cast(a.feed_pos as string) as alert_id, a.event, to_timestamp(ceil(epoch(a.cycle_ts) / {POLL}) * {POLL})::timestamp as start, a.expires, a.feed_pos, a.feed_pos % 6 <> 0 as delivered
    from {{alerts}} a join {{events}} e on e.event_id = a.feed_pos where {ALLOWED}),
  sc as (select scope, alert_id, event, t as cycle_ts, feed_pos, delivered, row_number() over (partition by scope order by t, feed_pos) as n
    from (select *, unnest(generate_series(start, expires - interval '1' microsecond, interval '{POLL}' second)) as t from once where expires > start))"""


@query("t09_alerts_named_once", REPLAY.replace(SCOPED, ONCE) + " select scope, alert_id, feed_pos, outcome from run where n > 0 and outcome in ('sent', 'suppressed_daily_cap')")
def _(i):
    # the feed names an alert at its first poll only; what waits is offered again as if it had been repeated until it expires
    poll = F.timestamp_seconds(F.ceil(F.unix_micros("cycle_ts") / F.lit(POLL * 1e6)) * POLL)
    joined = i.alerts.join(i.events.select(F.col("event_id").alias("feed_pos"), "user_id"), "feed_pos").where(F.col("event").isin(*ALLOWED_EVENTS))
    once = joined.select(
        (F.col("user_id") % 40).cast("string").alias("scope"), F.concat(F.lit("f"), F.col("feed_pos").cast("string")).alias("alert_id"), "event", poll.alias("cycle_ts"), "feed_pos",
        (F.col("feed_pos") % 6 != 0).alias("delivered"), "expires",
    ).where("expires > cycle_ts")
    # a later poll of another scope lets the watermark pass the last alert
    mark = once.agg(F.max("expires").alias("last")).select(
        F.lit("END").alias("scope"), F.lit(None).cast("string").alias("alert_id"), F.lit(None).cast("string").alias("event"), (F.col("last") + F.expr("interval 1 day")).alias("cycle_ts"), F.lit(-1).cast("long").alias("feed_pos"),
        F.lit(True).alias("delivered"), (F.col("last") + F.expr("interval 2 days")).alias("expires"),
    )
    got = replay("pending", [*halves(once, "cycle_ts"), mark], lambda s: stateful.suppress_pending_stream(s, poll_seconds=POLL))
    return suppression.ledger_rows(got).select("scope", "alert_id", "feed_pos", "outcome")


@query("t07_ledger_from_stream", REPLAY + " select scope, alert_id, feed_pos, outcome from run where n > 0 and outcome in ('sent', 'suppressed_daily_cap')")
def _(i):
    ledger, counters = scratch_path(i.spark, "stream-ledger"), scratch_path(i.spark, "stream-counters")
    replay("cycles", halves(scoped_alerts(i), "cycle_ts"), stateful.suppress_stream, stateful.record_cycles(ledger, counters))
    return i.spark.read.parquet(ledger).select("scope", "alert_id", "feed_pos", "outcome")


@query("t07_totals_from_stream", REPLAY + f" select scope, count(*) as sent_total, {sql_stamp('max(run.cycle_ts)')} as last_sent from run where outcome = 'sent' group by scope")
def _(i):
    ledger, counters = scratch_path(i.spark, "stream-ledger"), scratch_path(i.spark, "stream-counters")
    replay("totals", halves(scoped_alerts(i), "cycle_ts"), stateful.suppress_stream, stateful.record_cycles(ledger, counters))
    return read_snapshot(i.spark, f"{counters}-totals").where("sent_total > 0").withColumn("last_sent", stamp("last_sent"))


@query(
    "t04_stream_stream_pairing",
    f"with {LISTED}, {PAIRED} select scan_id, station, pair_id, {sql_stamp('pair_ts')} as pair_ts from paired where n = 1",
)
def _(i):
    listed = pairing.minute_scans(i.scans)
    # a later marker on both sides lets the watermark pass every real scan
    marker = listed.groupBy("product").agg(F.lit("END").alias("station"), (F.max("scan_ts") + F.expr("interval 1 day")).alias("scan_ts"), F.lit(-1).cast("long").alias("scan_id"))
    land = listed.unionByName(marker.select(*listed.columns))

    def plan(stream: DataFrame) -> DataFrame:
        return feeds.pair_streams(stream.where("product = 'N0B'"), stream.where("product = 'N0S'"))

    got = replay("pair", [land], plan).where("station <> 'END'")
    return got.select("scan_id", "station", "pair_id", stamp("pair_ts").alias("pair_ts"))


@query(
    "t05_late_scans",
    "with m as (select max(scan_ts) - interval '1' day as wm from {scans} where scan_id % 3 <> 0) select scan_id from {scans}, m where scan_id % 3 <> 0 or scan_ts > wm",
)
def _(i):
    slices = [i.scans.where("scan_id % 3 <> 0"), i.scans.where("scan_id % 3 = 0")]
    return replay("late", slices, lambda s: feeds.with_lookback(s).dropDuplicatesWithinWatermark(["scan_id"]).select("scan_id"))


@query("t05_settled_files", "select vec_id, label, 0::bigint as files_left from {embeddings}")
def _(i):
    spark, (landing, checkpoint, out) = i.spark, (scratch_path(i.spark, f"settled-{part}") for part in ("in", "cp", "out"))
    i.embeddings.select("vec_id", "label").repartition(12).write.parquet(landing)

    def take(batch: DataFrame, number: int) -> None:
        paths = [r[0] for r in batch.select("path").collect()]  # at most the files of a trigger
        if paths:
            spark.read.parquet(*paths).write.mode("overwrite").parquet(f"{out}/batch={number}")
            settled.remove_files(batch)

    for as_of in (0.0, 1e11):  # nothing is settled yet; then all is, and comes in bounded batches after a restart
        feeds.drain(settled.stream_settled(spark, landing, checkpoint, ["part-*.parquet"], files_per_trigger=5, as_of=as_of), checkpoint, take)
    left = settled.SettledReader({"path": landing, "pattern": "part-*.parquet", "asof": "1e11"}).listed(settled.START, None)
    return spark.read.parquet(out).select("vec_id", "label", F.lit(len(left)).cast("long").alias("files_left"))


@query("t06_alerts_with_latest_score", f"with {KNOWN} select feed_pos, shown as score, age as score_age, state as model_state from z")
def _(i):
    snapshot, out = scratch_path(i.spark, "scores"), scratch_path(i.spark, "annotated")
    write_snapshot(i.scores, snapshot, 1)
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    replay("annotate", halves(i.alerts, "cycle_ts"), lambda s: s, feeds.annotate_batch(snapshot, keep))
    return i.spark.read.parquet(out).select("feed_pos", "score", "score_age", "model_state")


@query("t06_as_of_join_of_streams", f"with {KNOWN} select feed_pos, shown as score, age as score_age, state as model_state from z")
def _(i):
    # both feeds land half by half, the scores behind the alerts; later markers let both watermarks pass all
    spark, (alerts_in, scores_in, checkpoint, state, out) = i.spark, (scratch_path(i.spark, f"as-of-{part}") for part in ("alerts", "scores", "cp", "state", "out"))
    alerts, scores = i.alerts.select("feed_pos", "alert_id", "cycle_ts"), i.scores.select("score_id", "score_ts", "score", "status")
    end = F.greatest(alerts.select(F.max("cycle_ts")).scalar(), scores.select(F.max("score_ts")).scalar())
    mark_a = alerts.limit(1).select(F.lit(-1).cast(dict(alerts.dtypes)["feed_pos"]).alias("feed_pos"), "alert_id", (end + F.expr("interval 1 day")).alias("cycle_ts"))
    mark_s = scores.limit(1).select(F.lit(-1).cast(dict(scores.dtypes)["score_id"]).alias("score_id"), (end + F.expr("interval 1 day")).alias("score_ts"), "score", "status")
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    for asked, told in zip([*halves(alerts, "cycle_ts"), mark_a], [*halves(scores, "score_ts"), mark_s]):
        asked.write.mode("append").parquet(alerts_in)
        told.write.mode("append").parquet(scores_in)
        both = feeds.as_of_rows(feeds.stream_files(spark, alerts_in, alerts.schema), feeds.stream_files(spark, scores_in, scores.schema))
        feeds.start(both, checkpoint, batch=feeds.as_of_batch(state, keep)).awaitTermination()
    return spark.read.parquet(out).where("feed_pos >= 0").select("feed_pos", "score", "score_age", "model_state")


@query(
    "w08_health_edges_stream",
    f"""with h as (select event_id, user_id, ts, case when event_type in ('view', 'click') then 200 when event_type = 'error' then 503 else 500 end as code, event_id % 2 = 0 as up from {{events}}),
    l as (select *, lag(code = 200) over (partition by user_id order by ts, event_id) as before from h)
    select event_id as sample_id, cast(user_id as string) as source, case when code = 200 then 'RECOVERED' when code = 503 then 'STALE' when not up then 'DOWN' else 'ERROR' end as notice from l where (code = 200) <> coalesce(before, true)""",
)
def _(i):
    code = F.when(F.col("event_type").isin("view", "click"), 200).when(F.col("event_type") == "error", 503).otherwise(500)
    samples = i.events.select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("at"), code.alias("code"), (F.col("event_id") % 2 == 0).alias("running"))
    return replay("health", halves(samples, "at"), stateful.health_edges).select("sample_id", "source", "notice")


PICTURE = """px as (select vec_id as scan_id, cast(floor(pos / 8) as int) as row_no, cast(pos % 8 as int) as col_no, cast(cast(floor(abs(v) * 1e3) as bigint) % 256 as int) as r,
 cast(cast(floor(abs(v) * 1e4) as bigint) % 256 as int) as g, cast(cast(floor(abs(v) * 1e5) as bigint) % 256 as int) as b from {exploded})"""


def pictures(i):
    """Decoded pictures (blue, green, red bytes) made from the embedding arrays."""
    byte = lambda v, scale: F.lpad(F.hex(F.floor(F.abs(v.cast("double")) * scale).cast("long") % 256), 2, "0")
    data = F.unhex(F.array_join(F.transform("embedding", lambda v: F.concat(byte(v, 1e5), byte(v, 1e4), byte(v, 1e3))), ""))
    name = F.concat(F.lit("/input/radar_base_reflectivity_"), F.col("vec_id").cast("string"), F.lit(".png"))
    return i.embeddings.select(name.alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), data.alias("data"))


def picture_id(column: str):
    return F.regexp_extract(column, r"_(\d+)\.png$", 1).cast("long")


@query("f04_picture_pixels", f"with {PICTURE} select scan_id, row_no, col_no, r, g, b from px")
def _(i):
    return image_pixels(pictures(i)).select(picture_id("origin").alias("scan_id"), "row_no", "col_no", "r", "g", "b")


@query("f04_palette_index", "select p.scan_id, p.row_no, p.col_no, min(s.x) as idx from (select scan_id, row_no, col_no, r - r % 32 as r, g - g % 32 as g, b - b % 32 as b from {pixels}) p join (select x, r - r % 32 as r, g - g % 32 as g, b - b % 32 as b from {palette}) s using (r, g, b) group by 1, 2, 3")
def _(i):
    from gustfront.sources.frames import index_pixels

    coarse = lambda df, *keep: df.select(*keep, *[(F.col(c) - F.col(c) % 32).alias(c) for c in "rgb"])
    got = index_pixels(coarse(i.pixels, "scan_id", "row_no", "col_no"), coarse(i.palette, F.col("x").alias("idx")))
    return got.select("scan_id", "row_no", "col_no", "idx")


@query(
    "t08_frame_to_grid_stream",
    f"""with {PICTURE}, k as (select * from px where row_no % 2 = 0 and col_no % 2 = 0), d as (select k.scan_id, k.row_no, k.col_no, s.value, row_number() over (partition by k.scan_id, k.row_no, k.col_no
      order by (k.r - s.r) * (k.r - s.r) + (k.g - s.g) * (k.g - s.g) + (k.b - s.b) * (k.b - s.b), s.x) as n from k cross join {{palette}} s)
    select scan_id, count(*) as cells, {sql_rnd('sum(round_even(value * 100, 0) / 1e2)', 4)} as total, true as success from d where n = 1 group by 1""",
)
def _(i):
    grids, log = scratch_path(i.spark, "stream-grids"), scratch_path(i.spark, "stream-log")
    made_of = pictures(i)
    broken = made_of.limit(3).withColumn("origin", F.lit("/input/radar_base_reflectivity_x.png")).withColumn("height", F.lit(-1)).withColumn("data", F.lit(None).cast("binary"))
    replay("frames", [made_of.unionByName(broken)], lambda s: s, frames.convert_batch({"reflectivity": i.palette}, grids, log, sample_rate=2, min_bytes=200))
    values = F.flatten("data")
    made = i.spark.read.parquet(grids).select(
        picture_id("scan_id").alias("scan_id"), F.size(values).cast("long").alias("cells"), rnd(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 4).alias("total")
    )
    logged = i.spark.read.parquet(log).where("success").select(picture_id("filename").alias("scan_id"), "success")
    return made.join(logged, "scan_id")
