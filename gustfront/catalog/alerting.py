"""Queries of alert gating, annotation, wording and suppression."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustfront.catalog.registry import query, sql_stamp, stamp
from gustfront.constants import ALLOWED_EVENTS, EVENT_CODES
from gustfront.functions import text
from gustfront.operators import service, suppression, timeline
from gustfront.session import dealt_alike

ALLOWED = "event in (" + ", ".join(f"'{e}'" for e in ALLOWED_EVENTS) + ")"


@query("p05_allowed_active_alerts", f"select feed_pos, alert_id from {{alerts}} where {ALLOWED} and expires > cycle_ts")
def _(i):
    return suppression.allowed_active(i.alerts, F.col("cycle_ts")).select("feed_pos", "alert_id")


KNOWN = """k as (select a.feed_pos, a.alert_id, a.event, a.cycle_ts, a.expires, s.* from {alerts} a asof left join {scores} s on a.cycle_ts >= s.score_ts),
 m as (select *, case when score is null or status is null or status in ('uninitialized', 'error') then null else score end as shown,
   case when score is null or status is null or status in ('uninitialized', 'error') then null else epoch_us(cycle_ts) // 1000000 - epoch_us(score_ts) // 1000000 end as age from k),
 z as (select *, case when shown is null or age > 1800 or status = 'stale' then 'unavailable' when shown >= 0.8e0 then 'elevated' else 'not elevated' end as state from m)"""


@query("j12_h08_alert_score_annotation", f"with {KNOWN} select feed_pos, shown as score, age as score_age, state as model_state from z")
def _(i):
    return suppression.annotate_with_score(i.alerts, i.scores).select("feed_pos", "score", "score_age", "model_state")


@query(
    "w09_carried_score",
    f"""select score_id, {sql_stamp('score_ts')} as score_ts, last_value(score ignore nulls) over w as last_score,
      case when score is not null then status when last_value(score ignore nulls) over w is not null then 'stale' else 'uninitialized' end as cycle_status
    from {{scores}} window w as (order by score_ts, score_id rows between unbounded preceding and current row)""",
)
def _(i):
    return timeline.carried_score(i.scores).select("score_id", stamp("score_ts").alias("score_ts"), "last_score", "cycle_status")


CODE = "case event " + " ".join(f"when '{e}' then '{c}'" for e, c in EVENT_CODES.items()) + " else upper(left(regexp_replace(event, '([A-Za-z])[a-z]* ?', '\\1', 'g'), 4)) end"


@query("h04_event_codes", f"select feed_pos, {CODE} as code from {{alerts}}")
def _(i):
    return i.alerts.select("feed_pos", text.event_code(F.col("event")).alias("code"))


@query(
    "h05_csv_list",
    "select page_id, array_to_string(list_filter(list_transform(string_split(replace(url, '/', ' , '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') as parts from {pages}",
)
def _(i):
    return i.pages.select("page_id", F.array_join(text.csv_list(F.replace("url", F.lit("/"), F.lit(" , "))), "|").alias("parts"))


@query(
    "h03_iso_round_trip",
    "select event_id, case when event_id % 5 = 0 then null else strftime(cast(ts as timestamp) - case when event_id % 2 = 0 then interval '-5' hour else interval '0' hour end, '%Y-%m-%dT%H:%M:%SZ') end as iso from {events}",
)
def _(i):
    # local wall-clock text with an offset (or Z); every fifth is not a date
    shown = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    sent = F.when(F.col("event_id") % 5 == 0, F.lit("soon")).otherwise(F.concat(shown, F.when(F.col("event_id") % 2 == 0, "-05:00").otherwise("Z")))
    return i.events.select("event_id", text.utc_text(text.parse_iso(sent)).alias("iso"))


MESSAGE = f"""with {KNOWN}, t as (select *, 'Area ' || repeat('x', cast(feed_pos % 50 as int)) as area, case when feed_pos % 3 = 0 then '' else 'Headline ' || alert_id end as headline, strftime(expires, '%Y-%m-%dT%H:%M:%SZ') as exp,
  {CODE} as code, case state when 'elevated' then 'ELEVATED' when 'not elevated' then 'NOT ELEV' else 'N/A' end as short, coalesce(printf('%.2f', shown), '—') as stext from z)"""


def messages(i):
    a = suppression.annotate_with_score(i.alerts, i.scores)
    area = F.concat(F.lit("Area "), F.expr("repeat('x', cast(feed_pos % 50 as int))"))
    return a.select(
        "feed_pos", "event", area.alias("area"), F.when(F.col("feed_pos") % 3 == 0, "").otherwise(F.concat(F.lit("Headline "), F.col("alert_id"))).alias("headline"),
        text.utc_text(F.col("expires")).alias("exp"), "score", "score_age", "model_state",
    )


@query(
    "h07_short_message",
    MESSAGE + """ select feed_pos, case when event = 'Tornado Warning' then code || ' ' || left(area, 35) || ' (model:' || short || ')' else code || ' ' || left(area, 40) end as subject,
      case when event = 'Tornado Warning' then 'Tornado Warning until ' || left(exp, 16) || '. Model ' || short || ' (' || stext || ' vs 0.80). Heed NWS. Full details emailed.'
        else event || ' until ' || left(exp, 16) || '. Heed NWS. Full details emailed.' end as body from t""",
)
def _(i):
    c, thr = F.col, F.lit(0.8)
    return messages(i).select(
        "feed_pos", text.short_subject(c("event"), c("area"), c("model_state")).alias("subject"),
        text.short_body(c("event"), c("exp"), c("model_state"), c("score"), thr).alias("body"),
    )


@query(
    "h06_full_message",
    MESSAGE + f""", r as (select *, 'EXPERIMENTAL MODEL READOUT — informational only, NOT an alert.' || chr(10) || chr(10) || 'Radar-signature confidence: ' || upper(state) || chr(10) || '  Score:     ' || stext || chr(10) || '  Threshold: 0.80' || chr(10)
      || '  Radar age: ' || coalesce(cast(age as string) || 's', '—') || chr(10) || '  N0B/N0S Δ: —' || chr(10) || chr(10)
      || case state when 'elevated' then '{text.ELEVATED_TEXT.replace("'", "''")}' when 'not elevated' then '{text.NOT_ELEVATED_TEXT.replace("'", "''")}' else '{text.SUPPRESSED_TEXT}' end || chr(10)
      || case when state = 'unavailable' then chr(10) || case when shown is not null and age > 1800 then 'Note: most recent radar scan available to the model is ' || cast(age as string) || 's old (>1800s threshold). The model readout is suppressed.' else '{text.NO_SCORE_NOTE}' end || chr(10) else '' end as readout from t)
    select feed_pos, case when event = 'Tornado Warning' then event || ': ' || area || ' (model: ' || state || ')' else event || ': ' || area end as subject,
      md5(upper(event) || ' — National Weather Service' || chr(10) || case when headline = '' then event else headline end || chr(10) || chr(10) || 'Area:      ' || area || chr(10) || 'Effective: —' || chr(10) || 'Expires:   ' || exp || chr(10) || chr(10)
        || 'INSTRUCTIONS (NWS):' || chr(10) || '—' || chr(10) || chr(10) || 'DESCRIPTION (NWS):' || chr(10) || '—' || chr(10) || chr(10) || repeat('─', 64) || chr(10)
        || case when event = 'Tornado Warning' then readout else '{text.NOT_APPLICABLE_TEXT.replace("'", "''")}' end || chr(10) || '{text.FOOTER_TEXT.replace("'", "''")}') as body_md5 from r""",
)
def _(i):
    c, none = F.col, F.lit(None).cast("string")
    readout = text.tornado_readout(c("model_state"), c("score"), F.lit(0.8), c("score_age"), F.lit(None).cast("int"))
    body = text.full_body(c("event"), c("area"), c("headline"), none, none, none, c("exp"), readout)
    return messages(i).select("feed_pos", text.full_subject(c("event"), c("area"), c("model_state")).alias("subject"), F.md5(body).alias("body_md5"))


@query(
    "w04_recent_send_of_type",
    f"""with q as (select distinct event as event_type, cycle_ts as t from {{alerts}}), s as (select distinct event_type, sent_at from {{ledger}} where outcome = 'sent'),
    j as (select q.event_type, q.t, min(s.sent_at) as f, max(s.sent_at) as l from q left join s on s.event_type = q.event_type and s.sent_at <= q.t and s.sent_at >= q.t - interval '24' hour group by 1, 2)
    select event_type, cast(epoch_us(t) as bigint) as at_us, {sql_stamp('f')} as first_sent, {sql_stamp('l')} as latest_sent, l is not null as recent from j""",
)
def _(i):
    asked = i.alerts.select(F.col("event").alias("event_type"), F.col("cycle_ts").alias("at"))
    got = timeline.recent_sends(asked, i.ledger, "at", ["event_type"])
    return got.select("event_type", F.unix_micros("at").alias("at_us"), stamp("first_sent").alias("first_sent"), stamp("latest_sent").alias("latest_sent"), "recent")


@query(
    "w05_cool_off_until",
    f"""with q as (select distinct cycle_ts as t from {{alerts}}), s as (select distinct sent_at from {{ledger}} where outcome = 'sent'),
    j as (select q.t, max(s.sent_at) as l from q left join s on s.sent_at <= q.t and s.sent_at >= q.t - interval '30' minute group by 1)
    select cast(epoch_us(t) as bigint) as at_us, {sql_stamp('l')} as latest_sent, {sql_stamp("l + interval '30' minute")} as cool_off_until from j""",
)
def _(i):
    asked = i.alerts.select(F.col("cycle_ts").alias("at"))
    got = timeline.cool_off_until(asked, i.ledger)
    return got.select(F.unix_micros("at").alias("at_us"), stamp("latest_sent").alias("latest_sent"), stamp("cool_off_until").alias("cool_off_until"))


@query("a23_active_by_type", f"select cast(cycle_ts as date)::string as day, event, count(*) as active from {{alerts}} where {ALLOWED} and expires > cycle_ts group by 1, 2")
def _(i):
    live = suppression.allowed_active(i.alerts, F.col("cycle_ts")).withColumn("day", F.date_format("cycle_ts", "yyyy-MM-dd"))
    return service.active_by_type(live, ["day"])


@query(
    "a23_active_snapshot",
    f"with c as (select event, count(*) as n from {{alerts}} where {ALLOWED} and expires > cycle_ts group by 1) select cast(sum(n) as bigint) as active_warnings, cast(coalesce(max(n) filter (where event = 'Tornado Warning'), 0) as bigint) as active_tornado, string_agg(event || '=' || cast(n as string), ',' order by event) as by_type from c",
)
def _(i):
    snap = service.active_snapshot(suppression.allowed_active(i.alerts, F.col("cycle_ts")))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("active_by_type")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return snap.select("active_warnings", "active_tornado", listed.alias("by_type"))


# polls of one recipient scope per user: the policy runs once per scope
SCOPED = f"""sc as (select cast(e.user_id as string) as scope, 'u' || cast(e.event_id % 3000 as string) as alert_id, a.event, a.cycle_ts as cycle_ts, a.feed_pos, a.feed_pos % 6 <> 0 as delivered,
   row_number() over (partition by e.user_id order by a.cycle_ts, a.feed_pos) as n from {{alerts}} a join {{events}} e on e.event_id = a.feed_pos where {ALLOWED})"""


def scoped_alerts(i):
    alerts, users = dealt_alike(i.alerts.where(F.col("event").isin(*ALLOWED_EVENTS)), i.events.select(F.col("event_id").alias("feed_pos"), "user_id"), "feed_pos")
    return alerts.join(users, "feed_pos").select(
        F.col("user_id").cast("string").alias("scope"), F.concat(F.lit("u"), (F.col("feed_pos") % 3000).cast("string")).alias("alert_id"), "event", "cycle_ts", "feed_pos",
        (F.col("feed_pos") % 6 != 0).alias("delivered"),
    )


# The same policy, one row per step: state is carried through a recursive query per scope.
REPLAY = f"""with recursive {SCOPED}, run as (
  select scope, 0::bigint as n, null::string as alert_id, null::bigint as feed_pos, null::timestamp as cycle_ts, null::string as outcome, map([]::string[], []::timestamp[]) as seen, map([]::string[], []::timestamp[]) as types,
    null::timestamp as last, null::timestamp as cyc, 0 as k from (select distinct scope from sc) t
  union all
  select s.scope, s.n, s.alert_id, s.feed_pos, s.cycle_ts, o.outcome,
    case when o.outcome in ('sent', 'suppressed_daily_cap') then map_concat(r.seen, map([s.alert_id], [s.cycle_ts])) else r.seen end,
    case when o.outcome = 'sent' then map_concat(r.types, map([s.event], [s.cycle_ts])) else r.types end,
    case when o.outcome = 'sent' then s.cycle_ts else r.last end, s.cycle_ts,
    case when r.cyc = s.cycle_ts then r.k else 0 end + case when o.outcome = 'sent' then 1 else 0 end
  from run r join sc s on s.scope = r.scope and s.n = r.n + 1,
  lateral (select case when r.seen[s.alert_id] >= s.cycle_ts - interval '48' hour then 'duplicate' when r.cyc = s.cycle_ts and r.k >= 5 then 'deferred_cycle_cap'
    when r.types[s.event] >= s.cycle_ts - interval '24' hour then 'suppressed_daily_cap'
    when s.event <> 'Tornado Warning' and r.last >= s.cycle_ts - interval '30' minute then 'deferred_cool_off' when not s.delivered then 'delivery_failed' else 'sent' end as outcome) o
)"""


@query("t03_t09_suppression_replay", REPLAY + " select scope, alert_id, feed_pos, outcome from run where n > 0 and outcome <> 'duplicate'")
def _(i):
    return suppression.replay_suppression(scoped_alerts(i)).select("scope", "alert_id", "feed_pos", "outcome")


@query(
    "t09_full_ledger",
    REPLAY + f", {KNOWN}" + f""", d as (select run.scope, run.n, run.alert_id, run.feed_pos, run.cycle_ts as at, run.outcome, sc.event from run join sc on sc.scope = run.scope and sc.n = run.n where run.n > 0)
    select d.scope, d.alert_id, d.event as event_type, {sql_stamp('d.at')} as sent_at, d.outcome, z.state as model_state, z.shown as score,
      cast(case when d.outcome = 'sent' then (d.feed_pos % 3 <> 0)::int + (d.feed_pos % 2 <> 0)::int else 0 end as int) as ok, cast(case when d.outcome = 'sent' then (d.feed_pos % 3 = 0)::int + (d.feed_pos % 2 = 0)::int else 0 end as int) as failed,
      case when d.outcome <> 'sent' then 'daily cap: last sent ' || strftime((select min(p.at) from d p where p.scope = d.scope and p.event = d.event and p.outcome = 'sent' and p.at <= d.at and p.at >= d.at - interval '24' hour), '%Y-%m-%dT%H:%M:%SZ') end as reason
    from d join z on z.feed_pos = d.feed_pos where d.outcome in ('sent', 'suppressed_daily_cap')""",
)
def _(i):
    # from the feed to the ledger: gate, policy, score, recipients and reason
    result = lambda name, n: F.struct(F.lit(name).alias("to"), F.when(F.col("feed_pos") % n == 0, "refused").alias("err"))
    polls = scoped_alerts(i).withColumn("results", F.array(result("a@x", 3), result("b@x", 2)))
    polls = polls.withColumn("delivered", suppression.any_delivered("results"))
    rows = suppression.full_ledger(suppression.replay_suppression(polls), polls, i.scores)
    return rows.select("scope", "alert_id", "event_type", stamp("sent_at").alias("sent_at"), "outcome", "model_state", "score", F.size("recipients_ok").alias("ok"), F.size("recipients_failed").alias("failed"), "reason")


@query(
    "t07_cycle_counters",
    REPLAY + f""", c as (select scope, run.cycle_ts, cast(count_if(outcome = 'sent') as bigint) as sent, cast(count_if(outcome = 'suppressed_daily_cap') as bigint) as suppressed,
    cast(count_if(outcome = 'deferred_cool_off') as bigint) as deferred_cool_off, cast(count_if(outcome = 'deferred_cycle_cap') as bigint) as deferred_cap from run where n > 0 and outcome <> 'duplicate' group by scope, run.cycle_ts),
    t as (select *, cast(sum(sent) over w as bigint) as sent_total, max(case when sent > 0 then cycle_ts end) over w as last_sent from c window w as (partition by scope order by cycle_ts))
    select scope, {sql_stamp('cycle_ts')} as cycle_ts, sent, suppressed, deferred_cool_off, deferred_cap, sent_total, {sql_stamp('last_sent')} as last_sent,
      {sql_stamp("case when last_sent + interval '30' minute > cycle_ts then last_sent + interval '30' minute end")} as cool_off_until from t""",
)
def _(i):
    got = suppression.cycle_counters(suppression.replay_suppression(scoped_alerts(i)))
    return got.withColumns({c: stamp(c) for c in ("cycle_ts", "last_sent", "cool_off_until")})


@query(
    "l04_cycle_cap_deferrals",
    """with a as (select 'all' as scope, cast(floor(epoch_us(cycle_ts) / 86400000000) as bigint) as day, feed_pos, row_number() over (partition by cast(floor(epoch_us(cycle_ts) / 86400000000) as bigint) order by feed_pos) as n from {alerts})
    select feed_pos, case when n <= 5 then 'sent' else 'deferred_cycle_cap' end as outcome from a""",
)
def _(i):
    # one poll per day, every alert of its own type: only the per-cycle cap can bind
    day = F.floor(F.unix_micros("cycle_ts") / F.lit(86_400_000_000)).cast("long")
    polls = i.alerts.select(
        day.cast("string").alias("scope"), F.col("feed_pos").cast("string").alias("alert_id"), F.col("feed_pos").cast("string").alias("event"),
        F.timestamp_seconds(day * 86_400).alias("cycle_ts"), "feed_pos", F.lit(True).alias("delivered"),
    )
    policy = suppression.Policy(cool_off_seconds=-1)
    return suppression.replay_suppression(polls, policy).select("feed_pos", "outcome")


@query(
    "t09_split_recipients",
    "select feed_pos, feed_pos % 3 <> 0 or feed_pos % 2 <> 0 as delivered, cast((feed_pos % 3 <> 0)::int + (feed_pos % 2 <> 0)::int as int) as ok, cast((feed_pos % 3 = 0)::int + (feed_pos % 2 = 0)::int as int) as failed from {alerts}",
)
def _(i):
    result = lambda name, n: F.struct(F.lit(name).alias("to"), F.when(F.col("feed_pos") % n == 0, "refused").alias("err"))
    rows = i.alerts.select("feed_pos", F.array(result("a@x", 3), result("b@x", 2)).alias("results"))
    split = suppression.split_recipients(rows.withColumn("delivered", suppression.any_delivered("results")), "results")
    return split.select("feed_pos", "delivered", F.size("recipients_ok").alias("ok"), F.size("recipients_failed").alias("failed"))
