"""Alert gate, score annotation and the layered suppression policy (batch replay)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustfront.constants import (
    ALLOWED_EVENTS, COOL_OFF_BYPASS, COOL_OFF_SECONDS, DAILY_CAP_SECONDS, LEDGER_HOURS, MAX_SCORE_AGE_SECONDS, PER_CYCLE_CAP, RISK_THRESHOLD,
)
from gustfront.functions.health import seconds_between
from gustfront.functions.text import model_state, shown_score, utc_text
from gustfront.operators.pairing import last_known
from gustfront.operators.timeline import along_time, recent_sends
from gustfront.session import materialise, scratch_path


def allowed_active(alerts: DataFrame, now: Column, events=ALLOWED_EVENTS) -> DataFrame:
    """Alerts of allowed types that have not expired; a missing or due expiry drops the alert."""
    return alerts.where(F.col("event").isin(*events) & (F.col("expires") > now))


def annotate_with_score(alerts: DataFrame, scores: DataFrame, threshold: float = RISK_THRESHOLD, max_age: int = MAX_SCORE_AGE_SECONDS) -> DataFrame:
    """Add the score known at each alert's cycle, its age and the readout label."""
    facts = scores.select("score_id", "score_ts", "score", "status")
    known = last_known(alerts, facts, "cycle_ts", "score_ts", "score_id")
    asked = known.withColumnRenamed("cycle_ts", "_asked")
    joined = alerts.join(asked, F.col("cycle_ts") == F.col("_asked"), "left")  # an alert without a cycle time has no score
    usable = shown_score(F.col("fact.score"), F.col("fact.status"))
    age = F.when(usable.isNotNull(), seconds_between(F.col("fact.score_ts"), F.col("cycle_ts")))
    return joined.select(
        *alerts.columns, usable.alias("score"), age.alias("score_age"),
        model_state(F.col("fact.score"), F.col("fact.status"), age, threshold, max_age).alias("model_state"),
    )


def any_delivered(results: str) -> Column:
    """One accepted recipient makes a delivery; ``results`` is an array of (to, err)."""
    return F.exists(results, lambda r: r["err"].isNull())


def split_recipients(ledger: DataFrame, results: str) -> DataFrame:
    ok = F.transform(F.filter(results, lambda r: r["err"].isNull()), lambda r: r["to"])
    return ledger.withColumn("recipients_ok", ok).withColumn("recipients_failed", F.filter(results, lambda r: r["err"].isNotNull()))


@dataclass(frozen=True)
class Policy:
    cap_seconds: int = DAILY_CAP_SECONDS
    cool_off_seconds: int = COOL_OFF_SECONDS
    cycle_cap: int = PER_CYCLE_CAP
    keep_seconds: int = LEDGER_HOURS * 3600
    bypass: tuple[str, ...] = COOL_OFF_BYPASS


@dataclass
class ScopeState:
    """What one recipient scope remembers: ids seen, last send per type, last send of all, cycle count."""

    seen: dict[str, int] = field(default_factory=dict)
    by_type: dict[str, int] = field(default_factory=dict)
    last: int | None = None
    cycle: int | None = None
    sent_in_cycle: int = 0

    def enter(self, cycle: int, policy: Policy) -> None:
        if cycle != self.cycle:
            self.cycle, self.sent_in_cycle = cycle, 0
            cutoff = cycle - policy.keep_seconds * 1_000_000
            # ids are kept in the order in which they were handled, so the expired ones stand first
            while self.seen and next(iter(self.seen.values())) < cutoff:
                del self.seen[next(iter(self.seen))]

    def decide(self, alert_id: str, event: str, now: int, delivered: bool, policy: Policy) -> str | None:
        """Outcome of one alert, in the fixed order of the rules; None for one already handled."""
        if not alert_id or alert_id in self.seen:
            return None
        if self.sent_in_cycle >= policy.cycle_cap:
            return "deferred_cycle_cap"
        if self.by_type.get(event, -(1 << 62)) >= now - policy.cap_seconds * 1_000_000:
            self.seen[alert_id] = now
            return "suppressed_daily_cap"
        if event not in policy.bypass and self.last is not None and self.last >= now - policy.cool_off_seconds * 1_000_000:
            return "deferred_cool_off"
        if not delivered:
            return "delivery_failed"
        self.seen[alert_id] = self.by_type[event] = self.last = now
        self.sent_in_cycle += 1
        return "sent"


DECISIONS = "scope string, alert_id string, cycle_us bigint, feed_pos bigint, outcome string"


#: Polls of one scope that a chunk of its replay holds, about: seconds of work, so that a round's fixed cost is small beside it.
CHUNK_POLLS = 500_000
#: Polls for which a step of the replay has a task of its own, about; the number of tasks grows with the input, not what one holds.
TASK_POLLS = 50_000
EMPTY_STATE = "[[], [], null]"
_KEYS = ["scope", "segment", "chunk"]
_REPLAYED = "scope string, segment bigint, chunk bigint, alert_id string, cycle_us bigint, feed_pos bigint, outcome string, exit string"
_BEFORE_ALL = -(1 << 62)


def state_text(state: ScopeState, policy: Policy) -> str:
    """What of a state can still matter after its last cycle, in one fixed form, so that equal texts decide alike."""
    if state.cycle is None:
        return EMPTY_STATE
    now = state.cycle
    oldest = lambda seconds: now - seconds * 1_000_000
    seen = sorted([at, a] for a, at in state.seen.items() if at >= oldest(policy.keep_seconds))
    types = sorted([e, at] for e, at in state.by_type.items() if at >= oldest(policy.cap_seconds))
    last = state.last if state.last is not None and state.last >= oldest(policy.cool_off_seconds) else None
    return json.dumps([seen, types, last])


def state_from(text: str) -> ScopeState:
    seen, types, last = json.loads(text)
    return ScopeState({a: at for at, a in seen}, dict(types), last)


def _slim(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        F.col("scope").cast("string").alias("scope"), "alert_id", "event", F.unix_micros("cycle_ts").alias("cycle_us"), F.col("feed_pos").cast("long").alias("feed_pos"), "delivered",
        F.floor(F.unix_micros("cycle_ts") / F.lit(3_600_000_000)).cast("long").alias("hour"),
    )


def _chunks(slim: DataFrame, policy: Policy, chunk_polls: int, parts: int) -> DataFrame:
    """Segment and chunk of every scope-hour. Only scope-hours are ordered.

    Segments are stretches of a scope separated by so many quiet hours that nothing survives the gap. A long segment is cut
    into chunks at full hours; an hour is never cut.
    """
    hours = slim.repartition(parts, "scope", "hour").groupBy("scope", "hour").agg(F.count(F.lit(1)).alias("n")).repartition(parts, "scope")
    order = Window.partitionBy("scope").orderBy("hour")
    longest = max(policy.keep_seconds, policy.cap_seconds, policy.cool_off_seconds)
    fresh = (F.col("hour") - F.lag("hour").over(order) >= longest // 3600 + 2).cast("int")
    cut = hours.withColumn("fresh", F.coalesce(fresh, F.lit(0))).withColumn("segment", F.sum("fresh").over(order))
    inside = Window.partitionBy("scope", "segment").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    filled = cut.withColumn("filled", F.floor(F.coalesce(F.sum("n").over(inside), F.lit(0)) / chunk_polls))
    number = F.dense_rank().over(Window.partitionBy("scope", "segment").orderBy("filled")) - 1
    return filled.select("scope", "hour", "segment", number.cast("long").alias("chunk"))


def _replayed(polls: DataFrame, policy: Policy, parts: int) -> DataFrame:
    """Decisions of every chunk, from its ``entry`` row's state or an empty one, and one row with the state it ends in.

    A chunk is streamed from the sorted shuffle in Arrow batches; its entry row sorts before its polls.
    """
    ordered = polls.repartition(parts, *_KEYS).sortWithinPartitions(*_KEYS, "cycle_us", "feed_pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current = ScopeState(), None
        end = lambda: [(*current, None, None, None, None, state_text(state, policy))] if current else []
        columns = ["scope", "segment", "chunk", "alert_id", "event", "cycle_us", "feed_pos", "delivered", "entry"]
        for batch in batches:
            out = []
            for scope, segment, chunk, alert_id, event, now, pos, delivered, entry in zip(*(batch[c].tolist() for c in columns)):
                if (scope, segment, chunk) != current:
                    out += end()
                    state, current = ScopeState(), (scope, segment, chunk)
                if now == _BEFORE_ALL:
                    state = state_from(entry)
                    continue
                state.enter(now, policy)
                outcome = state.decide(alert_id, event, now, delivered, policy)
                if outcome:
                    out.append((scope, segment, chunk, alert_id, now, pos, outcome, None))
            yield _frame(out)
        yield _frame(end())

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["scope", "segment", "chunk", "alert_id", "cycle_us", "feed_pos", "outcome", "exit"])
        return made.astype({"cycle_us": "Int64", "feed_pos": "Int64"})

    return ordered.mapInPandas(run, _REPLAYED)


def replay_in_rounds(alerts: DataFrame, policy: Policy = Policy(), chunk_polls: int = CHUNK_POLLS) -> tuple[DataFrame, list[int]]:
    """The decisions of ``replay_suppression`` and the number of chunks replayed in each round.

    Rules of a scope depend on its earlier sends, so a long segment is replayed speculatively: all its chunks at once from an
    empty state, then, again at once, each chunk whose predecessor ended in another state than the chunk began with, until none
    is left. A chunk is right once all before it are, so there are at most as many rounds as a segment has chunks, and
    few where types or ids pause now and then. States and decisions stay in tables of the shared folder; the
    driver sees counts only. The number of tasks follows the number of polls (``TASK_POLLS``), as adaptive coalescing would let a task
    grow with the input.
    """
    spark = alerts.sparkSession
    slim = materialise(_slim(alerts), "replay-slim")
    parts = max(1, -(-slim.count() // TASK_POLLS))
    chunks = materialise(_chunks(slim, policy, chunk_polls, parts), "replay-chunks")
    hourly = ["scope", "hour"]
    placed = slim.repartition(parts, *hourly).join(chunks.repartition(parts, *hourly), hourly).drop("hour").withColumn("entry", F.lit(None).cast("string"))
    long = chunks.where("chunk > 0").select("scope", "segment").distinct()
    if long.isEmpty():
        return _replayed(placed, policy, parts), [chunks.select(*_KEYS).distinct().count()]
    polls = materialise(placed.join(long, ["scope", "segment"], "left_semi"), "replay-polls")
    known = chunks.join(long, ["scope", "segment"], "left_semi").select(*_KEYS).distinct()
    done, entered = scratch_path(spark, "replay-rounds"), scratch_path(spark, "replay-entries")
    entry_schema = "scope string, segment bigint, chunk bigint, entry string"

    def written(df: DataFrame, path: str, number: int) -> None:
        df.write.parquet(f"{path}/round={number}")

    def newest(path: str, schema: str, value: str) -> DataFrame:
        rows = spark.read.schema(f"{schema}, round int").option("basePath", path).parquet(path)
        return rows.where(F.col(value).isNotNull()).groupBy(*_KEYS).agg(F.max_by(value, "round").alias(value))

    written(_replayed(polls, policy, parts), done, 1)
    written(known.withColumn("entry", F.lit(EMPTY_STATE)), entered, 1)
    rounds = [known.count()]
    while True:
        exits = newest(done, _REPLAYED, "exit").select("scope", "segment", (F.col("chunk") + 1).alias("chunk"), "exit")
        stale = exits.join(newest(entered, entry_schema, "entry"), _KEYS).where("exit <> entry").select(*_KEYS, F.col("exit").alias("entry"))
        number = len(rounds) + 1
        written(stale, entered, number)
        again = spark.read.schema(entry_schema).parquet(f"{entered}/round={number}")
        count = again.count()
        if not count:
            break
        rounds.append(count)
        given = {c: F.col(c) for c in (*_KEYS, "entry")} | {"cycle_us": F.lit(_BEFORE_ALL), "feed_pos": F.lit(0)}
        first = again.select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in polls.dtypes))
        written(_replayed(polls.join(again.select(*_KEYS), _KEYS, "left_semi").unionByName(first), policy, parts), done, number)
    last = spark.read.schema(f"{entry_schema}, round int").option("basePath", entered).parquet(entered).groupBy(*_KEYS).agg(F.max("round").alias("round"))
    final = spark.read.schema(f"{_REPLAYED}, round int").option("basePath", done).parquet(done).join(last, [*_KEYS, "round"]).select(*_names(_REPLAYED))
    return final.unionByName(_replayed(placed.join(long, ["scope", "segment"], "left_anti"), policy, parts)), rounds


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def replay_suppression(alerts: DataFrame, policy: Policy = Policy(), chunk_polls: int = CHUNK_POLLS) -> DataFrame:
    """Run the policy over recorded polls: ``alerts(scope, alert_id, event, cycle_ts, feed_pos, delivered)``.

    Returns one row per decision; repeats of handled alerts give none. A busy scope is replayed in chunks on all cores
    (``replay_in_rounds``), and a task holds 48 hours of ids. Polls without scope or time take no part.
    """
    decided, _ = replay_in_rounds(alerts, policy, chunk_polls)
    return decided.where("outcome is not null").select("scope", "alert_id", F.timestamp_micros("cycle_us").alias("cycle_ts"), "feed_pos", "outcome")


def ledger_rows(decisions: DataFrame) -> DataFrame:
    """Decisions that enter the ledger; deferrals and failures do not."""
    return decisions.where(F.col("outcome").isin("sent", "suppressed_daily_cap"))


def full_ledger(decisions: DataFrame, alerts: DataFrame, scores: DataFrame, results: str = "results", policy: Policy = Policy(), threshold: float = RISK_THRESHOLD) -> DataFrame:
    """The ledger that a cycle leaves: type, time, outcome, model readout, recipients and reason of every decision that enters it.

    ``alerts`` are the polls that were decided, with ``results`` (an array of to, err). A suppressed alert has no recipients and names the send
    that capped it: the first one of its type and scope inside the cap's span.
    """
    keys = ["scope", "alert_id", "cycle_ts", "feed_pos"]
    polls = alerts.select(F.col("scope").cast("string").alias("scope"), *keys[1:], F.col("event").alias("event_type"), F.col(results).alias("_results")).dropDuplicates(keys)
    kept = ledger_rows(decisions).join(polls, keys)
    sends = kept.select("scope", "event_type", F.col("cycle_ts").alias("sent_at"), "outcome")
    asked = kept.where("outcome <> 'sent'").select("scope", "event_type", F.col("cycle_ts").alias("at"))
    capped = recent_sends(asked, sends, "at", ["scope", "event_type"], policy.cap_seconds).select("scope", F.col("event_type").alias("_type"), F.col("at").alias("_at"), "first_sent")
    named = annotate_with_score(kept, scores, threshold).join(capped.withColumnRenamed("scope", "_scope"), (F.col("scope") == F.col("_scope")) & F.col("event_type").eqNullSafe(F.col("_type")) & (F.col("cycle_ts") == F.col("_at")), "left")
    sent = F.col("outcome") == "sent"
    none = F.filter("_results", lambda r: F.lit(False))
    split = split_recipients(named.withColumn("_results", F.when(sent, F.col("_results")).otherwise(none)), "_results")
    reason = F.when(~sent, F.concat(F.lit("daily cap: last sent "), utc_text(F.col("first_sent"))))
    return split.select("scope", "alert_id", "event_type", F.col("cycle_ts").alias("sent_at"), "outcome", "model_state", "score", F.lit(threshold).alias("threshold"), "recipients_ok", "recipients_failed", reason.alias("reason"))


def cycle_counters(decisions: DataFrame, before: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:
    """Sent, suppressed and deferred per scope and cycle, with the sends so far, the last one and the end of the running cool-off.

    ``before`` carries on from earlier decisions: one row per scope with ``sent_total`` and ``last_sent``.
    """
    counts = _cycle_counts(decisions).withColumn("_tie", F.lit(0))
    line = along_time(counts, ["scope"], "cycle_ts", "_tie", sums={"sent_total": F.col("sent")}, lasts={"last_sent": F.when(F.col("sent") > 0, F.col("cycle_ts"))}).drop("_tie")
    if before is not None:
        line = line.join(before.select("scope", F.col("sent_total").alias("_n"), F.col("last_sent").alias("_at")), "scope", "left")
        line = line.withColumn("sent_total", F.col("sent_total") + F.coalesce("_n", F.lit(0))).withColumn("last_sent", F.coalesce("last_sent", "_at")).drop("_n", "_at")
    end = F.col("last_sent") + F.make_dt_interval(secs=F.lit(policy.cool_off_seconds))
    return line.withColumn("cool_off_until", F.when(end > F.col("cycle_ts"), end))


def scope_totals(counters: DataFrame) -> DataFrame:
    """The last counters of every scope, for the next call's ``before``."""
    last = F.max_by(F.struct("sent_total", "last_sent"), "cycle_ts").alias("l")
    return counters.groupBy("scope").agg(last).select("scope", "l.*")


def _cycle_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("scope", "cycle_ts").agg(
        F.count_if(F.col("outcome") == "sent").alias("sent"), F.count_if(F.col("outcome") == "suppressed_daily_cap").alias("suppressed"),
        F.count_if(F.col("outcome") == "deferred_cool_off").alias("deferred_cool_off"), F.count_if(F.col("outcome") == "deferred_cycle_cap").alias("deferred_cap"),
    )
