"""Stateful processors: suppression per recipient scope and health edges per source."""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from gustfront.constants import ALERT_POLL_SECONDS, MAX_SCORE_AGE_SECONDS, RISK_THRESHOLD
from gustfront.functions.health import seconds_between
from gustfront.functions.text import model_state, shown_score
from gustfront.operators.suppression import DECISIONS, Policy, ScopeState, cycle_counters, ledger_rows, scope_totals
from gustfront.sinks.tables import committed_folders, write_snapshot


HOUR = 3_600_000_000
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


class SuppressionProcessor(StatefulProcessor):
    """The policy's memory of one scope: ids seen, last send per type, last send of all.

    A call to the state store costs far more than a decision, so none is made for a single id. A scope of at most ``INLINE`` ids is one value,
    read and written once a batch. The ids of a larger one lie in ``BUCKETS`` hashed buckets, of which a batch touches those of its ids.

    Ids older than the ledger span go by poll time, not wall clock, so a replay of old polls decides as the live run
    did. The buckets that take ids are also noted under the hour these were handled in; when an hour has left the span, the
    buckets noted there are cleared of old ids, so no sweep reads the buckets that stay.
    """

    INLINE, BUCKETS = 1000, 256

    def __init__(self, policy: Policy = Policy()):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "bucket int", "ids array<string>, ats array<bigint>")
        self.noted = handle.getMapState("noted", "hour bigint, part int", "buckets array<int>")
        self.hours = handle.getMapState("hours", "hour bigint", "parts int")
        self.head = handle.getValueState("head", "last bigint, cycle bigint, sent int, events array<string>, sends array<bigint>, ids array<string>, ats array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        """One micro-batch of one scope, bounded by the files of a trigger."""
        polls = pd.concat(list(rows), ignore_index=True).sort_values(["cycle_us", "feed_pos"])
        state = self.load(polls["alert_id"].unique())
        known = dict(state.seen)
        out = []
        for alert_id, event, now, pos, delivered in zip(polls["alert_id"], polls["event"], polls["cycle_us"].tolist(), polls["feed_pos"].tolist(), polls["delivered"].tolist()):
            state.enter(now, self.policy)
            outcome = state.decide(alert_id, event, now, delivered, self.policy)
            if outcome:
                out.append((key[0], alert_id, now, pos, outcome))
        self.store(state, known)
        yield _decisions(out)

    def bucket(self, alert_id: str) -> int:
        return zlib.crc32(alert_id.encode()) % self.BUCKETS

    def load(self, ids: Iterable[str]) -> ScopeState:
        """The state as far as decisions about ``ids`` need it."""
        state, held, self.inline = ScopeState(), {}, True
        head = self.head.get()
        if head:
            state.last, state.cycle, state.sent_in_cycle, events, sends, inline, ats = head
            state.by_type = dict(zip(events, sends, strict=True))
            self.inline = inline is not None
            held = dict(zip(inline, ats, strict=True)) if self.inline else self.stored_ids({self.bucket(a) for a in ids if isinstance(a, str)})
        state.seen = dict(sorted(held.items(), key=lambda x: x[1]))
        return state

    def stored_ids(self, buckets: set[int]) -> dict[str, int]:
        if 4 * len(buckets) > self.BUCKETS:
            values = (v for (k,), v in self.seen.iterator() if k in buckets)
        else:
            values = (self.seen.getValue((k,)) for k in sorted(buckets) if self.seen.containsKey((k,)))
        return {a: at for ids, ats in values for a, at in zip(ids, ats, strict=True)}

    def store(self, state: ScopeState, known: dict[str, int]) -> None:
        cutoff = None if state.cycle is None else state.cycle - self.policy.keep_seconds * 1_000_000
        seen = state.seen if cutoff is None else {a: at for a, at in state.seen.items() if at >= cutoff}
        inline = self.inline and len(seen) <= self.INLINE
        if not inline:
            self.store_ids(seen, {} if self.inline else known)
            if cutoff is not None:
                self.forget(cutoff)
        ids = (list(seen), list(seen.values())) if inline else (None, None)
        self.head.update((state.last, state.cycle, state.sent_in_cycle, list(state.by_type), list(state.by_type.values()), *ids))

    def store_ids(self, seen: dict[str, int], known: dict[str, int]) -> None:
        """Write the buckets in which ids are new; all ids of these have been read."""
        fresh: dict[int, set[int]] = {}
        for alert_id, at in seen.items():
            if known.get(alert_id) != at:
                fresh.setdefault(at // HOUR, set()).add(self.bucket(alert_id))
        touched = set().union(*fresh.values())
        held: dict[int, list[tuple[str, int]]] = {}
        for alert_id, at in seen.items():
            if (k := self.bucket(alert_id)) in touched:
                held.setdefault(k, []).append((alert_id, at))
        for k, pairs in held.items():
            self.seen.updateValue((k,), ([a for a, _ in pairs], [at for _, at in pairs]))
        for hour, buckets in fresh.items():
            part = self.hours.getValue((hour,))[0] if self.hours.containsKey((hour,)) else 0
            self.noted.updateValue((hour, part), (sorted(buckets),))
            self.hours.updateValue((hour,), (part + 1,))

    def forget(self, cutoff: int) -> None:
        """Remove the ids handled before ``cutoff`` of hours that have wholly passed it."""
        old: set[int] = set()
        for (hour,), (parts,) in list(self.hours.iterator()):  # one entry per hour of the span
            if (hour + 1) * HOUR > cutoff:
                continue
            for part in range(parts):
                old.update(self.noted.getValue((hour, part))[0])
                self.noted.removeKey((hour, part))
            self.hours.removeKey((hour,))
        for k in sorted(old):
            if self.seen.containsKey((k,)):
                ids, ats = self.seen.getValue((k,))
                stay = [(a, at) for a, at in zip(ids, ats, strict=True) if at >= cutoff]
                if not stay:
                    self.seen.removeKey((k,))
                elif len(stay) < len(ids):
                    self.seen.updateValue((k,), ([a for a, _ in stay], [at for _, at in stay]))

    def close(self) -> None:
        pass


def _decisions(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["scope", "alert_id", "cycle_us", "feed_pos", "outcome"])


class PendingProcessor(SuppressionProcessor):
    """The policy over a feed that names an alert once: what is deferred or not delivered waits in state.

    A waiting alert is offered again at the first poll time at which its outcome can differ: the next one after the cycle
    cap or a send of its type, the first one after the cool-off. An event-time timer stands at the earliest of
    these, so a scope that receives nothing more is still served. An alert stops waiting when it expires. Polls are taken
    to happen at whole multiples of ``poll_seconds``, and offers of one poll are decided in feed order, as in a feed that
    repeats its alerts. A row that names a waiting alert again replaces it, which is how a delivery that failed is retried.
    """

    FAR = 1 << 62

    def __init__(self, policy: Policy = Policy(), poll_seconds: int = ALERT_POLL_SECONDS):
        super().__init__(policy)
        self.poll = poll_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "alert_id string", "event string, feed_pos bigint, delivered boolean, expires bigint, due bigint, outcome string")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows), ignore_index=True).sort_values(["cycle_us", "feed_pos"])
        columns = ("cycle_us", "feed_pos", "alert_id", "event", "delivered", "expires_us")
        arrived = [x for x in zip(*(polls[c].tolist() for c in columns)) if x[5] == x[5] and x[5] is not None]
        yield self.work(key[0], arrived, int(polls["cycle_us"].max()))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.timer.clear()  # the engine has taken the timer away
        yield self.work(key[0], [], timerValues.getCurrentWatermarkInMs() * 1000)

    def after(self, at: int) -> int:
        """The first poll time later than ``at``."""
        return (at // self.poll + 1) * self.poll

    def work(self, scope: str, arrived: list[tuple], until: int) -> pd.DataFrame:
        """Decide arrivals and waiting alerts in the order of polls and feed, up to and including ``until``."""
        was = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        waiting = {a: list(v) for a, v in was.items()}
        state = self.load({x[2] for x in arrived} | set(waiting))
        known = dict(state.seen)
        out, at = [], 0
        while True:
            now = min([w[4] for w in waiting.values()] + ([arrived[at][0]] if at < len(arrived) else []), default=self.FAR)
            if now > until:
                break
            while at < len(arrived) and arrived[at][0] == now:
                _, pos, alert_id, event, delivered, expires = arrived[at]
                if alert_id:
                    waiting[alert_id] = [event, pos, bool(delivered), int(expires), now, None]
                at += 1
            state.enter(now, self.policy)
            offers = [(w[1], a) for a, w in waiting.items() if w[4] <= now]
            heapq.heapify(offers)
            while offers:
                pos, alert_id = heapq.heappop(offers)
                event, _, delivered, expires, _, earlier = waiting[alert_id]
                outcome = state.decide(alert_id, event, now, delivered, self.policy) if expires > now else None
                if outcome and outcome != earlier:
                    out.append((scope, alert_id, now, pos, outcome))
                if outcome in (None, "sent", "suppressed_daily_cap"):
                    del waiting[alert_id]
                else:
                    due = self.after(now) if outcome == "deferred_cycle_cap" else self.after(state.last + self.policy.cool_off_seconds * 1_000_000) if outcome == "deferred_cool_off" else expires
                    waiting[alert_id][4:] = [due, outcome]
                if outcome == "sent":  # alerts of the type that wait are capped now: later ones at this poll, earlier ones at the next
                    for other, w in waiting.items():
                        if w[0] == event and w[4] > now:
                            if w[1] > pos:
                                w[4] = now
                                heapq.heappush(offers, (w[1], other))
                            else:
                                w[4] = min(w[4], self.after(now))
        self.store(state, known)
        for alert_id in was.keys() - waiting.keys():
            self.waiting.removeKey((alert_id,))
        for alert_id, w in waiting.items():
            if was.get(alert_id) != tuple(w):
                self.waiting.updateValue((alert_id,), tuple(w))
        self.set_timer(min((w[4] for w in waiting.values()), default=None))
        return _decisions(out)

    def set_timer(self, due: int | None) -> None:
        wanted = None if due is None else -(-due // 1000)
        standing = self.timer.get()[0] if self.timer.exists() else None
        if standing == wanted:
            return
        if standing in list(self.handle.listTimers()):
            self.handle.deleteTimer(standing)
        if wanted is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(wanted)
            self.timer.update((wanted,))


def suppress_stream(alerts: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Decisions over a stream of ``alerts(scope, alert_id, event, cycle_ts, feed_pos, delivered)``.

    Polls must arrive in order per scope, as files of one landing folder do. The feed repeats whatever is still
    active, so deferred alerts come again with the next poll; ``suppress_pending_stream`` serves a feed that does not.
    """
    return _stream(alerts, SuppressionProcessor(policy), "None")


def suppress_pending_stream(alerts: DataFrame, policy: Policy = Policy(), poll_seconds: int = ALERT_POLL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """As ``suppress_stream``, over a feed that names each alert once, with its ``expires``.

    Deferred alerts and failed deliveries wait in state and are offered again by event-time timers. Decisions
    are given when an alert's outcome changes. Rows more than ``late`` behind the newest poll of all scopes are dropped.
    An alert without ``expires`` is not taken up, as at the gate.
    """
    return _stream(alerts.withWatermark("cycle_ts", late), PendingProcessor(policy, poll_seconds), "EventTime")


def _stream(alerts: DataFrame, processor: SuppressionProcessor, time_mode: str) -> DataFrame:
    extra = [F.unix_micros("expires").alias("expires_us"), "cycle_ts"] if time_mode == "EventTime" else []
    slim = alerts.where("cycle_ts is not null").select(F.col("scope").cast("string").alias("scope"), "alert_id", "event", F.unix_micros("cycle_ts").alias("cycle_us"), F.col("feed_pos").cast("long").alias("feed_pos"), "delivered", *extra)
    decided = slim.groupBy("scope").transformWithStateInPandas(statefulProcessor=processor, outputStructType=DECISIONS, outputMode="Append", timeMode=time_mode)
    return decided.withColumn("cycle_ts", F.timestamp_micros("cycle_us")).drop("cycle_us")


def observed(decisions: DataFrame, name: str = "cycle") -> DataFrame:
    """``decisions`` of a stream with the status of every micro-batch measured while it is written; no second pass is made."""
    outcome, sent_at = F.col("outcome"), F.when(F.col("outcome") == "sent", F.col("cycle_ts"))
    return decisions.observe(
        name, F.count_if(outcome == "sent").alias("sent"), F.count_if(outcome == "suppressed_daily_cap").alias("suppressed"), F.count_if(outcome.startswith("deferred")).alias("deferred"),
        F.count_if(outcome == "delivery_failed").alias("failed"), F.unix_micros(F.max(sent_at)).alias("last_sent_us"), F.unix_micros(F.max("cycle_ts")).alias("last_poll_us"),
    )


class StatusListener(StreamingQueryListener):
    """Writes the status snapshot of each micro-batch from its observed metrics, under the batch's number.

    Totals carry on from the snapshot before. A replayed batch writes its own snapshot again, so nothing counts twice.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "cycle", policy: Policy = Policy()):
        self.spark, self.path, self.name, self.policy = spark, path, name, policy

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        metrics = event.progress.observedMetrics.get(self.name)
        if metrics is not None:
            self.write(event.progress.batchId, metrics.asDict())

    def write(self, batch: int, metrics: dict) -> None:
        earlier = [p for p in committed_folders(self.spark, self.path, "version") if int(p.rsplit("=", 1)[1]) < batch]
        before = self.spark.read.parquet(max(earlier, key=lambda p: int(p.rsplit("=", 1)[1]))).first() if earlier else None
        last = max((x for x in (metrics["last_sent_us"], before and before["last_sent_us"]) if x is not None), default=None)
        poll = max((x for x in (metrics["last_poll_us"], before and before["last_poll_us"]) if x is not None), default=None)
        until = last + self.policy.cool_off_seconds * 1_000_000 if last is not None else None
        row = (batch, *(metrics[c] for c in ("sent", "suppressed", "deferred", "failed")), metrics["sent"] + (before["sent_total"] if before else 0), last, poll, until if until and poll and until > poll else None)
        status = self.spark.createDataFrame([row], "batch long, sent long, suppressed long, deferred long, failed long, sent_total long, last_sent_us long, last_poll_us long, cool_off_until_us long")
        write_snapshot(status, self.path, batch)


def record_cycles(ledger_path: str, counters_path: str) -> Callable[[DataFrame, int], None]:
    """Batch function: ledger rows and cycle counters of one micro-batch, keyed by its id.

    Totals per scope are a snapshot of their own beside the counters, from which the next batch carries on. A
    replayed batch starts from the totals before it and overwrites its own folders, so nothing is counted twice.
    """
    totals_path = f"{counters_path}-totals"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [p for p in committed_folders(spark, totals_path, "version") if int(p.rsplit("=", 1)[1]) < batch_id]
        before = spark.read.parquet(max(earlier, key=lambda p: int(p.rsplit("=", 1)[1]))) if earlier else None
        decided = batch.persist()
        try:
            ledger_rows(decided).write.mode("overwrite").parquet(f"{ledger_path}/batch={batch_id}")
            counters = cycle_counters(decided, before)
            write_snapshot(counters, counters_path, batch_id)
            totals = scope_totals(counters)
            if before is not None:
                totals = totals.unionByName(before.join(totals.select("scope"), "scope", "left_anti"))
            write_snapshot(totals, totals_path, batch_id)
        finally:
            decided.unpersist()

    return run


class EdgeProcessor(StatefulProcessor):
    """Emit a notice only when a source changes between healthy and not."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.healthy = handle.getValueState("healthy", "ok boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        before = self.healthy.get()[0] if self.healthy.exists() else True
        out = []
        samples = pd.concat(list(rows), ignore_index=True).sort_values(["at_us", "sample_id"])
        for sample_id, at, code, running in zip(samples["sample_id"].tolist(), samples["at_us"].tolist(), samples["code"].tolist(), samples["running"].tolist()):
            ok = code == 200
            if ok != before:
                kind = "RECOVERED" if ok else "STALE" if code == 503 else "ERROR" if running else "DOWN"
                out.append((key[0], sample_id, at, kind))
            before = ok
        self.healthy.update((before,))
        yield pd.DataFrame(out, columns=["source", "sample_id", "at_us", "notice"])

    def close(self) -> None:
        pass


def health_edges(samples: DataFrame) -> DataFrame:
    """Notices over a stream of ``samples(source, sample_id, at, code, running)``."""
    slim = samples.select(F.col("source").cast("string").alias("source"), F.col("sample_id").cast("long").alias("sample_id"), F.unix_micros("at").alias("at_us"), F.col("code").cast("int").alias("code"), "running")
    return slim.groupBy("source").transformWithStateInPandas(
        statefulProcessor=EdgeProcessor(), outputStructType="source string, sample_id bigint, at_us bigint, notice string", outputMode="Append", timeMode="None"
    )


class AsOfProcessor(StatefulProcessor):
    """The last score at or before each alert, given once no earlier score can come any more.

    Alerts wait until the watermark of both streams has passed their time; so an answer is final, and a score that comes later
    than allowed changes none. Of the scores only the last one before the watermark and those after it are kept.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, row string")
        self.scores = handle.getListState("scores", "at bigint, id bigint, score double, status string")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        first = self.LAST
        for part in rows:  # in pieces, whatever their order
            told = part.loc[part["row"].isna(), ["at_us", "score_id", "score", "status"]]
            if len(told):
                self.scores.appendList([(int(at), int(id_), None if pd.isna(score) else float(score), None if pd.isna(status) else status) for at, id_, score, status in told.itertuples(index=False)])
            asked = part.loc[part["row"].notna(), ["at_us", "row"]]
            if len(asked):
                self.waiting.appendList([(int(at), row) for at, row in asked.itertuples(index=False)])
                first = min(int(asked["at_us"].min()), first)
        passed, standing = timer_values.getCurrentWatermarkInMs(), self.timer.get() if self.timer.exists() else None
        due = min(self.due(first), standing[0]) if standing else self.due(first) if first < self.LAST else None
        if due is None or due <= passed:
            yield self.answer(passed * 1000)
        else:  # nothing that waits can be answered yet, so nothing that is kept is read
            self.set_timer(due)
            yield self.answers([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield self.answer(timerValues.getCurrentWatermarkInMs() * 1000)

    def answer(self, passed: int) -> pd.DataFrame:
        """Answer the alerts before ``passed``; rows at the watermark itself may still come."""
        waiting = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        known = sorted(map(tuple, self.scores.get() if self.scores.exists() else []), key=lambda k: k[:2])
        times = [k[:2] for k in known]
        ready = bisect.bisect_left(waiting, (passed,))
        out = []
        for at, row in waiting[:ready]:
            n = bisect.bisect_right(times, (at, self.LAST)) - 1
            out.append((row, *known[n]) if n >= 0 else (row, None, None, None, None))
        if ready:
            self.waiting.clear()
            if waiting[ready:]:
                self.waiting.put(waiting[ready:])
        old = max(0, bisect.bisect_left(times, (passed,)) - 1)
        if old:
            self.scores.put(known[old:])
        self.set_timer(self.due(waiting[ready][0]) if waiting[ready:] else None)
        return self.answers(out)

    @staticmethod
    def answers(rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["row", "score_us", "score_id", "score", "status"])
        return made.astype({"score_us": "Int64", "score_id": "Int64", "score": "float64"})

    LAST = (1 << 63) - 1

    @staticmethod
    def due(at: int) -> int:
        """The watermark (milliseconds) at which an alert of ``at`` (microseconds) can be answered."""
        return -(-at // 1000) + 1

    def set_timer(self, due: int | None) -> None:
        standing = self.timer.get()[0] if self.timer.exists() else None
        if due is not None and standing != due:
            if standing in list(self.handle.listTimers()):
                self.handle.deleteTimer(standing)
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def close(self) -> None:
        pass


def as_of_scores(alerts: DataFrame, scores: DataFrame, threshold: float = RISK_THRESHOLD, late: str = "10 minutes", buckets: int = 8) -> DataFrame:
    """``alerts`` (cycle_ts, feed_pos, ...) with the score known at their cycle, over two streams.

    Alerts are dealt into ``buckets``; the scores (score_id, score_ts, score, status) go to every bucket, so they must be few: feeds of any
    size meet in ``feeds.as_of_batch``. An alert comes out when both streams have passed its time by ``late``, which is also how late a row of either may be.
    """
    none = lambda t: F.lit(None).cast(t)
    asked = alerts.withWatermark("cycle_ts", late).where("cycle_ts is not null").select(
        F.col("cycle_ts").alias("at"), F.pmod(F.xxhash64("feed_pos"), F.lit(buckets)).cast("int").alias("bucket"), F.unix_micros("cycle_ts").alias("at_us"), F.to_json(F.struct(*alerts.columns), {"timestampFormat": STAMP}).alias("row"),
        none("bigint").alias("score_id"), none("double").alias("score"), none("string").alias("status"),
    )
    told = scores.withWatermark("score_ts", late).where("score_ts is not null").select(
        F.col("score_ts").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.unix_micros("score_ts").alias("at_us"), none("string").alias("row"),
        F.col("score_id").cast("bigint").alias("score_id"), F.col("score").cast("double").alias("score"), F.col("status").cast("string").alias("status"),
    )
    met = asked.union(told).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=AsOfProcessor(), outputStructType="row string, score_us bigint, score_id bigint, score double, status string", outputMode="Append", timeMode="EventTime"
    )
    back = met.select(F.from_json("row", alerts.schema, {"timestampFormat": STAMP}).alias("a"), F.timestamp_micros("score_us").alias("score_ts"), "score", "status")
    usable = shown_score(F.col("score"), F.col("status"))
    age = F.when(usable.isNotNull(), seconds_between(F.col("score_ts"), F.col("a.cycle_ts")))
    return back.select("a.*", usable.alias("score"), age.alias("score_age"), model_state(F.col("score"), F.col("status"), age, threshold, MAX_SCORE_AGE_SECONDS).alias("model_state"))
