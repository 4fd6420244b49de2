"""Order-dependent operators over long timelines.

A timeline is cut into slots. One summary row per slot carries state from slot to slot, and rows
are ordered only inside their slot, so one busy source is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustfront.constants import CAPTURE_INTERVAL_SECONDS, COOL_OFF_SECONDS, DAILY_CAP_SECONDS
from gustfront.session import materialise

SLOT_SECONDS = 600


def along_time(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """Add running sums, last non-null values (current row included) and previous-row values.

    Order is (``ts``, ``tie``) inside ``keys``.
    """
    sums, lasts, previous = sums or {}, lasts or {}, previous or {}
    slotted = df.withColumn("_slot", F.floor(F.unix_micros(ts) / (slot_seconds * 1_000_000)).cast("long"))
    place = F.struct(ts, tie)
    summary = [F.sum(e).alias(f"_s_{n}") for n, e in sums.items()]
    summary += [F.max_by(e, F.when(e.isNotNull(), place)).alias(f"_l_{n}") for n, e in lasts.items()]
    summary += [F.max_by(e, place).alias(f"_p_{n}") for n, e in previous.items()]
    slots = slotted.groupBy(*keys, "_slot").agg(*summary)
    by_slot = Window.partitionBy(*keys).orderBy("_slot")
    before = by_slot.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_cs_{n}") for n in sums]
    carried += [F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_cl_{n}") for n in lasts]
    carried += [F.lag(f"_p_{n}").over(by_slot).alias(f"_cp_{n}") for n in previous]
    opening = slots.select(*keys, "_slot", *carried)
    inside = Window.partitionBy(*keys, "_slot").orderBy(ts, tie)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = slotted.select(
        "*",
        F.row_number().over(inside).alias("_n"),
        *[F.sum(e).over(upto).alias(f"_is_{n}") for n, e in sums.items()],
        *[F.last(e, ignorenulls=True).over(upto).alias(f"_il_{n}") for n, e in lasts.items()],
        *[F.lag(e).over(inside).alias(f"_ip_{n}") for n, e in previous.items()],
    )
    meets = F.lit(True)
    for name in (*keys, "_slot"):  # rows without a key or time stay
        meets = meets & local[name].eqNullSafe(F.col(f"_o.{name}"))
    joined = local.join(opening.alias("_o"), meets).drop(*[F.col(f"_o.{name}") for name in (*keys, "_slot")])
    return joined.select(
        *df.columns,
        *[(F.coalesce(f"_is_{n}", F.lit(0)) + F.col(f"_cs_{n}")).alias(n) for n in sums],
        *[F.coalesce(f"_il_{n}", f"_cl_{n}").alias(n) for n in lasts],
        *[F.when(F.col("_n") == 1, F.col(f"_cp_{n}")).otherwise(F.col(f"_ip_{n}")).alias(n) for n in previous],
    )


def ranged(df: DataFrame, *order: str | Column, name: str = "ranged") -> DataFrame:
    """``df`` range-partitioned by ``order`` and written once, with its range as ``_part``.

    Ranges follow the data, so no value range or cell is hot; what happens inside a range is one window.
    """
    return materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)


def neighbours(df: DataFrame, column: str) -> DataFrame:
    """Add the next smaller and next larger value of a column of distinct values as ``before`` and ``after``."""
    parts = ranged(df, column, name="neighbours")
    ends = parts.groupBy("_part").agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    across = Window.orderBy("_part")  # one row per range
    ends = ends.select("_part", F.lag("_high").over(across).alias("_last"), F.lead("_low").over(across).alias("_next"))
    inside = Window.partitionBy("_part").orderBy(column)
    sided = parts.select("*", F.lag(column).over(inside).alias("_b"), F.lead(column).over(inside).alias("_a")).join(ends, "_part")
    return sided.select(*df.columns, F.coalesce("_b", "_last").alias("before"), F.coalesce("_a", "_next").alias("after"))


def global_rank(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """Dense 0-based position in the total order, for any distribution of keys.

    Rows are range-partitioned on the whole sort key (so ties on its first column still split),
    written once with their place in their part, and shifted by the sizes of earlier parts.
    """
    parts = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = materialise(parts, "rank")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    shift = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.join(sizes.select("_part", shift.alias("_shift")), "_part")
    return ranked.select(*df.columns, (F.col("_shift") + F.col("_place")).alias(name))


def recent_sends(
    requests: DataFrame, ledger: DataFrame, at: str = "at", by: list[str] | None = None, window_seconds: int = DAILY_CAP_SECONDS
) -> DataFrame:
    """For each distinct request, earliest and latest ``sent`` row inside the look-back (cutoff included).

    On one timeline a request stands twice: at its own time, behind the sends of that time, to see the last send before
    it, and at its cutoff, ahead of them, to see the first send after it. One row per slot carries the last send
    forward and the first one backward, so neither a busy type nor a busy day ends up in one group; slots themselves
    grow with the span of time only. Both directions run in their own order, as running aggregates.
    """
    by = by or []
    width = window_seconds * 1_000_000
    none, size = F.lit(None).cast("long"), SLOT_SECONDS * 1_000_000
    event = lambda t, side, sent, at_: F.struct(t.alias("_t"), F.lit(side).alias("_side"), sent.alias("_sent"), at_.alias("_at"))
    us, asked = F.unix_micros("sent_at"), F.unix_micros(at)
    facts = ledger.where(F.col("outcome") == "sent").select(*by, F.array(event(us, 1, us, none)).alias("e"))
    asks = requests.select(*by, F.array(event(asked, 2, none, asked), event(asked - width, 0, none, asked)).alias("e"))
    # keys in a struct, so that null keys meet each other and one partitioning serves window and join
    key = F.struct(*by) if by else F.struct(F.lit(0))
    line = facts.unionByName(asks).select(key.alias("_b"), F.explode("e").alias("e")).select("_b", "e.*")
    line = line.withColumn("_k", F.struct("_b", F.floor(F.col("_t") / size).cast("long").alias("_slot")))
    slots, before = Window.partitionBy(F.col("_k._b")), (Window.unboundedPreceding, -1)
    opening = line.groupBy("_k").agg(F.max("_sent").alias("_l"), F.min("_sent").alias("_f")).select(
        "_k", F.max("_l").over(slots.orderBy("_k._slot").rowsBetween(*before)).alias("_cl"), F.min("_f").over(slots.orderBy(F.desc("_k._slot")).rowsBetween(*before)).alias("_cf")
    )
    inside, until = Window.partitionBy("_k"), (Window.unboundedPreceding, 0)
    local = line.select(
        "*", F.max("_sent").over(inside.orderBy("_t", "_side").rowsBetween(*until)).alias("_il"), F.min("_sent").over(inside.orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(*until)).alias("_if")
    ).where("_side <> 1")
    seen = local.join(opening, "_k").select(
        "_b", "_at", F.when(F.col("_side") == 2, F.coalesce("_il", "_cl")).alias("_last"), F.when(F.col("_side") == 0, F.coalesce("_if", "_cf")).alias("_first")
    )
    both = seen.groupBy("_b", "_at").agg(F.max("_last").alias("_last"), F.min("_first").alias("_first")).select(*[F.col(f"_b.{n}").alias(n) for n in by], "_at", "_last", "_first")
    last = F.when(F.col("_last") >= F.col("_at") - width, F.col("_last"))
    first = F.when(F.col("_first") <= F.col("_at"), F.col("_first"))
    return both.select(
        *by, F.timestamp_micros("_at").alias(at), F.timestamp_micros(first).alias("first_sent"), F.timestamp_micros(last).alias("latest_sent"),
        last.isNotNull().alias("recent"),
    )


def cool_off_until(requests: DataFrame, ledger: DataFrame, at: str = "at", seconds: int = COOL_OFF_SECONDS) -> DataFrame:
    """End of the global cool-off at each request time; NULL when none is running."""
    return recent_sends(requests, ledger, at, None, seconds).select(
        at, "latest_sent", (F.col("latest_sent") + F.make_dt_interval(secs=F.lit(seconds))).alias("cool_off_until")
    )


def keep_last(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Newest ``n`` rows per source, newest first."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key under an explicit order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def health_transitions(samples: DataFrame, keys: list[str], ts: str, tie: str, code: str, running: str) -> DataFrame:
    """One row per change between healthy and not: alert once, recover once.

    ``code`` is the health response (200 healthy, 503 stale); ``running`` tells whether the
    container is seen at all. A source is taken as healthy before its first sample.
    """
    healthy = F.col(code) == 200
    kind = (
        F.when(healthy, "RECOVERED").when(F.col(code) == 503, "STALE").when(~F.col(running), "DOWN").otherwise("ERROR")
    )
    marked = along_time(samples.withColumn("_ok", healthy), keys, ts, tie, previous={"_before": F.col("_ok")})
    changed = F.col("_ok") != F.coalesce("_before", F.lit(True))
    return marked.where(changed).withColumn("notice", kind).drop("_ok", "_before")


def carried_score(scores: DataFrame, ts: str = "score_ts", tie: str = "score_id") -> DataFrame:
    """Last known score at each cycle; a cycle without one is stale, or uninitialized before the first."""
    marked = along_time(scores, [], ts, tie, lasts={"last_score": F.col("score")})
    state = F.when(F.col("score").isNotNull(), F.col("status")).when(F.col("last_score").isNotNull(), "stale").otherwise("uninitialized")
    return marked.withColumn("cycle_status", state)


def capture_cadence(captures: DataFrame, keys: list[str], ts: str, tie: str, interval: int = CAPTURE_INTERVAL_SECONDS) -> DataFrame:
    """Gap to the previous capture of the source and whether it overran the interval."""
    marked = along_time(captures, keys, ts, tie, previous={"_before": F.col(ts)})
    gap = (F.unix_micros(ts) - F.unix_micros("_before")) / F.lit(1e6)
    return marked.withColumn("gap_seconds", gap).withColumn("overrun", F.coalesce(gap > interval, F.lit(False))).drop("_before")


def capture_totals(captures: DataFrame, keys: list[str], ts: str, tie: str, ok: str, file: str) -> DataFrame:
    """Running capture and error totals with the last captured file and time."""
    good = F.col(ok)
    return along_time(
        captures, keys, ts, tie,
        sums={"total_captured": good.cast("long"), "total_errors": (~good).cast("long")},
        lasts={"last_file": F.when(good, F.col(file)), "last_time": F.when(good, F.col(ts))},
    )
