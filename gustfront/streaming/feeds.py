"""File-source streams, deduplication, pairing and score annotation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from gustfront.constants import LEDGER_HOURS, RISK_THRESHOLD, VELOCITY_TOLERANCE_MIN
from gustfront.operators.suppression import annotate_with_score
from gustfront.sinks.tables import drop_versions, read_snapshot, snapshot_before, write_snapshot

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession, state_partitions: int | None = None) -> None:
    """State in RocksDB (spills to disk, survives executors through the checkpoint).

    The number of state partitions is fixed at a query's first start; pass one sized to the cluster.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if state_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))


#: Files of one trigger unless the caller says otherwise: it bounds what a stateful task holds of one key.
FILES_PER_TRIGGER = 1000


def stream_files(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", files_per_trigger: int = FILES_PER_TRIGGER, **options: str) -> DataFrame:
    """New files of a landing folder, oldest first, a bounded number per trigger; each poll of a feed is one file."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


def start(df: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None] | None = None, path: str | None = None, every: str | None = None) -> StreamingQuery:
    """Start a query into a Parquet table or a batch function, on an interval or once over what is there."""
    writer = df.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", path)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def drain(df: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], every: str = "100 milliseconds") -> None:
    """Run a query, batch after bounded batch, until its source has no more, then stop it."""
    query = start(df, checkpoint, batch, every=every)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
        query.awaitTermination()


def dedupe_alerts(alerts: DataFrame, ts: str = "cycle_ts", key: str = "alert_id", hours: int = LEDGER_HOURS) -> DataFrame:
    """First sight of each alert id across polls, remembered for the watermark's span."""
    return alerts.withWatermark(ts, f"{hours} hours").dropDuplicatesWithinWatermark([key])


def with_lookback(scans: DataFrame, ts: str = "scan_ts", late: str = "1 day") -> DataFrame:
    """Accept late files for a day, the span of looking at yesterday as well as today."""
    return scans.withWatermark(ts, late)


def pair_streams(reflectivity: DataFrame, velocity: DataFrame, tolerance_min: int = VELOCITY_TOLERANCE_MIN, late: str = "10 minutes") -> DataFrame:
    """Nearest velocity scan per reflectivity scan over two streams; unmatched scans come out once it is too late for a match."""
    r = reflectivity.select("station", "scan_id", "scan_ts").withWatermark("scan_ts", late).alias("r")
    v = velocity.select(F.col("station").alias("v_station"), F.col("scan_id").alias("v_id"), F.col("scan_ts").alias("v_ts")).withWatermark("v_ts", late).alias("v")
    reach, span = f"interval {tolerance_min} minutes", 2 * tolerance_min * 60
    # a velocity scan stands in the one or two slots that its reach touches, so a busy site is spread over time
    slot = lambda ts, shift: F.floor((F.unix_micros(ts) / 1_000_000 + shift) / span).cast("long")
    r = r.withColumn("slot", slot(F.col("scan_ts"), 0))
    v = v.withColumn("v_slot", F.explode(F.array_distinct(F.array(slot(F.col("v_ts"), -span // 2), slot(F.col("v_ts"), span // 2)))))
    near = F.expr(f"station = v_station and slot = v_slot and v_ts >= scan_ts - {reach} and v_ts <= scan_ts + {reach}")
    joined = r.join(v, near, "leftOuter")
    diff = F.unix_micros("v_ts") - F.unix_micros("scan_ts")
    code = F.abs(diff) * 2 + F.when(diff > 0, 1).otherwise(0)
    return joined.groupBy("station", "scan_id", "scan_ts").agg(F.min_by("v_id", code).alias("pair_id"), F.min_by("v_ts", code).alias("pair_ts"))


def annotate_batch(score_snapshot: str, handle: Callable[[DataFrame, int], None], threshold: float = RISK_THRESHOLD) -> Callable[[DataFrame, int], None]:
    """Batch function: join a micro-batch of alerts with the newest score snapshot, then hand it on.

    Of the score history only the last score before the batch and those inside its span are read.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        scores = read_snapshot(batch.sparkSession, score_snapshot)
        span = batch.agg(F.min("cycle_ts").alias("first"), F.max("cycle_ts").alias("last")).first()
        if span["first"] is not None:
            before = scores.where(F.col("score_ts") <= F.lit(span["first"])).agg(F.max("score_ts")).first()[0]
            scores = scores.where(F.col("score_ts") <= F.lit(span["last"]))
            scores = scores if before is None else scores.where(F.col("score_ts") >= F.lit(before))
        handle(annotate_with_score(batch, scores, threshold), batch_id)

    return run


def as_of_rows(alerts: DataFrame, scores: DataFrame) -> DataFrame:
    """Two feeds as the one stream that ``as_of_batch`` reads: a row holds an ``alert`` or a ``fact``."""
    facts = scores.select("score_id", "score_ts", "score", "status")
    asked = alerts.select(F.struct(*alerts.columns).alias("alert"), F.lit(None).cast(facts.schema).alias("fact"))
    return asked.union(facts.select(F.lit(None).cast(alerts.schema).alias("alert"), F.struct(*facts.columns).alias("fact")))


def as_of_batch(state: str, handle: Callable[[DataFrame, int], None], threshold: float = RISK_THRESHOLD, late: str = "10 minutes") -> Callable[[DataFrame, int], None]:
    """Batch function over ``as_of_rows``: alerts (cycle_ts, ...) with the last score at or before their cycle, once no earlier score can come any more.

    An alert is handed on when both feeds have passed its time by ``late``, which is also how late a row of either may be; later ones are dropped.
    What waits, the last score before that mark and the scores from it on are a snapshot below ``state``, numbered by batch. A replayed batch starts from
    the snapshot before it and writes its own again, so nothing is answered twice. Rows meet by slots of time, so no task holds all scores.
    """

    def passed_by(marks: DataFrame) -> int | None:
        """The time (microseconds) that both feeds have passed by ``late``."""
        return marks.select(F.unix_micros(F.when(F.col("asked").isNotNull() & F.col("told").isNotNull(), F.least("asked", "told") - F.expr(f"interval {late}")))).first()[0]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks_at, waiting_at, scores_at = (f"{state}/{name}" for name in ("marks", "waiting", "scores"))
        earlier = snapshot_before(spark, marks_at, batch_id)
        highest = lambda df, asked, told: df.agg(F.max(asked).alias("asked"), F.max(told).alias("told"))
        marks = highest(batch, "alert.cycle_ts", "fact.score_ts")
        write_snapshot(marks if earlier is None else highest(marks.union(earlier), "asked", "told"), marks_at, batch_id)
        old, passed = (None if m is None else passed_by(m) for m in (earlier, snapshot_before(spark, marks_at, batch_id + 1)))

        def held(kind: str, ts: str, path: str) -> DataFrame:
            """Rows of a feed that are not late, and those kept from earlier batches."""
            fresh = batch.where(F.col(kind).isNotNull()).select(f"{kind}.*").where(F.col(ts).isNotNull() if old is None else F.unix_micros(ts) >= old)
            kept = snapshot_before(spark, path, batch_id)
            return fresh if kept is None else fresh.unionByName(kept)

        asked, told = held("alert", "cycle_ts", waiting_at), held("fact", "score_ts", scores_at)
        is_past = lambda ts: F.lit(False) if passed is None else F.unix_micros(ts) < passed
        handle(annotate_with_score(asked.where(is_past("cycle_ts")), told.where(is_past("score_ts")), threshold), batch_id)
        write_snapshot(asked.where(~is_past("cycle_ts")), waiting_at, batch_id)
        last = told.where(is_past("score_ts")).orderBy(F.desc("score_ts"), F.desc("score_id")).limit(1)
        write_snapshot(last.union(told.where(~is_past("score_ts"))), scores_at, batch_id)
        for path in (marks_at, waiting_at, scores_at):
            drop_versions(spark, path, batch_id - 1)  # a replay of this batch needs the one before it

    return run
