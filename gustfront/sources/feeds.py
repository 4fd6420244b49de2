"""Alert feeds, observations, forecasts, status documents and ledgers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustfront.functions.text import parse_iso
from gustfront.schemas import ALERT_COLLECTION, FORECAST, LEDGER_ROW, OBSERVATION, SCORE_STATUS


def from_text(documents: DataFrame, schema: T.StructType, text: str = "body", into: str = "doc") -> DataFrame:
    """Parse JSON text; broken documents give NULL fields instead of failing."""
    return documents.withColumn(into, F.from_json(text, schema, {"mode": "PERMISSIVE"}))


def explode_alerts(collections: DataFrame, features: str = "features", keep: list[str] | None = None) -> DataFrame:
    """One row per alert of a feature collection; ``feed_pos`` is its place in the feed.

    ``expires`` is typed; the text as sent stays in ``expires_text`` for messages.
    """
    rows = collections.select(*(keep or []), F.posexplode(features).alias("feed_pos", "f"))
    p = lambda n: F.col(f"f.properties.{n}")
    return rows.select(
        *(keep or []), "feed_pos", p("id").alias("alert_id"), p("event").alias("event"), parse_iso(p("expires")).alias("expires"),
        p("expires").alias("expires_text"), p("effective").alias("effective"), p("areaDesc").alias("area"), p("headline").alias("headline"),
        p("description").alias("description"), p("instruction").alias("instruction"), p("severity").alias("severity"),
    )


def read_alert_feed(spark: SparkSession, path: str) -> DataFrame:
    """Landed polls, one feature collection per file; the poll time is the file's modification time."""
    polls = spark.read.schema(ALERT_COLLECTION).option("multiLine", True).json(path)
    return explode_alerts(polls.withColumn("cycle_ts", F.col("_metadata.file_modification_time")), keep=["cycle_ts"])


def observation_columns(doc: str = "doc") -> list[Column]:
    p = lambda n: F.col(f"{doc}.properties.{n}")
    return [
        parse_iso(p("timestamp")).alias("obs_ts"), F.substring_index(p("station"), "/", -1).alias("station"), p("temperature.value").alias("temp_c"),
        p("dewpoint.value").alias("dew_c"), p("relativeHumidity.value").alias("humidity"), p("windSpeed.value").alias("wind_kmh"),
        p("windDirection.value").alias("wind_deg"), p("textDescription").alias("conditions"), p("barometricPressure.value").alias("pressure_pa"),
        p("visibility.value").alias("visibility_m"),
    ]


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(OBSERVATION).option("multiLine", True).json(path)
    return docs.select(F.struct("properties").alias("doc")).select(*observation_columns())


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(FORECAST).option("multiLine", True).json(path)
    return docs.select(F.col("_metadata.file_name").alias("file"), F.col("properties.periods").alias("periods"))


def first_station(collections: DataFrame) -> DataFrame:
    """Identifier of the first station of a station collection; empty collections give no row."""
    return collections.select(F.get("features", F.lit(0)).alias("f")).where("f is not null").select(F.col("f.properties.stationIdentifier").alias("station"))


def readable(documents: DataFrame, schema: T.StructType, text: str = "body") -> DataFrame:
    """Status documents that parse; unreadable ones are dropped."""
    parsed = from_text(documents, schema, text)
    return parsed.where(F.col("doc").isNotNull() & F.col("doc._corrupt_record").isNull())


def read_status(spark: SparkSession, path: str, schema: T.StructType = SCORE_STATUS) -> DataFrame:
    """Status files, one JSON document each; a missing or broken file has no row."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], schema).drop("_corrupt_record")
    return readable(text.withColumnRenamed("value", "body"), schema).select("doc.*").drop("_corrupt_record")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Suppression ledger: a JSON array per file; rows without a send time are dropped."""
    try:
        rows = spark.read.schema(LEDGER_ROW).option("multiLine", True).json(path)
    except AnalysisException:
        rows = spark.createDataFrame([], LEDGER_ROW)
    return rows.withColumn("sent_at", parse_iso(F.col("sent_at"))).where("sent_at is not null")
