"""Storm reports, station lists, warning polygons, scan listings and manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustfront.constants import FALLBACK_STATIONS
from gustfront.functions.numbers import truncated_magnitude
from gustfront.functions.radar import in_bbox, off_null_island, strong_enough
from gustfront.schemas import MANIFEST_TEXT, STATION_COLLECTION, STORM_REPORT, TENSOR_MANIFEST_TEXT
from gustfront.operators.timeline import first_per_key
from gustfront.session import deal_out


def read_report_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Report CSV as text columns, matched by header name; an empty field is '', an absent column NULL.

    ``file_year`` is the four-digit year at the start of the file name, if any.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(paths)
    given = [F.coalesce(F.col(n), F.lit("")).alias(n) if n in raw.columns else F.lit(None).cast("string").alias(n) for n in STORM_REPORT.fieldNames()]
    year = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4})_[^/]*\.csv", 1).try_cast("int")
    return raw.select(*given, year.alias("file_year"))


def parse_reports(raw: DataFrame, years: list[int] | Column, label: str, subtype: str | Column, min_ef: int = 0, source_tz: str = "UTC") -> DataFrame:
    """Typed events from report text; a row that fails any cast is skipped.

    Report times carry no zone; they are taken as ``source_tz`` and stored as instants.
    """
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    year = F.trim("yr").try_cast("int")
    wanted = year.isin(*years) if isinstance(years, (list, tuple)) else year == years
    local = F.try_to_timestamp(F.concat_ws(" ", text("date"), F.coalesce("time", F.lit("00:00:00"))), F.lit("yyyy-MM-dd HH:mm:ss"))
    typed = deal_out(raw.where(wanted)).select(
        *[c for c in raw.columns if c not in (*STORM_REPORT.fieldNames(), "subtype")],
        F.to_utc_timestamp(local, source_tz).alias("event_ts"),
        F.coalesce("slat", F.lit("0")).try_cast("double").alias("lat"), F.coalesce("slon", F.lit("0")).try_cast("double").alias("lon"),
        truncated_magnitude(F.col("mag")).alias("mag"), F.upper(F.trim(text("st"))).alias("st"), F.lit(label).alias("label"),
        (F.lit(subtype) if isinstance(subtype, str) else subtype).alias("subtype"),
    )
    whole = typed.dropna(subset=["event_ts", "lat", "lon", "mag"])
    return whole.where(strong_enough(F.col("label"), F.col("mag"), min_ef) & off_null_island(F.col("lat"), F.col("lon")))


def read_tornadoes(spark: SparkSession, path: str, years: list[int], min_ef: int = 1) -> DataFrame:
    return parse_reports(read_report_text(spark, path), years, "tornado", "tornado", min_ef)


def read_yearly_reports(spark: SparkSession, folder: str, kind: str, years: list[int]) -> DataFrame:
    """All ``{year}_{kind}.csv`` files of a folder in one scan; absent years are skipped.

    Each file contributes the rows of its own year only.
    """
    pattern = f"{folder}/{{{','.join(str(y) for y in years)}}}_{kind}.csv"
    try:
        raw = read_report_text(spark, pattern)
    except AnalysisException:
        raw = spark.createDataFrame([], STORM_REPORT).withColumn("file_year", F.lit(None).cast("int"))
    return parse_reports(raw, F.col("file_year"), "no_tornado", kind)


def fallback_stations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FALLBACK_STATIONS, "station string, lat double, lon double")


def parse_stations(collections: DataFrame) -> DataFrame:
    """Sites of GeoJSON feature collections inside the bounding box; the fallback list when none is."""
    feature = collections.select(F.explode("features").alias("f"))
    at = lambda n: F.get(F.col("f.geometry.coordinates"), F.lit(n))
    sites = feature.select(F.concat(F.lit("K"), F.col("f.id")).alias("station"), at(1).alias("lat"), at(0).alias("lon"))
    inside = sites.where(in_bbox(F.col("lat"), F.col("lon")))
    spare = fallback_stations(collections.sparkSession).where(~inside.exists())
    return inside.unionByName(spare)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station file; an unreadable one gives the fallback list."""
    try:
        collections = spark.read.schema(STATION_COLLECTION).option("multiLine", True).json(path)
    except AnalysisException:
        return fallback_stations(spark)
    return parse_stations(collections)


def warning_events(vertices: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Tornado-warning polygons from vertex rows: first record per (wfo, etn), centre as vertex mean.

    The first record is chosen before its issue time is checked, so a bad first record hides later ones.
    """
    wanted = vertices.where("phenom = 'TO' and sig = 'W' and gtype = 'P'")
    records = wanted.groupBy("wfo", "etn", "record_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.max("issued").alias("issued"))
    first = first_per_key(records, ["wfo", "etn"], ["record_id"])
    issued = F.try_to_timestamp(F.when(F.length("issued") == 12, F.col("issued")), F.lit("yyyyMMddHHmm"))
    out = first.select(
        "record_id", "etn", issued.alias("event_ts"), "lat", "lon", F.lit(-1).alias("mag"), F.col("wfo").alias("st"),
        F.lit("no_tornado").alias("label"), F.lit("warning_no_torn").alias("subtype"),
    ).where("event_ts is not null and lat is not null")
    return out.where(F.year("event_ts").isin(*years)) if years else out


def parse_listings(pages: DataFrame) -> DataFrame:
    """Scan files named in directory-listing pages ``(site, product, html)``.

    Names with impossible times are skipped; repeats of a time collapse. Site, product and time make
    up the file name, so whole rows are deduplicated.
    """
    names = F.regexp_extract_all("html", F.lit(r"([A-Za-z0-9]+_[A-Z0-9]{3}_\d{12})\.png"), F.lit(1))
    found = deal_out(pages).select("site", "product", F.explode(names).alias("name"))
    mine = found.where(F.substring_index("name", "_", 2) == F.concat_ws("_", "site", "product"))
    ts = F.try_to_timestamp(F.substring_index("name", "_", -1), F.lit("yyyyMMddHHmm"))
    return mine.select(
        F.concat(F.lit("K"), F.col("site")).alias("station"), "product", ts.alias("scan_ts"), F.concat("name", F.lit(".png")).alias("file")
    ).where("scan_ts is not null").distinct()


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Saved listing pages below ``.../{site}/{product}/``, one page per file."""
    pages = spark.read.text(path, wholetext=True)
    part = lambda n: F.element_at(F.split(F.col("_metadata.file_path"), "/"), n)
    return parse_listings(pages.select(part(-3).alias("site"), part(-2).alias("product"), F.col("value").alias("html")))


def committed_ids(lines: DataFrame, key: str = "event_id", schema=MANIFEST_TEXT) -> DataFrame:
    """Distinct non-empty keys of manifest lines; a cut-off last line still counts by its key."""
    parsed = lines.select(F.from_csv("line", ", ".join(f"{name} string" for name in schema.fieldNames()), {"mode": "PERMISSIVE"}).alias("m"))
    return parsed.select(F.col(f"m.{key}").alias(key)).where(F.coalesce(key, F.lit("")) != "").distinct()


def read_manifest(spark: SparkSession, path: str, schema=MANIFEST_TEXT) -> DataFrame:
    """Manifest CSV as text columns, tolerant of a cut-off last row; an absent file has no rows."""
    key = "tensor" if schema is TENSOR_MANIFEST_TEXT else "event_id"
    try:
        rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.where(F.coalesce(key, F.lit("")) != "")
