"""Raster frames, georeferences, grids and tensors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustfront.constants import MIN_FRAME_AGE_SECONDS, MIN_GRID_BYTES, MIN_PNG_BYTES
from gustfront.functions.radar import is_png, radar_type
from gustfront.schemas import GRID

FRAME_PATTERNS = {"reflectivity": "radar_base_reflectivity_*.png", "velocity": "radar_base_velocity_*.png"}
ROWS_PER_BATCH = 16_384


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def read_frame_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """PNG files with path, modificationTime, length and content (read only when asked for)."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.png")
    return (reader.option("recursiveFileLookup", True) if recursive else reader).load(folder)


def valid_frames(files: DataFrame, min_bytes: int = MIN_PNG_BYTES) -> DataFrame:
    """Frames with a PNG signature and more than a stub of content."""
    return files.where(is_png(F.col("content"), F.col("length"), min_bytes))


def settled_frames(files: DataFrame, as_of: Column, min_age: int = MIN_FRAME_AGE_SECONDS, name: str = "path", modified: str = "modificationTime") -> DataFrame:
    """Frames of the two known name patterns that are older than the settle age, oldest first."""
    base = file_name(F.col(name))
    known = base.rlike(r"^radar_base_(reflectivity|velocity)_.*\.png$")
    old = F.col(modified) < as_of - F.make_dt_interval(secs=F.lit(min_age))
    return files.where(known & old).orderBy(modified, name)


def without_scales(files: DataFrame, name: str = "path") -> DataFrame:
    """Every frame except colour-scale pictures."""
    return files.where(~file_name(F.col(name)).contains("intensity_scale"))


def parse_world(files: DataFrame, text: str = "value") -> DataFrame:
    """Affine terms from world-file text: six numbers, of which A, E, C and F are used."""
    parts = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    number = lambda n: F.get(parts, F.lit(n)).try_cast("double")
    out = files.where(F.size(parts) == 6).select("*", number(0).alias("a"), number(3).alias("e"), number(4).alias("c"), number(5).alias("f"))
    return out.dropna(subset=["a", "e", "c", "f"])


def read_georefs(spark: SparkSession, folder: str) -> DataFrame:
    """Georeference per station from ``{station}.wld`` files."""
    text = spark.read.text(folder, wholetext=True, pathGlobFilter="*.wld")
    named = text.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.wld$", "").alias("station"), "value")
    return parse_world(named).drop("value")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded pictures (origin, height, width, nChannels, data); palettes arrive expanded to BGR."""
    return spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")


def image_pixels(images: DataFrame, key: str = "origin") -> DataFrame:
    """Pixel rows of decoded pictures: (key, row_no, col_no, r, g, b).

    Rows are cut from the byte buffer in bounded blocks, so one large picture never fills a batch.
    """
    kind = dict(images.dtypes)[key]
    schema = f"{key} {kind}, row_no int, col_no int, r int, g int, b int"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, height, width, channels, data in zip(batch[key], batch["height"], batch["width"], batch["nChannels"], batch["data"]):
                raster = np.frombuffer(data, dtype=np.uint8).reshape(int(height), int(width), int(channels))
                bgr = raster[:, :, [0, 0, 0]] if channels == 1 else raster[:, :, :3]
                step = max(1, ROWS_PER_BATCH // max(1, int(width)))
                for top in range(0, int(height), step):
                    block = bgr[top : top + step]
                    rows, cols = np.indices(block.shape[:2])
                    flat = block.reshape(-1, 3).astype(np.int32)
                    yield pd.DataFrame(
                        {key: name, "row_no": (rows.ravel() + top).astype(np.int32), "col_no": cols.ravel().astype(np.int32), "r": flat[:, 2], "g": flat[:, 1], "b": flat[:, 0]}
                    )

    return images.select(key, "height", "width", "nChannels", "data").mapInPandas(cut, schema)


def index_pixels(pixels: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Recover palette indices by joining colours to ``dictionary(idx, r, g, b)``; the lowest index wins."""
    first = dictionary.groupBy("r", "g", "b").agg(F.min("idx").alias("idx"))
    return pixels.join(first, ["r", "g", "b"])


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """Value-grid documents, with the document size for validation."""
    text = spark.read.text(path, wholetext=True)
    return parse_grids(text.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("body")))


def parse_grids(documents: DataFrame, text: str = "body") -> DataFrame:
    """Typed grid, size in bytes and the set of top-level and metadata keys of each document."""
    return documents.select(
        "*", F.from_json(text, GRID).alias("grid"), F.octet_length(text).alias("bytes"), F.json_object_keys(text).alias("keys"),
        F.json_object_keys(F.get_json_object(text, "$.metadata")).alias("meta_keys"),
    )


def grid_problem(min_bytes: int = MIN_GRID_BYTES) -> Column:
    """First failed check of a parsed grid, or 'valid'."""
    out = F.when(F.col("bytes") < min_bytes, "output too small").when(F.col("keys").isNull(), "invalid json")
    for name in ("metadata", "data"):
        out = out.when(~F.array_contains("keys", name), f"missing required field: {name}")
    for name in ("radar_type", "units", "value_range"):
        out = out.when(~F.coalesce(F.array_contains("meta_keys", name), F.lit(False)), f"missing required metadata field: {name}")
    return (
        out.when(F.col("grid.data").isNull(), "data must be a list of lists")
        .when(F.size("grid.data") == 0, "data is empty")
        .when(~F.col("grid.metadata.radar_type").isin("reflectivity", "velocity"), "invalid radar_type")
        .otherwise("valid")
    )


def grid_cells(grids: DataFrame, key: str) -> DataFrame:
    """Long-form cells of typed grids."""
    rows = grids.select(F.col(key).alias("scan_id"), F.posexplode("grid.data").alias("row_no", "line"))
    return rows.select("scan_id", "row_no", F.posexplode("line").alias("col_no", "value"))


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """Tensor table: manifest columns beside ``tensor ARRAY<FLOAT>``; an absent table has no rows."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], "event_id string, label int, tensor_name string, tensor array<float>")


def type_of_frames(files: DataFrame, name: str = "path") -> DataFrame:
    """Frames with their radar type; unknown ones are rejected."""
    return files.withColumn("radar_type", radar_type(file_name(F.col(name)))).where("radar_type <> 'unknown'")
