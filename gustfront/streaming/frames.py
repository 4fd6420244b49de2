"""Frame-to-grid conversion over a stream of landed pictures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustfront.constants import MIN_FRAME_AGE_SECONDS
from gustfront.sinks.tables import grid_metadata, write_grids
from gustfront.sources.frames import file_name, grid_problem, parse_grids, settled_frames, type_of_frames, valid_frames

IMAGE = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def stream_frames(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Landed frames as a stream of decoded pictures."""
    return spark.readStream.format("image").schema(IMAGE).option("pathGlobFilter", "radar_base_*.png").option("maxFilesPerTrigger", files_per_trigger).load(folder).select("image.*")


def ready_frames(files: DataFrame, as_of, min_age: int = MIN_FRAME_AGE_SECONDS) -> DataFrame:
    """Valid, settled frames of a known type: what a conversion cycle takes up."""
    return type_of_frames(settled_frames(valid_frames(files), as_of, min_age))


def nearest_values(colours: np.ndarray, palette: np.ndarray, values: np.ndarray, block: int = 4096) -> np.ndarray:
    """Value of the nearest palette colour (the first of equals) for packed distinct colours, a block at a time."""
    rgb = np.stack([colours >> 16, (colours >> 8) & 255, colours & 255], axis=1).astype(np.int64)
    out = np.empty(len(rgb))
    for start in range(0, len(rgb), block):
        gap = rgb[start : start + block, None, :] - palette[None, :, :]
        out[start : start + block] = values[(gap * gap).sum(axis=2).argmin(axis=1)]
    return out


def frame_grids(images: DataFrame, palettes: dict[str, DataFrame], sample_rate: int) -> DataFrame:
    """One row per picture: its value grid, or the reason for none.

    A picture is decoded once and looked up where it lies: its distinct colours meet the palette, which travels as flat
    arrays per type (a row object for each entry would cost Python a hundred times the picture), and no pixel is shuffled or joined. An unreadable picture, or one without a palette, fails alone.
    """
    table = None
    for kind, palette in palettes.items():
        entries = palette.agg(F.array_sort(F.collect_list(F.struct("x", "r", "g", "b", "value"))).alias("e"))
        rgb = F.flatten(F.transform("e", lambda p: F.array(p["r"], p["g"], p["b"])))
        one = entries.select(rgb.cast("array<int>").alias("rgb"), F.col("e.value").cast("array<double>").alias("scale"), F.lit(kind).alias("radar_type"))
        table = one if table is None else table.unionByName(one)
    typed = type_of_frames(images, "origin").select("origin", "radar_type", "height", "width", "nChannels", "data").join(table, "radar_type", "left")

    def grid(row, known: dict) -> tuple[list | None, str | None]:
        height, width, channels = int(row.height), int(row.width), int(row.nChannels)
        if row.data is None or height <= 0 or width <= 0 or len(row.data) != height * width * channels:
            return None, "not a readable picture"
        if row.rgb is None or not len(row.rgb):
            return None, "no palette for this type"
        if row.radar_type not in known:
            known[row.radar_type] = np.asarray(row.rgb, dtype=np.int64).reshape(-1, 3), np.asarray(row.scale, dtype=np.float64)
        raster = np.frombuffer(row.data, dtype=np.uint8).reshape(height, width, channels)[::sample_rate, ::sample_rate].astype(np.int64)
        blue, green, red = raster[:, :, [0, 0, 0] if channels == 1 else [0, 1, 2]].transpose(2, 0, 1)
        colours, place = np.unique((red << 16) | (green << 8) | blue, return_inverse=True)
        found = np.rint(nearest_values(colours, *known[row.radar_type]) * 100) / 100
        return found[place].reshape(blue.shape).tolist(), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                data, error = grid(row, known)
                yield pd.DataFrame({"scan_id": [row.origin], "radar_type": [row.radar_type], "height": [int(row.height)], "width": [int(row.width)], "data": [data], "error": [error]})

    return typed.mapInPandas(run, "scan_id string, radar_type string, height int, width int, data array<array<double>>, error string")


def convert_images(images: DataFrame, palettes: dict[str, DataFrame], sample_rate: int) -> DataFrame:
    """Grid documents of the pictures that can be read, each type through its own palette."""
    return frame_documents(frame_grids(images, palettes, sample_rate), list(palettes), sample_rate)


def frame_documents(made: DataFrame, kinds: list[str], sample_rate: int) -> DataFrame:
    """Grid documents from rows of ``frame_grids``."""
    meta = None
    for kind in kinds:
        own = F.col("radar_type") == kind
        part = grid_metadata(kind, sample_rate, F.col("width"), F.col("height"), file_name(F.col("scan_id")))
        meta = F.when(own, part) if meta is None else meta.when(own, part)
    return made.where("error is null").select("scan_id", "radar_type", meta.alias("metadata"), "data")


def conversion_log(grids: DataFrame, min_bytes: int) -> DataFrame:
    """One log row per grid: success, file and the first failed check."""
    text = grids.select("scan_id", F.to_json(F.struct("metadata", "data")).alias("body"))
    checked = parse_grids(text).select("scan_id", "bytes", grid_problem(min_bytes).alias("problem"))
    return checked.select((F.col("problem") == "valid").alias("success"), file_name(F.col("scan_id")).alias("filename"), "bytes", F.nullif("problem", F.lit("valid")).alias("error"))


def convert_batch(palettes: dict[str, DataFrame], grid_path: str, log_path: str, sample_rate: int = 4, min_bytes: int = 1000) -> Callable[[DataFrame, int], None]:
    """Batch function: convert, write and log one micro-batch; a replay overwrites the batch's own folders.

    A frame that fails is a log row with its reason and does not hold up the others.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        made = frame_grids(batch, palettes, sample_rate).persist()
        try:
            write_grids(frame_documents(made, list(palettes), sample_rate), f"{grid_path}/batch={batch_id}", mode="overwrite")
            schema = frame_documents(made, list(palettes), sample_rate).schema
            written = batch.sparkSession.read.schema(schema).parquet(f"{grid_path}/batch={batch_id}")
            failed = made.where("error is not null").select(F.lit(False).alias("success"), file_name(F.col("scan_id")).alias("filename"), F.lit(None).cast("int").alias("bytes"), "error")
            conversion_log(written, min_bytes).unionByName(failed).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
        finally:
            made.unpersist()

    return run
