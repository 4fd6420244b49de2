"""Table sinks. All commits go through Spark's output protocol, so a lost task is simply redone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustfront.constants import LEDGER_HOURS, UNITS, VALUE_RANGE
from gustfront.operators.timeline import global_rank
from gustfront.session import dealt
from gustfront.sinks.log import TransactionLog


MARKER = "_SUCCESS"


def committed_folders(spark: SparkSession, path: str, name: str) -> list[str]:
    """Folders ``name=...`` below ``path`` whose commit marker exists, in order of name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(conf)
    if not files.exists(root):
        return []
    found = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith(f"{name}=")]
    return sorted(p.toString() for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, MARKER)))


def read_events(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of all committed runs of ``append_events``; a run that broke off is not there at all."""
    return TransactionLog(spark, path).read()


def append_events(rows: DataFrame, path: str, key: str = "event_id", partition: str | None = None) -> list[str]:
    """Append the rows of events that have none yet, all or nothing, also beside other writers.

    An event whose run broke off has no row for readers, so the next run takes it up again. Returns the runs that were opened.
    """
    return TransactionLog(rows.sparkSession, path).append_new(rows, key, partition)


def _starts(column: pa.Array) -> np.ndarray:
    """Whether each entry differs from the one before; NULL is a value of its own."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[True], codes[1:] != codes[:-1]])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per scan of cells (scan, line, value) that come in raster order."""
    held: list[pa.RecordBatch] = []  # the scan that is still open, in as many pieces as batches brought it

    def cut(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        scans, lines, values = (pa.concat_arrays([p.column(n) for p in pieces]) for n in range(3))
        first = _starts(scans)
        line_at = np.flatnonzero(first | _starts(lines))
        scan_at = np.flatnonzero(first)
        rows = pa.ListArray.from_arrays(pa.array(np.append(line_at, len(values)), pa.int32()), values)
        data = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(line_at, scan_at), len(line_at)), pa.int32()), rows)
        return pa.RecordBatch.from_arrays([scans.take(pa.array(scan_at)), data], names=["scan_id", "data"])

    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(np.flatnonzero(_starts(batch.column(0)))[-1])
        same = not held or not _starts(pa.concat_arrays([p.column(0).slice(0, 1) for p in (held[-1], batch)]))[1]
        if last or not same:
            yield cut([*held, batch.slice(0, last)] if last else held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield cut(held)


def grid_documents(cells: DataFrame, radar_type: str, sample_rate: int, source: str | Column = "frame", parts: int | None = None) -> DataFrame:
    """Grid documents from cells: one row per scan with metadata and the value matrix.

    Cells are exchanged once, by scan into ``parts`` (not at all where they already lie so), and stream through in raster
    order; Python holds the cells of one scan beside a batch, and cuts them into lines without touching single values.
    """
    keys = ["scan_id", "row_no"]
    kind = dict(cells.dtypes)
    ordered = dealt(cells.select(*keys, "col_no", "value"), "scan_id", parts).sortWithinPartitions(*keys, "col_no", "value").select(*keys, "value")
    grids = ordered.mapInArrow(_matrices, f"scan_id {kind['scan_id']}, data array<array<{kind['value']}>>")
    width, height = F.size(F.get("data", F.lit(0))), F.size("data")
    meta = grid_metadata(radar_type, sample_rate, width * sample_rate, height * sample_rate, F.lit(source) if isinstance(source, str) else source)
    return grids.select("scan_id", F.lit(radar_type).alias("radar_type"), meta.alias("metadata"), "data")


def grid_metadata(radar_type: str, sample_rate: int, width: Column, height: Column, source: Column) -> Column:
    """Metadata of a grid in ``data``, from the size of the picture that it was sampled from."""
    low, high = VALUE_RANGE[radar_type]
    size = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    return F.struct(
        F.lit(radar_type).alias("radar_type"), size(width, height).alias("original_dimensions"), size(F.size(F.get("data", F.lit(0))), F.size("data")).alias("sampled_dimensions"),
        F.lit(sample_rate).alias("sample_rate"), F.lit(UNITS[radar_type]).alias("units"), F.struct(F.lit(low).alias("min"), F.lit(high).alias("max")).alias("value_range"),
        source.alias("source_file"),
    )


def write_grids(grids: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Grids by radar type, as Parquet or compact JSON lines."""
    grids.write.mode(mode).partitionBy("radar_type").format(fmt).save(path)


def write_tensors(tensors: DataFrame, path: str) -> None:
    """Tensors and their manifest columns in one table, so neither can exist without the other."""
    append_events(tensors, path, key="tensor_name")


def write_snapshot(df: DataFrame, path: str, version: int) -> None:
    """A new complete version beside the old ones; readers pick the newest committed version."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Newest committed version of a snapshot; one still being written, or broken off, is not seen."""
    versions = committed_folders(spark, path, "version")
    if not versions:
        raise FileNotFoundError(f"no committed version below {path}")
    return spark.read.parquet(max(versions, key=lambda p: int(p.rsplit("=", 1)[1])))


def snapshot_before(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    """Newest committed version below ``version``, from which a batch of that number carries on."""
    earlier = [p for p in committed_folders(spark, path, "version") if int(p.rsplit("=", 1)[1]) < version]
    return spark.read.parquet(max(earlier, key=lambda p: int(p.rsplit("=", 1)[1]))) if earlier else None


def drop_versions(spark: SparkSession, path: str, version: int) -> None:
    """Remove the committed versions below ``version``."""
    _delete(spark, [p for p in committed_folders(spark, path, "version") if int(p.rsplit("=", 1)[1]) < version])


def save_ledger(rows: DataFrame, path: str, now: Column, hours: int = LEDGER_HOURS) -> None:
    """Replace the stored ledger by the rows of the last 48 hours, in one commit; readers see the old or the new one."""
    TransactionLog(rows.sparkSession, path).replace(rows.where(F.col("sent_at") >= now - F.make_dt_interval(hours=F.lit(hours))))


def load_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    return TransactionLog(spark, path).read()


def _delete(spark: SparkSession, paths) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        count += int(target.getFileSystem(conf).delete(target, True))
    return count


def training_samples(grids: DataFrame, order: list[str], key: str | None = None) -> DataFrame:
    """Grids numbered from 0 in input order.

    With a unique ``key`` only it and the ordering columns are ranked and joined back; without one whole rows
    are, so ties and repeated rows keep one number each.
    """
    if key is None:
        return global_rank(grids, order, "id")
    ids = global_rank(grids.select(*dict.fromkeys([*order, key])), [*order, key], "id")
    return grids.join(ids.select(key, "id"), key)


def write_training_set(grids: DataFrame, path: str, order: list[str], key: str | None = None) -> None:
    training_samples(grids, order, key).write.mode("overwrite").parquet(path)


def write_reports(reports: DataFrame, path: str, region: str, cycle: str) -> None:
    """One text file per region and cycle."""
    reports.select(region, cycle, F.col("report").alias("value")).repartition(region, cycle).write.mode("append").partitionBy(region, cycle).text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def deletable_sources(frames: DataFrame, grids: DataFrame, key: str = "stem") -> DataFrame:
    """Source frames whose grid was verified as valid: the only ones that may be removed."""
    return frames.join(grids.where("problem = 'valid'").select(key), key, "left_semi")


def drop_old_dates(spark: SparkSession, path: str, date_column: str, as_of: str, days: int) -> None:
    """Rewrite retention: remove date partitions older than ``days`` before ``as_of`` (ISO date)."""
    table = spark.read.parquet(path)
    old = table.where(F.col(date_column) < F.date_sub(F.lit(as_of).cast("date"), days)).select(date_column).distinct()
    _delete(spark, (f"{path}/{date_column}={row[0]}" for row in old.toLocalIterator()))
