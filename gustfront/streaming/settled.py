"""A streaming source of settled files, and the removal of sources whose output was verified.

The source's offset is a place in the order (modification time, path). A file is held back until it is older than the settle age,
so what is still being written is never read, and a batch takes a bounded number of files. It delivers paths, not contents:
Spark's own readers open them. Files must appear within the settle age of their modification time; what turns up later
with an older time lies before the offset and is not seen.
"""

from __future__ import annotations

import datetime
import fnmatch
import json
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from gustfront.constants import MIN_FRAME_AGE_SECONDS
from gustfront.sinks.tables import deletable_sources
from gustfront.sources.frames import file_name, valid_frames
from gustfront.streaming.frames import IMAGE, convert_batch

SCHEMA = "path string, modificationTime timestamp, length bigint"
START = {"ns": -1, "path": ""}
#: Files that one partition of a batch lists.
FILES_PER_PARTITION = 500


class Files(InputPartition):
    def __init__(self, found: list[tuple[str, int, int]]):
        super().__init__(None)
        self.found = found


class SettledReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.patterns = options["path"], options.get("pattern", "*").split(",")
        self.age, self.limit = float(options.get("minage", "0")), int(options.get("filespertrigger", "1000"))
        self.asof = options.get("asof")
        self.position = json.loads(options.get("position", json.dumps(START)))

    def initialOffset(self) -> dict:
        return dict(START)

    def latestOffset(self) -> dict:
        """The end of the next batch: at most ``filesPerTrigger`` settled files beyond the last one."""
        found = self.listed(self.position, None)[: self.limit]
        if found:
            self.position = {"ns": found[-1][1], "path": found[-1][0]}
        return dict(self.position)

    def listed(self, start: dict, end: dict | None) -> list[tuple[str, int, int]]:
        """(path, modification time, size) of the settled files after ``start``, in order."""
        files, root = pafs.FileSystem.from_uri(self.folder) if "://" in self.folder else (pafs.LocalFileSystem(), self.folder)
        scheme = self.folder.split("://")[0] + "://" if "://" in self.folder else "file://"
        settled = (float(self.asof) if self.asof else time.time()) - self.age
        low, high = (start["ns"], start["path"]), (end["ns"], end["path"]) if end else None
        out = []
        for info in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.type != pafs.FileType.File or not any(fnmatch.fnmatchcase(info.base_name, p) for p in self.patterns):
                continue
            path, at = scheme + info.path, info.mtime_ns
            if low < (at, path) and (at < settled * 1e9 if high is None else (at, path) <= high):
                out.append((path, at, info.size))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.position = max(self.position, end, key=lambda o: (o["ns"], o["path"]))
        found = self.listed(start, end)
        return [Files(found[k : k + FILES_PER_PARTITION]) for k in range(0, len(found), FILES_PER_PARTITION)]

    def read(self, partition: Files) -> Iterator[tuple]:
        utc = datetime.timezone.utc
        for path, at, size in partition.found:
            yield path, datetime.datetime.fromtimestamp(at // 1000 / 1e6, utc), size

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class SettledFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "settled_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SettledReader({k.lower(): v for k, v in self.options.items()})


def last_offset(spark: SparkSession, checkpoint: str) -> dict:
    """The end of the last batch that a query with this checkpoint planned, from which its source goes on."""
    try:
        logged = spark.read.text(f"{checkpoint}/offsets", wholetext=True).select(F.col("_metadata.file_name").cast("long").alias("batch"), "value")
    except AnalysisException:
        return dict(START)
    last = logged.where("batch is not null").orderBy(F.desc("batch")).first()
    return json.loads(last["value"].strip().splitlines()[-1]) if last else dict(START)


def stream_settled(
    spark: SparkSession, folder: str, checkpoint: str, patterns: Sequence[str] = ("*",), min_age: float = MIN_FRAME_AGE_SECONDS, files_per_trigger: int = 1000, as_of: float | None = None
) -> DataFrame:
    """Settled files of ``folder`` as a stream of (path, modificationTime, length), oldest first, at most so many a batch.

    The query must be started with the same ``checkpoint``. ``as_of`` (epoch seconds) fixes the clock for replays.
    """
    spark.dataSource.register(SettledFiles)
    reader = spark.readStream.format("settled_files").option("pattern", ",".join(patterns)).option("minAge", min_age).option("filesPerTrigger", files_per_trigger)
    if as_of is not None:
        reader = reader.option("asOf", as_of)
    return reader.option("position", json.dumps(last_offset(spark, checkpoint))).load(folder)


def remove_files(files: DataFrame, path_column: str = "path", archive: str | None = None, root: str | None = None) -> int:
    """Delete the files, or move them below ``archive`` with their path below ``root``; returns how many went.

    Every task moves its own rows; the driver sees a sum. A repeated or resumed call finds nothing left to do for a file that
    is gone. Files of one name in two folders stay apart, as the path from ``root`` (by default the whole path) is kept.
    """

    def split(path: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:") if path.startswith("file:") else path)

    base = split(root)[1].rstrip("/") if root else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = split("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
                if system.get_file_info(name).type != pafs.FileType.File:
                    continue
                if archive is None:
                    system.delete_file(name)
                else:
                    target = f"{split(archive)[1].rstrip('/')}/{name.removeprefix(base).lstrip('/')}"
                    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    system.move(name, target)
                gone += 1
        yield pa.RecordBatch.from_pydict({"gone": pa.array([gone], pa.int64())})

    chosen = files.select(F.col(path_column).cast("string").alias("path")).where("path is not null").distinct()
    return chosen.mapInArrow(run, "gone long").agg(F.sum("gone")).first()[0] or 0


def remove_verified(frames: DataFrame, grids: DataFrame, path_column: str, key: str = "stem", archive: str | None = None, root: str | None = None) -> int:
    """Remove the source files whose grid was verified (``deletable_sources``)."""
    return remove_files(deletable_sources(frames, grids, key), path_column, archive, root)


def frame_cycle(
    palettes: dict[str, DataFrame], grid_path: str, log_path: str, archive: str | None = None, root: str | None = None, sample_rate: int = 4, min_bytes: int = 1000, remove: bool = True
) -> Callable[[DataFrame, int], None]:
    """Batch function over settled frame files: signature test, conversion, verification, log, removal of verified sources.

    A file that is no PNG is a log row with its reason. A source goes only after its grid is written and was found valid, so a
    batch that is repeated after a failure finds every source that it still has to convert.
    """
    convert = convert_batch(palettes, grid_path, log_path, sample_rate, min_bytes)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        paths = [r[0] for r in batch.select("path").collect()]  # at most the files of a trigger
        if not paths:
            return
        sound = [r[0] for r in valid_frames(spark.read.format("binaryFile").load(paths)).select("path").collect()]
        if sound:
            convert(spark.read.format("image").schema(IMAGE).load(sound).select("image.*"), batch_id)
        odd = batch.join(spark.createDataFrame([(p,) for p in map(_plain, sound)], "sound string"), _plain_path() == F.col("sound"), "left_anti")
        odd.select(F.lit(False).alias("success"), file_name(F.col("path")).alias("filename"), F.lit(None).cast("int").alias("bytes"), F.lit("not a png").alias("error")).write.mode("overwrite").parquet(f"{log_path}/unread={batch_id}")
        if remove and sound:
            done = spark.read.parquet(f"{log_path}/batch={batch_id}").where("success").select(F.col("filename").alias("stem"), F.lit("valid").alias("problem"))
            remove_verified(batch.withColumn("stem", file_name(F.col("path"))), done, "path", archive=archive, root=root)

    return run


def _plain(path: str) -> str:
    """A path without the slashes that writers of local paths add or leave out."""
    return path.replace("file:///", "file:/")


def _plain_path():
    return F.replace("path", F.lit("file:///"), F.lit("file:/"))
