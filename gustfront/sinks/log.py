"""A table of data folders under a transaction log: snapshot reads, conflict tests, resume by summaries, compaction.

A commit is a numbered file below ``_log`` that is created only if it is not there yet; it names the folders that it adds, with a
summary of their keys, and those that it takes away. Readers see the folders that the commits up to the newest leave, so a run
that broke off, and half of a replacement, are never seen. Of two writers that reach for one number one gets it; the
other reads what came between, drops the keys that were committed meanwhile and tries the next number.

A summary holds the least and greatest key and a Bloom filter of the keys' hashes, built as an aggregate. A resume opens only folders
whose filter says that they may hold one of its keys; the anti join on those decides.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gustfront.operators.lookups import not_yet_done

#: Column of the folder that a row lies in.
RUN = "__run"
HASHES, BITS_PER_KEY = 5, 10
#: Bits of a filter: a power of two between these. A fuller filter says "maybe" more often, never "no" wrongly.
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 23


def filter_size(keys: int) -> int:
    return max(LEAST_BITS, min(MOST_BITS, 1 << max(0, int(keys * BITS_PER_KEY - 1).bit_length())))


def bit_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of every hash in the filter (hashes x ``HASHES``), by double hashing."""
    h = hashes.astype(np.int64, copy=False).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def _hashed(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.xxhash64(F.col(key).cast("string")).alias("h"))


def summary_of(df: DataFrame, key: str) -> dict:
    """Rows, key range and Bloom filter of the keys of a written folder; what reaches the driver is one filter."""
    text = F.col(key).cast("string")
    ends = df.agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("low"), F.max(text).alias("high"), F.approx_count_distinct(text).alias("keys")).first()
    bits = filter_size(ends["keys"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits, dtype=bool)
        for batch in batches:
            held[bit_places(batch.column(0).to_numpy(), bits).ravel()] = True
        packed = np.packbits(held, bitorder="little").view(np.int64)
        used = np.flatnonzero(packed)
        yield pa.RecordBatch.from_pydict({"word": pa.array(used, pa.int32()), "bits": pa.array(packed[used], pa.int64())})

    found = _hashed(df, key).mapInArrow(words, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    packed = np.zeros(bits // 64, dtype=np.int64)
    packed[found["word"].to_numpy()] = found["bits"].to_numpy()
    return {"rows": ends["n"], "low": ends["low"], "high": ends["high"], "bits": bits, "filter": base64.b64encode(zlib.compress(packed.tobytes(), 1)).decode()}


def filter_bits(summary: dict) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(base64.b64decode(summary["filter"])), dtype=np.uint8), bitorder="little").astype(bool)


class TransactionLog:
    """Commits of a table below ``path``: folder to summary (or None) after each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commit_file(self, number: int):
        return self._path(f"{self.path}/_log/{number:020d}.json")

    def commits(self) -> list[dict]:
        """All commits in order. A file without its closing brace is one whose writer died; it takes nothing and adds nothing."""
        if not self.files.exists(self._path(f"{self.path}/_log")):
            return []
        rows = self.spark.read.text(f"{self.path}/_log", wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("name"), "value").collect()
        out = []
        for row in sorted(rows, key=lambda r: r["name"]):
            try:
                out.append(json.loads(row["value"]) | {"number": int(row["name"].split(".")[0])})
            except json.JSONDecodeError:
                out.append({"add": {}, "remove": [], "number": int(row["name"].split(".")[0])})
        return out

    def snapshot(self) -> tuple[int, dict[str, dict | None]]:
        """The newest commit's number (0: none) and the folders that it leaves."""
        number, folders = 0, {}
        for commit in self.commits():
            number = commit["number"]
            for gone in commit["remove"]:
                folders.pop(gone, None)
            folders |= commit["add"]
        return number, folders

    def try_commit(self, number: int, add: dict[str, dict | None], remove: list[str], schema: StructType | None = None) -> bool:
        """Write commit ``number`` unless someone has; whether it is ours."""
        data = json.dumps({"add": add, "remove": remove} | ({"schema": schema.json()} if schema else {})).encode()
        try:
            stream = self.files.create(self._commit_file(number), False)
        except Exception as error:  # py4j wraps the file system's "already exists"
            if self.files.exists(self._commit_file(number)):
                return False
            raise error
        try:
            stream.write(data)
        finally:
            stream.close()
        return True

    def new_folder(self) -> str:
        return f"{RUN}={uuid.uuid4().hex}"

    def frame(self, folders: list[str], schema: StructType) -> DataFrame:
        placed = StructType([*schema.fields, StructField(RUN, StringType())])  # runs are partitions of one table, below which rows may be partitioned again
        return self.spark.read.schema(placed).option("basePath", self.path).parquet(*[f"{self.path}/{f}" for f in folders]).select(*schema.names)

    def schema(self) -> StructType | None:
        """Columns as the newest commit that adds rows has them."""
        known = [c["schema"] for c in self.commits() if "schema" in c]
        return StructType.fromJson(json.loads(known[-1])) if known else None

    def read(self) -> DataFrame | None:
        """Rows of the newest snapshot; None if nothing was ever committed."""
        schema, folders = self.schema(), sorted(self.snapshot()[1])
        if schema is None:
            return None
        return self.frame(folders, schema) if folders else self.spark.createDataFrame([], schema)

    def may_hold(self, keys: DataFrame, key: str, folders: dict[str, dict | None]) -> list[str]:
        """The folders that may hold one of ``keys``: those without a summary, and those whose range and filter allow one."""
        text = F.col(key).cast("string")
        ends = keys.agg(F.min(text).alias("low"), F.max(text).alias("high")).first()
        if ends["low"] is None:
            return []
        open_ = {f: s for f, s in folders.items() if s is None or (s["low"] is not None and s["low"] <= ends["high"] and s["high"] >= ends["low"])}
        names = sorted(f for f, s in open_.items() if s is not None)
        filters = [filter_bits(open_[f]) for f in names]

        def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            left = dict(enumerate(filters))
            for batch in batches:
                h = batch.column(0).to_numpy()
                for n in [n for n, bits in left.items() if bits[bit_places(h, len(bits))].all(axis=1).any()]:
                    del left[n]
                    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int32())})

        found = [names[r["n"]] for r in _hashed(keys, key).mapInArrow(hit, "n int").distinct().collect()] if names else []
        return sorted(found + [f for f, s in open_.items() if s is None])

    def append_new(self, rows: DataFrame, key: str, partition: str | None = None) -> list[str]:
        """Append the rows whose key no commit holds, all or nothing; returns the folders that were opened to find out.

        Rows are computed once and written; what other commits hold is then taken out of the written folder, before
        the first attempt to commit and again after each one that another writer won. Rows without a key are appended each
        time, as nothing tells them apart.
        """
        folder, checked, opened = self._write(rows, partition), set(), []
        while True:
            number, folders = self.snapshot()
            written = self.frame([folder], rows.schema)
            found = self.may_hold(written, key, {f: s for f, s in folders.items() if f not in checked})
            if found:
                opened += found
                fresh = self._write(not_yet_done(written, self.frame(found, rows.schema).select(key).distinct(), key), partition)
                self._delete(folder)
                folder, written = fresh, self.frame([fresh], rows.schema)
            checked |= set(folders)
            summary = summary_of(written, key)
            if not summary["rows"]:
                self._delete(folder)
                return opened
            if self.try_commit(number + 1, {folder: summary}, [], rows.schema):
                return opened

    def replace(self, rows: DataFrame, partition: str | None = None) -> None:
        """Put ``rows`` in the place of all that is there, in one commit."""
        folder = self._write(rows, partition)
        number, folders = self.snapshot()
        while not self.try_commit(number + 1, {folder: None}, sorted(folders), rows.schema):
            number, folders = self.snapshot()

    def compact(self, key: str, rows_per_folder: int = 1_000_000, partition: str | None = None) -> int:
        """Write the folders of fewer rows into one; the commit that names it takes them away. Returns how many went."""
        number, folders = self.snapshot()
        small = sorted(f for f, s in folders.items() if s is not None and s["rows"] < rows_per_folder)
        if len(small) < 2:
            return 0
        schema = self.schema()
        folder = self._write(self.frame(small, schema), partition)
        summary = summary_of(self.frame([folder], schema), key)
        while not self.try_commit(number + 1, {folder: summary}, small, schema):
            number, folders = self.snapshot()
            if not set(small) <= set(folders):  # taken away meanwhile
                return 0
        return len(small)

    def vacuum(self) -> int:
        """Delete data folders that no snapshot names; only while no writer is at work."""
        kept, gone = set(self.snapshot()[1]), 0
        if not self.files.exists(self._path(self.path)):
            return 0
        for status in self.files.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith(f"{RUN}=") and name not in kept:
                gone += int(self.files.delete(status.getPath(), True))
        return gone

    def _delete(self, folder: str) -> None:
        self.files.delete(self._path(f"{self.path}/{folder}"), True)

    def _write(self, rows: DataFrame, partition: str | None) -> str:
        folder = self.new_folder()
        writer = rows.write
        (writer.partitionBy(partition) if partition else writer).parquet(f"{self.path}/{folder}")
        return folder
