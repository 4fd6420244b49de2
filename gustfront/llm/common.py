"""Helpers shared by the operators: inputs, row ids, written intermediate tables, word hashes."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gustfront.session import materialise

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, *columns: str, rid: str | None = None) -> DataFrame:
    """``columns`` and a row id ``rid``: the column of that name if one is given, else an id that holds for one pass only.

    Other columns go, so that none of them can clash with an operator's own names.
    """
    return df.select((F.monotonically_increasing_id() if rid is None else F.col(rid)).alias("rid"), *columns)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_id(df: DataFrame) -> tuple[DataFrame, str]:
    """All columns of a stored Parquet table and a row id that is the same in every pass, with the id's column name.

    The id is the file's rank by name and the row's place in the file, so it does not depend on how files are split, which
    follows the cores alive when a pass begins.
    """
    spark, name, path, place = df.sparkSession, *(free_name(df, n) for n in ("__row", "__row_path", "__row_place"))
    files = sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect())
    ranks = F.broadcast(spark.createDataFrame([(f, n << 40) for n, f in enumerate(files)], f"`{path}` string, `{name}` long"))
    placed = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
    return placed.join(ranks, path).select(*df.columns, (F.col(name) + F.col(place)).alias(name)), name


def only_rows(named: DataFrame, row: str, stay: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``named`` whose id is in ``stay`` (one column)."""
    stays = free_name(named, "__stays")
    return named.join(stay.toDF(stays), F.col(row) == F.col(stays), "left_semi").select(*columns)


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], dict | None], schema: str, limit: int | None = None) -> DataFrame:
    """Apply ``step`` (batch to columns) to every Arrow batch, in slices of at most ``limit`` bytes (else those of ``bounded``)."""
    names = StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in bounded(batch, limit) if limit else bounded(batch):
                out = step(piece)
                if out is not None and len(out[names[0]]):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names=names)

    return df.mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes (or one row), so that a batch needs no more memory where very long texts lie side by side."""
    if batch.num_rows > 1 and batch.nbytes > limit:
        half = batch.num_rows // 2
        yield from bounded(batch.slice(0, half), limit)
        yield from bounded(batch.slice(half), limit)
    elif batch.num_rows:
        yield batch


def kept_in_worker(kind: str, key, make: Callable):
    """The value for ``key`` in a Python worker, shared by the tasks that it runs, as functions arrive anew with every task.

    Of each kind only the last is kept, so that a worker's memory does not grow with the models that it has served.
    """
    home = sys.modules.setdefault("_gustfront_kept", types.ModuleType("_gustfront_kept"))
    values = home.__dict__.setdefault("values", {})
    if kind not in values or values[kind][0] != key:
        values.pop(kind, None)
        values[kind] = (key, make())
    return values[kind][1]


class Recent(dict):
    """A bounded memory of ``make``'s values: what was asked for in this or the last generation of ``size`` keys stays."""

    def __init__(self, make: Callable, size: int, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.older = make, size, longest, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
            if len(key) >= self.longest:
                return found
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text, empty for null."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage through a table in the shared folder."""
    return materialise(df, f"llm-{name}")


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_ODD, _BYTE = 0x9E3779B97F4A7C15, mixed(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, size: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    if name not in _powers or len(_powers[name]) < size:
        grown = np.full(max(1 << 16, 2 * size), base, dtype=U64)
        grown[0] = 1
        _powers[name] = np.multiply.accumulate(grown)
    return _powers[name][:size]


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for every span, from prefix sums; equal bytes give equal hashes anywhere."""
    size = len(data)
    prefix = np.zeros(size + 1, dtype=U64)
    np.cumsum(_BYTE[np.frombuffer(data, dtype=np.uint8)] * _power("up", _ODD, size), out=prefix[1:])
    inverse = _power("down", pow(_ODD, -1, 1 << 64), size + 1)
    return mixed((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word."""
    if not words:
        return np.zeros(0, dtype=U64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths)
    return span_hashes(b"".join(words), ends - lengths, ends)


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive entries."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=U64)
    total, factor = np.zeros(count, dtype=U64), 1
    for k in range(width):
        total += hashes[k : k + count] * U64(factor)
        factor = factor * 0xC2B2AE3D27D4EB4F % (1 << 64)
    return mixed(total)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
