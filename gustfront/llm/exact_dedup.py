"""Exact deduplication through an extendible-hash index.

Texts are equal when they are identical after lower-casing A-Z only; null counts as the empty text.

1. Every row's normalised text gets a 64-bit key and a SHA-256; these entries are written as a table.
2. A directory of 2**depth cells over the leading key bits is doubled until each bucket holds at most the
   bucket capacity, as in extendible hashing: a bucket of small local depth owns many neighbouring cells.
3. Owner tasks each take the buckets of one key range, sorted by key. Texts with one key form a chain and are
   compared byte by byte, so two texts that share a key stay apart; the row that stays and the group's size are reduced along
   the chain. Every map task first collapses the equal texts it has seen in the same way, so that a text with very many
   copies reaches its owner once per map task.
4. The index is written as a table (key, place in the chain, digest, row that stays, group size) and joined to the entries.

Defined cases: an empty table gives no rows; null and empty texts are one group; a null ``doc_id`` ranks
below all others; of rows that repeat both text and the largest ``doc_id`` one stays; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustfront.llm.common import bounded, map_batches, numbered, only_rows, stored, texts_as_bytes, with_row_id

BITS = 64
#: Bytes of distinct texts that one map task holds before it passes them on.
HELD_BYTES = 64 << 20


def keyed(text: bytes) -> tuple[int, bytes]:
    """Key (signed 64 bits) and normalised bytes."""
    text = text.lower()
    return xxhash.xxh3_64_intdigest(text) - (1 << 63), text


def build_directory(weights: dict[int, int], depth: int, capacity: int) -> list[int]:
    """Bucket number of every cell; a bucket is split in halves while it holds more than ``capacity``."""
    totals = [0]
    for cell in range(1 << depth):
        totals.append(totals[-1] + weights.get(cell, 0))
    directory, number, stack = [0] * (1 << depth), 0, [(0, 1 << depth)]
    while stack:
        start, width = stack.pop()
        if width > 1 and totals[start + width] - totals[start] > capacity:
            stack += [(start + width // 2, width // 2), (start, width // 2)]
        else:
            directory[start : start + width] = [number] * width
            number += 1
    return directory


def entries(rows: DataFrame) -> DataFrame:
    def step(batch: pa.RecordBatch) -> dict:
        found = [keyed(x) for x in texts_as_bytes(batch["text"])]
        return {
            "rid": batch["rid"], "doc_id": batch["doc_id"], "key": [k for k, _ in found],
            "sha": [hashlib.sha256(x).hexdigest() for _, x in found], "size": pa.array([len(x) for _, x in found], pa.int64()),
        }

    return map_batches(rows, step, "rid long, doc_id long, key long, sha string, size long")


def _later(a: tuple, b: tuple) -> tuple:
    """The row of two, each (doc_id, rid), that stays: the larger id, a null one below all."""
    return a if (a[0] is not None, a[0] or 0, a[1]) >= (b[0] is not None, b[0] or 0, b[1]) else b


def _merged(chain: dict[bytes, list], text: bytes, row: tuple, count: int) -> bool:
    """Take a text into a chain of [row that stays, rows, ...]; whether it is new there. Texts are compared byte by byte."""
    seen = chain.get(text)
    if seen is None:
        chain[text] = [row, count]
        return True
    seen[0], seen[1] = _later(seen[0], row), seen[1] + count
    return False


def representatives(rows: DataFrame, directory: list[int], depth: int) -> DataFrame:
    """Each task's distinct texts: bucket that owns them, row that stays so far and number of rows."""
    shift = BITS - depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            keys = [keyed(t)[0] for t in seen]
            found = list(seen.values())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([directory[(k + (1 << 63)) >> shift] for k in keys], pa.int32()), pa.array(keys, pa.int64()), pa.array([r[0] for r, _ in found], pa.int64()),
                    pa.array([r[1] for r, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64()), pa.array(list(seen), pa.binary()),
                ],
                names=["bucket", "key", "doc_id", "rid", "n", "text"],
            )

        for batch in batches:
            for piece in bounded(batch):
                for text, doc_id, rid in zip(texts_as_bytes(piece["text"]), piece["doc_id"].to_pylist(), piece["rid"].to_pylist(), strict=True):
                    text = text.lower()
                    if _merged(seen, text, (doc_id, rid), 1):
                        held += len(text)
                    if held > HELD_BYTES:
                        yield flush()
                        seen, held = {}, 0
        if seen:
            yield flush()

    return rows.select("rid", "doc_id", "text").mapInArrow(run, "bucket int, key long, doc_id long, rid long, n long, text binary")


def chains(ordered: DataFrame) -> DataFrame:
    """Walk rows ordered by key; one row per distinct text: its place in the chain of its key, the row that stays, the group's size."""
    names = {"key": pa.int64(), "place": pa.int32(), "sha": pa.string(), "keep_id": pa.int64(), "keep_rid": pa.int64(), "group_size": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chain = None, {}
        out: list[tuple] = []

        def close() -> None:
            out.extend((current, place, hashlib.sha256(text).hexdigest(), *row, count) for place, (text, (row, count)) in enumerate(chain.items()))

        def emitted() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), names.values(), strict=True)], names=list(names))
            out.clear()
            return made

        for batch in batches:
            for piece in bounded(batch):
                for key, text, doc_id, rid, n in zip(*(piece[c].to_pylist() for c in ("key", "text", "doc_id", "rid", "n")), strict=True):
                    if key != current:
                        close()
                        current, chain = key, {}
                    _merged(chain, text, (doc_id, rid), n)
                if out:
                    yield emitted()
        close()
        if out:
            yield emitted()

    return ordered.mapInArrow(run, "key long, place int, sha string, keep_id long, keep_rid long, group_size long")


def exact_groups(docs: DataFrame, rid: str | None = None) -> DataFrame:
    """Per row: rid, doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    if rid is None:
        docs, rid = with_row_id(docs)  # both passes over the texts name rows alike
    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rid=rid)
    held = stored(entries(rows), "dedup-entries")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = held.agg(F.sum("size")).first()[0] or 0
    capacity = max(16 << 10, total // (8 * parts))
    depth = max(4, min(24, math.ceil(math.log2(max(1, total / capacity))) + 3))
    cell = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63)).cast("long")), BITS - depth)
    weighed = held.groupBy("key", "sha").agg(F.max("size").alias("size")).groupBy(cell.alias("cell")).agg(F.sum("size").alias("w"))
    directory = build_directory({r["cell"]: r["w"] for r in weighed.collect()}, depth, capacity)  # 2**depth cells at most
    owned = representatives(rows, directory, depth).repartition(parts, "bucket").sortWithinPartitions("bucket", "key")
    index = stored(chains(owned), "dedup-index")
    return held.join(index, ["key", "sha"]).select("rid", "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row keeps; all columns stay."""
    named, row = with_row_id(docs)
    return only_rows(named, row, exact_groups(named, row).where("kept").select("rid"), docs.columns)
