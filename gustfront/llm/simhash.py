"""SimHash near-duplicates through vantage-point trees.

A document's fingerprint is the bitwise majority of the XXH64 values (seed 42) of its 4-word shingles, repeats included.
Fingerprints within 4 bits are linked; the classes are the connected components.

**Search.** The 64 bits are cut into three masks. Fingerprints at most 4 bits apart differ in at most one bit on one of
the masks at least, so three trees with radius 1 find every pair. In a tree every level has a vantage point; a
fingerprint goes inside or outside by its distance to it on the mask, measured against the median. Each fingerprint has one
home shard per tree and is sent as a query to each shard that the triangle inequality cannot rule out: inside if
distance - 1 <= median, outside if distance + 1 > median. Shards check full distances and return a spanning forest of the
links they find, never all pairs. Depth follows the number of distinct fingerprints. A shard above its size (fingerprints
that lie close together) is cut into blocks; every query visits all blocks.

**Components.** Smallest labels travel along the forest and are shortened by pointer jumping until nothing changes; every
round is written to the shared folder. Copies of one fingerprint are one node throughout.

Defined cases: null and empty texts have fingerprint zero and are linked like others; texts of fewer than four words have one
shingle, the whole sequence; an empty table gives no rows; a null ``doc_id`` is never the smallest unless a component has no
other; repeated rows are members like others; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustfront.llm.common import U64, map_batches, mixed, numbered, signed, only_rows, stored, texts_as_bytes, with_row_id

SEED, SHINGLE, RADIUS = 42, 4, 4
MASKS = tuple(sum(1 << b for b in range(t, 64, 3)) for t in range(3))
SHARD = 1024
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # splits at space and 0x09 to 0x0D
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        values = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=U64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
        starts = np.concatenate([[0], ends[: n - SHINGLE]]).tolist()
        digest = xxhash.xxh64_intdigest
        values = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)), dtype=U64, count=n - SHINGLE + 1)
    columns = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > len(values)).tolist()))


def fingerprints(rows: DataFrame) -> DataFrame:
    def step(batch: pa.RecordBatch) -> dict:
        found = np.fromiter((fingerprint(x) for x in texts_as_bytes(batch["text"])), dtype=U64, count=batch.num_rows)
        return {"rid": batch["rid"], "doc_id": batch["doc_id"], "fp": signed(found)}

    return map_batches(rows, step, "rid long, doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def shards_of(fps: np.ndarray, tree: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, shard, home) of every visit that the fingerprints pay to the shards of one tree."""
    mask = U64(MASKS[tree])
    middle = (bin(MASKS[tree]).count("1") - 1) // 2
    vantage = mixed(np.arange(1, depth + 1, dtype=U64) + U64(1000 * (tree + 1)))
    place, shard, home = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64), np.ones(len(fps), dtype=bool)
    for level in range(depth):
        d = distance(fps & mask, vantage[level] & mask).astype(np.int64)[place]
        inside, outside, own = d - 1 <= middle, d + 1 > middle, d <= middle
        place, shard, home = (
            np.concatenate([place[inside], place[outside]]),
            np.concatenate([shard[inside] * 2, shard[outside] * 2 + 1]),
            np.concatenate([(home & own)[inside], (home & ~own)[outside]]),
        )
    return place, shard, home


def visits(nodes: DataFrame, depth: int) -> DataFrame:
    def step(batch: pa.RecordBatch) -> dict:
        fps = batch["fp"].to_numpy(zero_copy_only=False).view(U64)
        parts = [shards_of(fps, t, depth) for t in range(len(MASKS))]
        return {
            "shard": np.concatenate([s * len(MASKS) + t for t, (_, s, _) in enumerate(parts)]),
            "home": np.concatenate([h for _, _, h in parts]),
            "fp": signed(np.concatenate([fps[p] for p, _, _ in parts])),
        }

    return map_batches(nodes.select("fp"), step, "shard long, home boolean, fp long")


def linked(frame: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between the home fingerprints of a shard (or block) and its visitors."""
    fps, home = frame["fp"].to_numpy().view(U64), frame["home"].to_numpy()
    order = np.argsort(fps, kind="stable")
    fps, home = fps[order], home[order]
    label = np.arange(len(fps))
    for k in np.flatnonzero(home):
        near = np.flatnonzero(distance(fps, fps[k]) <= RADIUS)
        if len(near) > 1:
            labels = np.unique(label[near])
            if len(labels) > 1:
                label[np.isin(label, labels[1:])] = labels[0]
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return pd.DataFrame({"a": signed(fps[moved]), "b": signed(fps[label[moved]])})


def links(nodes: DataFrame, count: int) -> DataFrame:
    """Edges (a, b) whose components are those of the graph of all pairs within the radius."""
    depth = max(0, math.ceil(math.log2(max(1, count / SHARD))))
    seen = visits(nodes, depth)
    large = seen.groupBy("shard").agg(F.sum(F.col("home").cast("int")).alias("own")).where(F.col("own") > 4 * SHARD).select("shard", F.ceil(F.col("own") / (2 * SHARD)).cast("int").alias("blocks"))
    placed = seen.join(large, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.hash("fp"), F.col("blocks"))
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("shard", "block", (F.col("home") & (F.col("block") == own)).alias("home"), "fp")
    return placed.groupBy("shard", "block").applyInPandas(linked, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for every node of ``edges``; the root is the smallest fingerprint of its component."""
    edges = stored(edges.where("a <> b").distinct(), "links")
    both = edges.union(edges.select("b", "a")).toDF("fp", "near")
    labels = stored(both.groupBy("fp").agg(F.least(F.min("near"), F.col("fp")).alias("root")), "labels")
    while True:
        seen = both.join(labels.toDF("near", "other"), "near").groupBy("fp").agg(F.min("other").alias("other"))
        lower = labels.join(seen, "fp").select("fp", "root", F.least("root", "other").alias("low"))
        jump = labels.toDF("low", "next")
        after = stored(lower.join(jump, "low").select("fp", F.least("low", "next").alias("root"), (F.least("low", "next") < F.col("root")).alias("moved")), "labels")
        labels = after.select("fp", "root")
        if after.where("moved").isEmpty():
            return labels


def near_groups(docs: DataFrame, rid: str | None = None) -> DataFrame:
    """Per row: rid, doc_id, fp (signed 64 bits), fingerprint (hex), component_id."""
    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rid=rid)
    held = stored(fingerprints(rows), "fingerprints")
    nodes = stored(held.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid")).alias("stays")), "nodes")
    roots = components(links(nodes, nodes.count()))
    classed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = classed.groupBy("root").agg(F.min("first").alias("component_id"), F.min("stays").alias("stays"))
    known = stored(classed.select("fp", "root").join(firsts, "root").select("fp", "component_id", F.col("stays.rid").alias("keep_rid")), "classes")
    return held.join(known, "fp").select("rid", "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", (F.col("rid") == F.col("keep_rid")).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id; all columns stay."""
    named, row = with_row_id(docs)
    return only_rows(named, row, near_groups(named, row).where("kept").select("rid"), docs.columns)
