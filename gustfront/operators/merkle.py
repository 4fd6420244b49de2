"""Fingerprints of key lists of any size: streamed bucket digests and a Merkle tree over ranges of key hashes.

Keys are dealt to ranges of their md5, the same for every table, and stream through one digest per range in key order, so no
list is ever held. A tree over the ranges gives one fingerprint, is brought up to date by the ranges that changed, and names the
ranges in which two tables differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 52
DEPTH, FAN_BITS = 12, 4


def key_hash(key: Column) -> Column:
    """The first 13 hex digits of a key's md5 as a number; null keys are 0."""
    return F.coalesce(F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long"), F.lit(0))


def range_of(key: Column, depth: int = DEPTH) -> Column:
    return F.shiftright(key_hash(key.cast("string")), HASH_BITS - depth)


def streamed_digests(counted: DataFrame, group: str, form) -> DataFrame:
    """(group, n, digest): the sha256 over ``form(key, repeats)`` of a group's keys in order; ``counted`` has (group, k, n), k distinct."""
    ordered = counted.select(F.col(group).cast("long").alias(group), "k", "n").repartition(group).sortWithinPartitions(group, "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, total, out = None, None, 0, []
        for batch in batches:
            for g, k, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if g != current or digest is None:
                    if digest is not None:
                        out.append((current, total, digest.hexdigest()))
                    current, digest, total = g, hashlib.sha256(), 0
                digest.update(form(k, n))
                total += n
            if len(out) > 10_000:
                yield made(out)
        if digest is not None:
            out.append((current, total, digest.hexdigest()))
        if out:
            yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], names=[group, "n", "digest"])
        rows.clear()
        return batch

    return ordered.mapInArrow(run, f"{group} long, n long, digest string")


def counted_keys(rows: DataFrame, key: str) -> DataFrame:
    """Distinct keys as text with their repeats."""
    return rows.groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias("n"))


def _leaf_form(k: str | None, n: int) -> bytes:
    """Length and bytes of the key and its repeats; a null key differs from every text."""
    data = (k or "").encode()
    return f"{-1 if k is None else len(data)}:{n}:".encode() + data


def merkle_leaves(rows: DataFrame, key: str, depth: int = DEPTH) -> DataFrame:
    """(leaf, n, digest) of every range that holds keys; 2**depth ranges, even in size as md5 is."""
    return streamed_digests(counted_keys(rows, key).withColumn("leaf", range_of(F.col("k"), depth)), "leaf", _leaf_form)


def updated_leaves(leaves: DataFrame, rows: DataFrame, changed: DataFrame, key: str, depth: int = DEPTH) -> DataFrame:
    """``leaves`` after the keys in ``changed`` (added, repeated or removed): only their ranges of ``rows`` are digested again."""
    touched = changed.select(range_of(F.col(key), depth).alias("leaf")).distinct()
    again = rows.withColumn("_leaf", range_of(F.col(key), depth)).join(touched.withColumnRenamed("leaf", "_leaf"), "_leaf", "left_semi").drop("_leaf")
    return leaves.join(touched, "leaf", "left_anti").unionByName(merkle_leaves(again, key, depth))


def merkle_tree(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(level, node, n, digest) of all levels, the root being level 0; a node is the digest of its children that exist, at most 16."""
    level, bits = leaves.select(F.lit(-(-depth // FAN_BITS)).alias("level"), F.col("leaf").alias("node"), "n", "digest"), depth
    tree = level
    while bits > 0:
        step = bits % FAN_BITS or FAN_BITS
        bits -= step
        child = F.array_sort(F.collect_list(F.struct("node", "digest")))
        level = level.groupBy((F.col("level") - 1).alias("level"), F.shiftright("node", step).alias("up")).agg(F.sum("n").alias("n"), child.alias("c"))
        joined = F.array_join(F.transform("c", lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["digest"])), ";")
        level = level.select("level", F.col("up").alias("node"), "n", F.sha2(joined, 256).alias("digest"))
        tree = tree.unionByName(level)
    return tree


def tree_fingerprint(tree: DataFrame) -> DataFrame:
    """n and the first 16 digits of the root."""
    return tree.where("level = 0").select("n", F.substring("digest", 1, 16).alias("fingerprint"))


def differing_ranges(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ranges in which two tables differ: leaf, keys of each side (0 where a side has none), from the leaves of both."""
    a, b = left.select("leaf", F.col("n").alias("left_n"), F.col("digest").alias("_a")), right.select("leaf", F.col("n").alias("right_n"), F.col("digest").alias("_b"))
    both = a.join(b, "leaf", "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select("leaf", F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))


def exact_fingerprint(rows: DataFrame, key: str, parts: int = 4096) -> DataFrame:
    """16 hex digits that fix the exact list of keys, repeats included, at any size.

    Layout: keys are dealt into ``parts`` buckets by the first 13 hex digits of their md5 (modulo ``parts``); a
    bucket's digest is the sha256 of its sorted keys, each followed by its number of repeats; the
    fingerprint is the sha256 of the digests in bucket order, empty ones as empty text. With ``parts=1`` and distinct
    keys without repeats this is one digest over the whole sorted list. Repeats collapse first, and a bucket's keys
    stream through its digest, so no list is held; ``parts`` only decides how many tasks share the work.
    """
    dealt = counted_keys(rows, key).select(F.pmod(key_hash(F.col("k")), F.lit(parts)).alias("bucket"), F.coalesce("k", F.lit("")).alias("k"), "n")
    digests = streamed_digests(dealt, "bucket", lambda k, n: k.encode() + (f"*{n}".encode() if n > 1 else b""))
    if parts == 1:
        return digests.select("n", F.substring("digest", 1, 16).alias("fingerprint"))
    ordered = digests.agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("bucket", "digest"))).alias("all"))  # one digest per bucket
    joined = F.array_join(F.transform("all", lambda e: F.concat(e["bucket"].cast("string"), F.lit(":"), e["digest"])), ";")
    return ordered.select(F.coalesce("n", F.lit(0)).alias("n"), F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))
