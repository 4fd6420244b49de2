"""Audit of how five document filters interact, with duplicates found in radix tries over whole texts.

Filters, as failure conditions: A fewer than 100 words; B under 80 % distinct words; C over 10 % capital letters A-Z;
D holds one of ``#$%&*|``; E equals the text of a smaller doc_id anywhere in the table.

1. One pass turns every row into (doc_id, part, mask of A to D, 128-bit digest), written as a table.
2. Text space is cut into ranges by adaptive prefixes: the heads of the distinct texts are range-partitioned, and a range
   begins at the shortest prefix that tells its least head from the greatest one before it. A range that holds over
   twice a bucket's bytes, such as a crowd of texts with one long head, is cut again on heads 16 times as long.
   Of each range only its ends and bytes reach the driver.
3. Every map task inserts its texts into a radix trie whose terminals hold the smallest id and the number of rows, and
   passes each distinct text on once. The owner of a range merges these in one trie per bucket, compared byte by
   byte, and lists the terminals of several rows. So a text with very many copies reaches its owner once a map task.
4. Rows are counted by (digest, part, mask, labels) with the ids equal to the smallest one apart, meet the terminals, and
   reduce to counts by (part, mask of A to E, labels): at most 128 a part. All 120 orders are read off those.

Bucket size follows ``spark.sql.shuffle.partitions`` (an eighth of a partition), as does a task's memory.

Defined cases: a null text is empty, a null ``lang`` is the part ""; a null ``doc_id`` has no label and neither is a
duplicate nor makes one; rows that repeat an id and its text are no duplicates of each other; a label row with
quality (toxic) 1 counts whatever other label rows of the id say; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustfront.llm.common import bounded, map_batches, numbered, stored, texts_as_bytes

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = re.compile(rb"[#$%&*|]")
DUPLICATE = 1 << FILTERS.index("E")
#: Bytes of distinct text that a map task's trie holds before it is passed on.
HELD_BYTES = 64 << 20
#: Bytes that a trie's node takes besides its label, about.
NODE_BYTES = 300
#: Bytes of text heads looked at first when prefixes are chosen, and the factor by which a crowd's are lengthened.
HEAD_BYTES, HEAD_GROWTH, MOST_HEAD_BYTES = 256, 16, 1 << 28


def own_failures(data: bytes, points: int) -> int:
    """Mask of the filters A to D that a text fails."""
    words = data.split()  # bytes split at \x20 and \x09-\x0D only
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * (len(data) - len(data.translate(None, CAPITALS))) > CAPITAL_PERCENT * points) << 2
        | (SIGNS.search(data) is not None) << 3
    )


def digest(data: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_digest(data)
    return int.from_bytes(both[:8], "big", signed=True), int.from_bytes(both[8:], "big", signed=True)


def shared_length(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixTrie:
    """Compressed trie over bytes; a terminal holds the smallest id of its text and the number of rows.

    A node is [edge label, children by first byte, smallest id or None, rows].
    """

    def __init__(self):
        self.root, self.held = [b"", {}, None, 0], 0

    def insert(self, text: bytes, least: int, rows: int = 1) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, least, rows]
                self.held += len(text) - at + NODE_BYTES
                return
            label = child[0]
            if text.startswith(label, at):
                at += len(label)
            else:
                rest = text[at : at + len(label)]
                cut = shared_length(label, rest)
                upper = [label[:cut], {label[cut]: child}, None, 0]
                child[0] = label[cut:]
                node[1][text[at]] = child = upper
                at += cut
            node = child
        node[2] = least if node[2] is None else min(node[2], least)
        node[3] += rows

    def terminals(self) -> Iterator[tuple[bytes, int, int]]:
        """(text, smallest id, rows) in text order."""
        stack = [(b"", self.root)]
        while stack:
            head, (label, children, least, rows) = stack.pop()
            text = head + label
            if rows:
                yield text, least, rows
            stack += [(text, children[b]) for b in sorted(children, reverse=True)]


def profile(rows: DataFrame) -> DataFrame:
    """doc_id, part, mask and digest of every row."""

    def step(batch: pa.RecordBatch) -> dict:
        data = texts_as_bytes(batch["text"])
        points = pc.fill_null(pc.utf8_length(batch["text"]), 0).to_pylist()
        digests = [digest(x) for x in data]
        masks = [own_failures(x, n) for x, n in zip(data, points, strict=True)]
        return {"doc_id": batch["doc_id"], "part": batch["part"], "mask": pa.array(masks, pa.int32()), "d1": [d[0] for d in digests], "d2": [d[1] for d in digests]}

    return map_batches(rows, step, "doc_id long, part string, mask int, d1 long, d2 long")


def heads(rows: DataFrame, size: int) -> DataFrame:
    """The first ``size`` bytes of every distinct text, with the bytes that its node takes."""
    return (
        rows.select(F.expr(f"left(cast(text as binary), {size})").alias("head"), (F.octet_length("text") + NODE_BYTES).cast("long").alias("bytes"), F.xxhash64("text").alias("h"))
        .groupBy("h", "head").agg(F.max("bytes").alias("bytes")).select("head", "bytes")
    )


def within(found: DataFrame, size: int, crowds: list[tuple[bytes, bytes]]) -> DataFrame:
    """The heads whose first ``size`` bytes lie in one of the ``crowds`` (least and greatest head)."""
    lows = [low for low, _ in crowds]

    def step(batch: pa.RecordBatch) -> dict:
        short = [x[:size] for x in batch["head"].to_pylist()]
        at = [bisect_right(lows, x) - 1 for x in short]
        mask = pa.array([n >= 0 and x <= crowds[n][1] for n, x in zip(at, short, strict=True)], pa.bool_())
        return {"head": batch["head"].filter(mask), "bytes": batch["bytes"].filter(mask)}

    return map_batches(found, step, "head binary, bytes long")


def adaptive_prefixes(rows: DataFrame, parts: int) -> list[bytes]:
    """Sorted first prefixes of the ranges; range n holds the texts from prefix n up to, not including, prefix n + 1."""
    starts, size, count, capacity = {b""}, HEAD_BYTES, 8 * parts, 0
    crowds: list[tuple[bytes, bytes]] = []
    while True:
        found = heads(rows, size)
        found = stored(within(found, size // HEAD_GROWTH, crowds) if crowds else found, "audit-heads")
        cut = found.repartitionByRange(count, "head").select("head", "bytes", F.spark_partition_id().alias("range"))
        ranges = cut.groupBy("range").agg(F.min("head").alias("low"), F.max("head").alias("high"), F.sum("bytes").alias("bytes")).collect()
        ranges.sort(key=lambda r: r["low"])
        if not capacity:
            capacity = max(16 << 10, sum(r["bytes"] for r in ranges) // count)
        held = 0
        for before, r in zip([None, *ranges], ranges):
            held += r["bytes"]
            if before and held > capacity:  # small neighbours stay together
                starts.add(r["low"][: shared_length(before["high"], r["low"]) + 1])
                held = r["bytes"]
        crowds = [(r["low"], r["high"]) for r in ranges if r["bytes"] > 2 * capacity and (r["low"] != r["high"] or len(r["low"]) == size)]
        if not crowds or size >= MOST_HEAD_BYTES:
            return sorted(starts)
        size *= HEAD_GROWTH


def _batches(found: Iterator[tuple], columns: list[tuple[str, pa.DataType]], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows whose last value is a text, as batches of about ``limit`` bytes."""
    held, size = [], 0
    for row in found:
        held.append(row)
        size += 32 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), columns, strict=True)], names=[n for n, _ in columns])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), columns, strict=True)], names=[n for n, _ in columns])


def local_tries(rows: DataFrame, starts: list[bytes]) -> DataFrame:
    """The terminals of every map task's tries with the number of their range."""
    columns = [("bucket", pa.int32()), ("least", pa.int64()), ("rows", pa.int64()), ("text", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(trie: RadixTrie) -> Iterator[pa.RecordBatch]:
            return _batches(((bisect_right(starts, text) - 1, least, n, text) for text, least, n in trie.terminals()), columns)

        trie = RadixTrie()
        for batch in batches:
            for piece in bounded(batch):
                for text, doc_id in zip(texts_as_bytes(piece["text"]), piece["doc_id"].to_pylist(), strict=True):
                    trie.insert(text, doc_id)
                if trie.held > HELD_BYTES:
                    yield from flush(trie)
                    trie = RadixTrie()
        yield from flush(trie)

    return rows.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "bucket int, least long, rows long, text binary")


def repeated_texts(rows: DataFrame, parts: int) -> DataFrame:
    """Digest and smallest id of every text that several rows hold."""
    starts = adaptive_prefixes(rows, parts)
    owned = local_tries(rows, starts).repartitionById(parts, (F.col("bucket").cast("long") * parts / len(starts)).cast("int")).sortWithinPartitions("bucket")
    columns = [("d1", pa.int64()), ("d2", pa.int64()), ("least", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def repeated(trie: RadixTrie) -> Iterator[pa.RecordBatch]:
            return _batches(((*digest(text), least) for text, least, n in trie.terminals() if n > 1), columns)

        current, trie = None, RadixTrie()
        for batch in batches:
            for bucket, least, n, text in zip(*(batch[c].to_pylist() for c in ("bucket", "least", "rows", "text")), strict=True):
                if bucket != current:
                    yield from repeated(trie)
                    current, trie = bucket, RadixTrie()
                trie.insert(text, least, n)
        yield from repeated(trie)

    return owned.mapInArrow(run, "d1 long, d2 long, least long")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, good rows and toxic rows by part and mask of failed filters."""
    spark = docs.sparkSession
    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).drop("rid")
    held = stored(profile(rows), "audit-rows")
    repeats = stored(repeated_texts(rows, int(spark.conf.get("spark.sql.shuffle.partitions"))), "audit-repeats")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).cast("long").alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    named = held.where("doc_id is not null").join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"])
    key = ["d1", "d2", "part", "mask", "good", "toxic"]
    groups = (
        named.groupBy(*key, "doc_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*key).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    )
    firsts = F.when(F.col("least").isNull(), F.col("n")).when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = groups.join(repeats, ["d1", "d2"], "left").select(
        "part", "good", "toxic", F.explode(F.array(F.struct("mask", firsts.alias("n")), F.struct((F.col("mask") + DUPLICATE).alias("mask"), (F.col("n") - firsts).alias("n")))).alias("x")
    )
    counted = split.select("part", "x.mask", "x.n", (F.col("x.n") * F.col("good")).alias("good"), (F.col("x.n") * F.col("toxic")).alias("toxic")).where("n > 0")
    zero = F.lit(0).cast("long")
    nameless = held.where("doc_id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    return counted.unionByName(nameless).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    counts = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most
    orders = list(permutations(range(len(FILTERS))))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def rows_of(part: str, masks: list[dict]) -> list[tuple]:
        table = np.zeros((3, 1 << len(FILTERS)), dtype=np.int64)
        for m in masks:
            table[:, m["mask"]] = m["n"], m["good"], m["toxic"]
        every = np.arange(1 << len(FILTERS))
        out, shapley = [], [0] * len(FILTERS)
        for order in orders:
            before, kept = 0, int(table[0].sum())
            for step, f in enumerate(order, 1):
                fails, gone = (every >> f & 1).astype(bool), (every & before).astype(bool)
                n, good, toxic = table[:, fails & ~gone].sum(axis=1).tolist()
                kept -= n
                shapley[f] += n
                out.append([part, "".join(FILTERS[x] for x in order), step, kept, n, int(table[0, fails & gone].sum()), int(table[0, 1 << f]), good, toxic, f])
                before |= 1 << f
        return [(*x[:-1], shapley[x[-1]]) for x in out]

    def step(batch: pa.RecordBatch) -> dict:
        rows = [r for part, masks in zip(batch["part"].to_pylist(), batch["masks"].to_pylist(), strict=True) for r in rows_of(part, masks)]
        types = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
        return {n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True), types, strict=True)} if rows else {n: [] for n in names}

    return map_batches(counts, step, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names[3:]))
