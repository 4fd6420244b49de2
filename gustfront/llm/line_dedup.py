"""Line deduplication through a deletion-neighbourhood join.

A line is removed when an equal line, or one within one edit (a character put in, left out or replaced), stands earlier: in a
smaller ``doc_id`` (then row), or higher in the same document. Lines are judged on the input. Blank lines stay; lines of fewer than
``SHORTEST`` characters are compared exactly only.

1. Equal lines are collapsed by hash to their earliest place (partial minimum), whatever their number.
2. Two lines within one edit share their first or last half. Distinct lines whose halves are unique have no neighbour and go
   no further; this is exact, since either half survives the edit.
3. The remaining lines emit their deletion neighbourhood as hashed keys: the line itself, and every variant with one character left
   out in a half that is not shared, both alone and with its position. A replaced character gives equal variants at equal
   positions; a character put in makes a variant of the longer line equal the shorter one. A key needs only the earliest line that
   has it, so no pairs are listed.
4. Each line's proposed neighbour is checked by edit distance on the texts, and the earliest place decides.
5. Texts of rows with repeated or neighbouring lines are written once, bucketed by row, and joined twice without moving again.

Defined cases: null and empty texts have one blank line; equal ``doc_id`` are ordered as they are read, null ids first; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustfront.llm.common import U64, map_batches, mixed, numbered, signed, stored, with_row_id
from gustfront.session import scratch_path

SHORTEST = 12
_ODD = 0x9E3779B97F4A7C15


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _codes(line: str) -> np.ndarray:
    return mixed(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U64) + U64(1))


def half_keys(line: str) -> list[int]:
    """Keys of the first and last halves that a neighbour must share one of."""
    n = len(line)
    if n < SHORTEST:
        return []
    data = line.encode("utf-32-le", "surrogatepass")
    found = set()
    for half in {n // 2, (n - 1) // 2}:  # the lowest bit tells which half it is
        found.add(xxhash.xxh3_64_intdigest(data[: 4 * half], half) & -2)
        found.add(xxhash.xxh3_64_intdigest(data[-4 * half :], half) | 1)
    return [k - (1 << 63) for k in sorted(found)]


def neighbourhood(line: str, sides: int = 3) -> tuple[int, np.ndarray, np.ndarray]:
    """Key of the line, keys of its variants, and keys of its variants with the position.

    ``sides`` tells which halves are shared (1 the first, 2 the last); a shared half holds no edit.
    """
    codes = _codes(line)
    n = len(codes)
    with np.errstate(over="ignore"):
        powers = np.full(n + 1, _ODD, dtype=U64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        terms = codes * powers[:n]
        before = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(terms)])
        inverse = U64(pow(_ODD, -1, 1 << 64))
        whole = mixed(before[n : n + 1] + U64(n))[0]
        # after the gap every character moves one place down
        variants = before[:n] + (before[n] - before[1:]) * inverse
        lone = mixed(variants + U64(n - 1))
        fixed = mixed(lone ^ mixed(np.arange(n, dtype=U64) + U64(n * 2654435761)))
        start, end = {1: ((n - 1) // 2, n), 2: (0, n - (n - 1) // 2)}.get(sides, (0, n))
        return int(signed(np.array([whole]))[0]), lone[start:end], fixed[start:end]


def within_one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :] or a == b


def lines_of(rows: DataFrame) -> DataFrame:
    """doc_id, rid, no, hash of every line that is not blank."""

    def step(batch: pa.RecordBatch) -> dict:
        row, no, hashes = [], [], []
        for at, text in enumerate(batch["text"].to_pylist()):
            for i, line in enumerate((text or "").split("\n")):
                if line.strip():
                    row.append(at), no.append(i), hashes.append(line_hash(line))
        take = pa.array(row, pa.int64())
        return {"doc_id": batch["doc_id"].take(take), "rid": batch["rid"].take(take), "no": pa.array(no, pa.int32()), "hash": pa.array(hashes, pa.int64())}

    return map_batches(rows, step, "doc_id long, rid long, no int, hash long")


def near_lines(rows: DataFrame) -> DataFrame:
    """(hash, sides): distinct lines that share a half with another, and which."""

    def step(batch: pa.RecordBatch) -> dict:
        found: dict[int, list[int]] = {}
        for text in batch["text"].to_pylist():
            for line in (text or "").split("\n"):
                if line.strip():
                    value = line_hash(line)
                    if value not in found:
                        found[value] = half_keys(line)
        pairs = [(k, h) for h, keys in found.items() for k in keys]
        return {"key": pa.array([k for k, _ in pairs], pa.int64()), "hash": pa.array([h for _, h in pairs], pa.int64())}

    halves = map_batches(rows, step, "key long, hash long")
    shared = halves.groupBy("key").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a <> b").select("key")
    return halves.join(shared, "key").groupBy("hash").agg(F.bit_or(F.lit(1) + F.col("key").bitwiseAND(F.lit(1)).cast("int")).alias("sides"))


def bucketed_texts(rows: DataFrame, gone: DataFrame, wanted: DataFrame) -> DataFrame:
    """rid, doc_id, n_lines, digest if all stays, and for other rows text, ``gone`` and ``wanted``; bucketed by rid."""
    spark = rows.sparkSession
    notes = gone.groupBy("rid").agg(F.collect_list("no").alias("gone")).join(wanted.groupBy("rid").agg(F.collect_list(F.struct("no", "hash", "sides")).alias("wanted")), "rid", "full")

    def step(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch["text"].to_pylist()]
        noted = [a or b for a, b in zip(batch["gone"].is_valid().to_pylist(), batch["wanted"].is_valid().to_pylist(), strict=True)]
        return {
            "rid": batch["rid"], "doc_id": batch["doc_id"], "n_lines": pa.array([sum(bool(x.strip()) for x in t.split("\n")) for t in texts], pa.int64()),
            "whole": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], "text": pa.array([t if n else None for t, n in zip(texts, noted, strict=True)], pa.string()),
            "gone": batch["gone"], "wanted": batch["wanted"],
        }

    schema = "rid long, doc_id long, n_lines long, whole string, text string, gone array<int>, wanted array<struct<no:int,hash:bigint,sides:int>>"
    every = map_batches(rows.join(notes, "rid", "left").select("rid", "doc_id", "text", "gone", "wanted"), step, schema)
    name = f"gustfront_lines_{uuid.uuid4().hex}"
    every.write.option("path", scratch_path(spark, "line-texts")).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "rid").saveAsTable(name)
    return spark.table(name)


def line_texts(texts: DataFrame) -> DataFrame:
    """doc_id, rid, no, hash, sides and text of the wanted lines."""

    def step(batch: pa.RecordBatch) -> dict:
        out = [(doc_id, rid, w["no"], w["hash"], w["sides"], lines[w["no"]]) for rid, doc_id, text, wanted in zip(*(batch[c].to_pylist() for c in ("rid", "doc_id", "text", "wanted")), strict=True) for lines in [text.split("\n")] for w in wanted]
        kinds = {"doc_id": pa.int64(), "rid": pa.int64(), "no": pa.int32(), "hash": pa.int64(), "sides": pa.int32(), "line": pa.string()}
        return {n: pa.array([x[i] for x in out], kind) for i, (n, kind) in enumerate(kinds.items())}

    return map_batches(texts.where("wanted is not null").select("rid", "doc_id", "text", "wanted"), step, "doc_id long, rid long, no int, hash long, sides int, line string")


def variant_keys(lines: DataFrame) -> DataFrame:
    """(key, role, hash): role 0 a line as it is, 1 a variant, 2 a variant with its position."""

    def step(batch: pa.RecordBatch) -> dict:
        keys, roles, rows = [], [], []
        for row, (line, sides) in enumerate(zip(batch["line"].to_pylist(), batch["sides"].to_pylist(), strict=True)):
            whole, lone, fixed = neighbourhood(line, sides)
            lone, fixed = np.unique(signed(lone)), signed(fixed)
            keys.append(np.concatenate([[whole], lone, fixed]))
            roles.append(np.concatenate([[0], np.full(len(lone), 1), np.full(len(fixed), 2)]))
            rows.append(np.full(len(keys[-1]), row))
        return {"key": np.concatenate(keys).astype(np.int64), "role": np.concatenate(roles).astype(np.int32), "hash": batch["hash"].take(pa.array(np.concatenate(rows)))}

    return map_batches(lines.select("hash", "sides", "line"), step, "key long, role int, hash long")


def proposed(lines: DataFrame) -> DataFrame:
    """(hash, place, other): for each line and kind of edit the earliest line that shares a key, if earlier."""
    # Distinct lines with a key in common differ in one place at most, so a key's rows are few; they are counted in one shuffle.
    alike = variant_keys(lines).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    places = lines.select("hash", F.struct("doc_id", "rid", "no").alias("place"))
    keyed = stored(alike.select("key", "role", "hash").join(places, "hash"), "line-keys")
    kind = F.when(F.col("role") == 2, F.lit("replaced")).otherwise(F.lit("moved"))
    # Of a key, lines as they are meet variants, and variants with a position meet each other.
    firsts = keyed.groupBy("key", kind.alias("kind")).agg(
        F.min(F.when(F.col("role") == 0, F.struct("place", "hash"))).alias("line"),
        F.min(F.when(F.col("role") == 1, F.struct("place", "hash"))).alias("variant"),
        F.min(F.when(F.col("role") == 2, F.struct("place", "hash"))).alias("fixed"),
        F.count(F.lit(1)).alias("n"),
    ).where("n > 1 and (line is not null and variant is not null or fixed is not null)")
    met = keyed.withColumn("kind", kind).join(firsts, ["key", "kind"])
    other = F.when(F.col("role") == 0, F.col("variant")).when(F.col("role") == 1, F.col("line")).otherwise(F.col("fixed"))
    return met.select("hash", "place", other.alias("other")).where("other is not null and other.place < place").select("hash", "place", F.col("other.hash").alias("other")).distinct()


def neighbours_removed(texts: DataFrame) -> DataFrame:
    """(rid, no) of lines, first of their kind, that have an earlier line within one edit."""
    lines = stored(line_texts(texts), "line-texts")
    named = lines.select("hash", "line")

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one_edit(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    met = proposed(lines).join(named, "hash").join(named.toDF("other", "other_line"), "other")
    return met.where(close("line", "other_line")).select("hash").distinct()


def remove_lines(docs: DataFrame) -> DataFrame:
    """Per row: rid, doc_id, n_lines (not blank), n_removed, kept (the text of the lines that stay; null if all stay), kept_sha256."""
    named, row = with_row_id(docs)
    rows = numbered(named, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rid=row)
    every = stored(lines_of(rows), "lines")
    place = F.struct("doc_id", "rid", "no")
    firsts = every.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    near = stored(near_lines(rows), "line-near")
    copied = every.join(firsts.where("n > 1").select("hash", "first"), "hash")
    repeated = copied.where(~place.eqNullSafe(F.col("first"))).select("rid", "no")
    wanted = firsts.join(near, "hash").select("first.rid", "first.no", "hash", "sides")
    texts = bucketed_texts(rows, repeated, wanted)
    # A line close to an earlier one goes with all its copies: the copies are gone already, the first goes here.
    firsts_gone = texts.where("wanted is not null").select("rid", F.explode("wanted").alias("w")).select("rid", "w.no", "w.hash").join(neighbours_removed(texts), "hash").select("rid", "no")
    more = firsts_gone.groupBy("rid").agg(F.collect_list("no").alias("more"))

    def step(batch: pa.RecordBatch) -> dict:
        removed, kept, sha = [], [], []
        for text, whole, *gone in zip(*(batch[c].to_pylist() for c in ("text", "whole", "gone", "more")), strict=True):
            drop = {i for part in gone for i in part or ()}
            removed.append(len(drop))
            kept.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop) if drop else None)
            sha.append(hashlib.sha256(kept[-1].encode("utf-8", "surrogatepass")).hexdigest() if drop else whole)
        return {"rid": batch["rid"], "doc_id": batch["doc_id"], "n_lines": batch["n_lines"], "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()), "kept_sha256": pa.array(sha, pa.string())}

    joined = texts.select("rid", "doc_id", "n_lines", "whole", "text", "gone").join(more, "rid", "left")
    return map_batches(joined, step, "rid long, doc_id long, n_lines long, n_removed long, kept string, kept_sha256 string")
