"""Packing documents into fixed-length sequences along a space-filling curve.

1. Texts become token ids (byte-level BPE, special strings as the vocabulary defines them) followed by one end id. A
   document's vector is the bag of its ids, projected by fixed pseudo-random weights to a few dimensions; each dimension is
   scaled to even ranks and cut into cells, and the cells' place on a Hilbert curve is the document's key.
2. Ids and keys are written once. Only (row, key, length) is range-sorted by key; running sums inside each range and the
   sums of the ranges before give every document its place in one stream of ids.
3. The stream is cut every ``length`` ids. A document therefore follows its neighbours on the curve and is cut only at
   sequence ends; nothing but the last sequence has padding. Ids are joined to their places by row and cut where they lie.

Defined cases: null and empty texts are the end id alone; equal keys are ordered by row; repeated rows are packed once each;
long documents span many sequences; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustfront.llm.common import U64, Recent, kept_in_worker, map_batches, mixed, numbered, stored

LENGTH, END, DIMENSIONS, CELL_BITS = 1024, 0, 3, 10
#: The special string of the byte-level vocabulary and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
VOCABULARY = 50257
#: Words of one generation of the cache; it holds two.
CACHED_WORDS = 200_000

# Letters and numbers of Latin-1; texts with other characters take the slower general splitter.
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_SPACE = r" \t\n\r\x0b\x0c\x85\xa0"
_PLAIN = re.compile("[\x00-\xff]*")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def encoder(path: str) -> Callable[[str], bytes]:
    """Text to token ids as little-endian unsigned 16-bit numbers."""
    return kept_in_worker(f"byte encoder {path}", path, lambda: _encoder(path))


def _encoder(path: str) -> Callable[[str], bytes]:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    bpe = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = Recent(lambda word: struct.pack(f"<{len(found := bpe.encode_ordinary(word))}H", *found), CACHED_WORDS)
    special = np.array([SPECIAL_ID], dtype="<u2").tobytes()

    def plain(text: str) -> bytes:
        if _PLAIN.fullmatch(text):
            return b"".join([words[w] for w in _SPLIT.findall(text)])
        return np.array(bpe.encode_ordinary(text), dtype="<u2").tobytes()

    return lambda text: special.join(map(plain, text.split(SPECIAL))) if SPECIAL in text else plain(text)


@lru_cache(2)
def _weights(dimensions: int) -> np.ndarray:
    noise = mixed(np.arange(1, VOCABULARY * dimensions + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return ((noise >> U64(40)).astype(np.float32) / np.float32(1 << 23) - 1).reshape(VOCABULARY, dimensions)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of every row of ``cells`` (rows x dimensions, ``bits`` bits each)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(documents: list[np.ndarray], dimensions: int = DIMENSIONS, bits: int = CELL_BITS) -> np.ndarray:
    sizes = np.array([len(d) for d in documents])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    sums = np.add.reduceat(_weights(dimensions)[np.concatenate(documents)], starts, axis=0) if len(documents) else np.zeros((0, dimensions))
    scaled = sums / np.sqrt(sizes[:, None] / 3.0)  # about normal, as the weights are even over -1 to 1
    even = 1 / (1 + np.exp(-1.702 * np.clip(scaled / 4, -8, 8)))  # close to the normal distribution's ranks
    return hilbert(np.minimum((even * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def tokenized(rows: DataFrame, path: str) -> DataFrame:
    """rid, doc_id, key, n, ids (compressed)."""

    def step(batch: pa.RecordBatch) -> dict:
        encode, pack = encoder(path), zstandard.ZstdCompressor(level=1)
        end = np.array([END], dtype="<u2").tobytes()
        ids = [encode(t or "") + end for t in batch["text"].to_pylist()]
        arrays = [np.frombuffer(x, dtype="<u2") for x in ids]
        return {"rid": batch["rid"], "doc_id": batch["doc_id"], "key": curve_keys(arrays), "n": pa.array([len(a) for a in arrays], pa.int64()), "ids": pa.array([pack.compress(x) for x in ids], pa.binary())}

    return map_batches(rows, step, "rid long, doc_id long, key long, n long, ids binary")


def placed(light: DataFrame) -> DataFrame:
    """(rid, begin): every document's place in the stream of all ids, in the order of (key, rid)."""
    parts = int(light.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(light.select("rid", "key", "n").repartitionByRange(parts, "key", "rid").withColumn("part", F.spark_partition_id()), "curve")
    sums = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one per range
    before, table = 0, []
    for part in sorted(sums):
        table.append((part, before))
        before += sums[part]
    offsets = light.sparkSession.createDataFrame(table, "part int, before long")
    order = Window.partitionBy("part").orderBy("key", "rid").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("inside", F.coalesce(F.sum("n").over(order), F.lit(0))).join(F.broadcast(offsets), "part").select("rid", (F.col("before") + F.col("inside")).alias("begin"))


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32 bits)."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = stored(tokenized(rows, path), "tokens")

    def step(batch: pa.RecordBatch) -> dict:
        unpack = zstandard.ZstdDecompressor()
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
        for doc_id, n, begin, packed in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "begin", "ids")), strict=True):
            ids = np.frombuffer(unpack.decompress(packed), dtype="<u2").astype("<u4")
            at = 0
            while at < n:
                sequence, offset = divmod(begin + at, length)
                size = min(n - at, length - offset)
                for name, value in (("doc_id", doc_id), ("start", at), ("length", size), ("doc_tokens", n), ("sequence_id", sequence), ("offset", offset), ("ids", ids[at : at + size].tobytes())):
                    out[name].append(value)
                at += size
        return {k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()}

    joined = held.select("rid", "doc_id", "n", "ids").join(placed(held), "rid").select("doc_id", "n", "begin", "ids")
    return map_batches(joined, step, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
