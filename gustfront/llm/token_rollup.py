"""Token counts: delta-maintained rollups by source, language and tokenizer version.

The store is a folder of committed batches. A batch is a table of signed changes: an insert adds a document and its tokens, a
delete takes them away, a revision takes the old count away and adds the new one. Each batch is reduced to its groups before it
is written, so the store grows with batches and groups, never with documents, and totals are one sum over it. A batch is
written to a folder of its own under its batch id and counts once its commit marker is there; a batch id that is committed is never
applied again, and an attempt that died before its commit leaves nothing that a reader sees.

Defined cases: a null source or language is a group of its own; null counts are zero tokens; null and empty texts have no tokens;
a batch without rows commits and changes nothing; groups whose documents and tokens are all taken away are not reported; repeated change rows
count each; an empty store has no totals.
"""

from __future__ import annotations

import uuid

import pandas as pd
import public_tokenizers
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustfront.llm.common import stored
from gustfront.llm.packing import encoder

GROUP = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


class RollupStore:
    """Additive totals kept as committed delta batches below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self.path(f"{self.folder}/{folder}")
        return sorted(s.getPath().getName() for s in self.files.listStatus(where)) if self.files.exists(where) else []

    def committed(self) -> dict[str, str]:
        """Batch id to the folder of its data. Markers are named ``batch id=attempt``; of attempts that raced, one counts."""
        return dict(x.rsplit("=", 1) for x in reversed(self._names("commits")))

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit ``changes`` (source, lang, tokenizer, documents and tokens, both signed) once; False if it was committed before."""
        if "=" in batch_id or "/" in batch_id or not batch_id:
            raise ValueError(f"bad batch id {batch_id!r}")
        if batch_id in self.committed():
            return False
        attempt = uuid.uuid4().hex
        sums = changes.groupBy(*GROUP).agg(F.sum(F.coalesce("documents", F.lit(0))).cast("long").alias("documents"), F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))
        sums.write.parquet(f"{self.folder}/data/{attempt}")
        self.files.createNewFile(self.path(f"{self.folder}/commits/{batch_id}={attempt}"))
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens over all committed batches."""
        folders = sorted(set(self.committed().values()))
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        every = self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/data/{x}" for x in folders])
        return every.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(1).alias("documents"), F.col("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(-1).alias("documents"), (-F.col("tokens")).alias("tokens"))


def revisions(counts: DataFrame, new: Column) -> DataFrame:
    """Changes that replace ``tokens`` by ``new``."""
    return counts.select(*GROUP, F.lit(0).alias("documents"), (new - F.coalesce("tokens", F.lit(0))).alias("tokens"))


#: Tokenizer versions that the rollup is kept for, in the order in which they came.
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")


def counted(docs: DataFrame, versions: tuple[str, ...] = VERSIONS) -> DataFrame:
    """Per document and version: doc_id, source, lang, tokenizer, tokens, tokens of the text without outer white space, text key (128 bits)."""
    paths = {v: public_tokenizers.path(f"{v}.tiktoken") for v in versions}

    @F.pandas_udf("counts array<struct<tokenizer:string,tokens:bigint,trimmed:bigint>>, key string")
    def count(texts: pd.Series) -> pd.DataFrame:
        encoders, rows = {v: encoder(p) for v, p in paths.items()}, []
        for text in texts:
            text = text or ""
            inner = text.strip()
            whole = [(v, len(encode(text)) // 2, encode) for v, encode in encoders.items()]
            rows.append(([{"tokenizer": v, "tokens": n, "trimmed": n if text == inner else len(encode(inner)) // 2} for v, n, encode in whole], xxhash.xxh3_128_hexdigest(text.encode())))
        return pd.DataFrame(rows, columns=["counts", "key"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), count(F.col("text").cast("string")).alias("c"))
    return found.select("doc_id", "source", "lang", "c.key", F.explode("c.counts").alias("v")).select("doc_id", "source", "lang", "v.tokenizer", "v.tokens", "v.trimmed", "key")


def maintain(docs: DataFrame, folder: str, versions: tuple[str, ...] = VERSIONS) -> RollupStore:
    """A life of the rollup over ``docs``, for one tokenizer version after the other: all documents come in, all but the largest id of
    equal texts are retracted, what stays is recounted without outer white space; a retraction arrives twice and counts once.

    Of rows that repeat the largest id and its text all stay.
    """
    counts = stored(counted(docs, versions), "token-counts")
    last = counts.groupBy("key").agg(F.max("doc_id").alias("last"))
    placed = stored(counts.join(last, "key").select("doc_id", *GROUP, "tokens", "trimmed", F.col("doc_id").eqNullSafe(F.col("last")).alias("stays")), "token-copies")
    store = RollupStore(docs.sparkSession, folder)
    for version in versions:
        own = F.col("tokenizer") == version
        copies = placed.where(own & ~F.col("stays"))
        store.apply(f"load-{version}", inserts(counts.where(own)))
        store.apply(f"retract-copies-{version}", deletes(copies))
        store.apply(f"recount-trimmed-{version}", revisions(placed.where(own & F.col("stays") & (F.col("tokens") != F.col("trimmed"))), F.col("trimmed")))
        store.apply(f"retract-copies-{version}", deletes(copies))
    return store
