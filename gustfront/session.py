"""Session helpers: builder defaults, scratch storage and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "gustfront", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew handling on; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """All operators compare instants in UTC; make the session agree."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where none is set, a local master (tests) gets a temporary one; a cluster is refused, since its
    executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY) or context.getCheckpointDir()
    if not named:
        if not context.master.split("[")[0] == "local":
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one written intermediate table."""
    return f"{shared_folder(spark)}/gustfront/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a table to shared storage and reading it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Inputs up to this size may be read as a single split; the bound does not depend on the cluster.
ONE_SPLIT = 32 * 1024 * 1024


def deal_out(df: DataFrame) -> DataFrame:
    """Deal an input of at most ``ONE_SPLIT`` bytes out to the cores before costly per-row work.

    Larger inputs are left as they are read, whatever the number of cores.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= ONE_SPLIT else df


#: Bytes of a large input, by the engine's estimate of its files, that one task of a join takes.
JOIN_SPLIT = 4 * 1024 * 1024


def parts_of(*inputs: DataFrame) -> int | None:
    """A number of parts that grows with the largest input; none up to ``ONE_SPLIT`` bytes, which are left to the engine.

    Adaptive coalescing merges well compressed parts up to its advised size, so the rows that a task sorts would grow with the
    input; a given number of parts stays.
    """
    size = max(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in inputs)
    return -(-size // JOIN_SPLIT) if size > ONE_SPLIT else None


def dealt(df: DataFrame, key: str, parts: int | None) -> DataFrame:
    """Rows brought together by ``key``, in ``parts`` parts or as many as the engine takes."""
    return df.repartition(parts, key) if parts else df.repartition(key)


def dealt_alike(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``key``, in a number of parts that grows with the larger one; small ones are left as they are."""
    parts = parts_of(left, right)
    return (left.repartition(parts, key), right.repartition(parts, key)) if parts else (left, right)
