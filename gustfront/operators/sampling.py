"""Stride samples, top rows, seeded samples, unions and colour-set algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustfront.operators.timeline import global_rank


def stride_cap(df: DataFrame, cap: int | None, order: list[str], key: str) -> DataFrame:
    """Every (n div cap)-th row of an ordered list, at most ``cap``; 0 or None keeps all.

    ``key`` breaks ties of the order. Whole rows are ranked, so rows that share a key keep places of their own.
    """
    if not cap:
        return df
    ranked = global_rank(df, list(dict.fromkeys([*order, key])))
    step = ranked.select(F.greatest(F.lit(1), F.floor(F.count("*") / cap)).cast("long").alias("step")).scalar()
    chosen = ranked.withColumn("_step", step).where((F.col("rank") % F.col("_step") == 0) & (F.col("rank") < F.col("_step") * cap))
    return chosen.select(*df.columns)


def positives_and_negatives(positives: DataFrame, negatives: dict[str, DataFrame], cap_pos: int | None, cap_neg: int | None, order: list[str], key: str) -> DataFrame:
    """Capped positives followed by each capped negative source."""
    out = stride_cap(positives, cap_pos, order, key)
    for source in negatives.values():
        out = out.unionByName(stride_cap(source, cap_neg, order, key))
    return out


def seeded_order(key: Column, seed: int) -> Column:
    """Reproducible pseudo-random order: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows chosen by seeded hash order (a top-n, not a full sort)."""
    return df.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def latest_file(files: DataFrame, by: list[str], name: str, modified: str) -> DataFrame:
    """Most recently modified file per folder; equal times go to the larger name."""
    return files.groupBy(*by).agg(F.max(F.struct(modified, name)).alias("f")).select(*by, f"f.{name}", f"f.{modified}")


def oldest_first(files: DataFrame, modified: str, name: str) -> DataFrame:
    """The whole queue with each file's ``place`` from 1."""
    return global_rank(files, [modified, name], "place").withColumn("place", F.col("place") + 1)


def newest_first(rows: DataFrame, at: str, tie: str) -> DataFrame:
    """The whole log with each row's ``place`` from 1, newest first."""
    return global_rank(rows, [F.desc(at), F.desc(tie)], "place").withColumn("place", F.col("place") + 1)


def colour_overlap(frame: DataFrame, scale: DataFrame) -> DataFrame:
    """Distinct colours tagged as matching, frame_only or scale_only."""
    tag = lambda df, name: df.select("r", "g", "b").withColumn("side", F.lit(name))
    sides = tag(frame, 1).unionByName(tag(scale, 2)).groupBy("r", "g", "b").agg(F.bit_or("side").alias("side"))
    return sides.select("r", "g", "b", F.when(F.col("side") == 3, "matching").when(F.col("side") == 1, "frame_only").otherwise("scale_only").alias("found"))


def scale_match(original: DataFrame, extracted: DataFrame) -> DataFrame:
    """Share of the original scale's colours found in the extracted one, with a low-match flag."""
    found = colour_overlap(original, extracted).agg(
        F.count_if(F.col("found") != "scale_only").alias("original_colours"),
        F.count_if(F.col("found") != "frame_only").alias("extracted_colours"),
        F.count_if(F.col("found") == "matching").alias("matching"),
    )
    rate = F.col("matching") * 100.0 / F.nullif(F.col("original_colours"), F.lit(0))
    return found.withColumn("match_rate", rate).withColumn("low_match", rate < 50)
