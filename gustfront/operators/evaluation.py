"""Splits, class balance, fingerprints, ranking metrics and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustfront.functions.numbers import logistic_score
from gustfront.operators.sampling import seeded_order
from gustfront.operators.timeline import ranged


def split_by_group(
    rows: DataFrame, val_frac: float = 0.15, test_frac: float = 0.15, seed: int = 42, keys: tuple[str, ...] = ("date", "station"), label: str = "label"
) -> DataFrame:
    """Add ``split`` so that no (date, station) group spans two splits.

    Groups are stratified by holding any positive scan and ranked by a seeded hash. Ranks come from
    256 even hash buckets plus bucket offsets, so no stratum is sorted in one task.
    """
    groups = rows.groupBy(*keys).agg(F.max(label).alias("positive"))
    hashed = groups.withColumn("h", seeded_order(F.concat_ws("|", *keys), seed)).withColumn("bucket", F.substring("h", 1, 2))
    sizes = hashed.groupBy("positive", "bucket").agg(F.count("*").alias("n"))
    stratum = Window.partitionBy("positive")
    offsets = sizes.select(
        "positive", "bucket", F.sum("n").over(stratum).alias("total"),
        F.coalesce(F.sum("n").over(stratum.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
    )
    place = F.row_number().over(Window.partitionBy("positive", "bucket").orderBy("h", *keys)) - 1
    ranked = hashed.withColumn("place", place).join(offsets, ["positive", "bucket"]).withColumn("rank", F.col("place") + F.col("offset"))
    tests, vals = F.floor(F.col("total") * test_frac), F.floor(F.col("total") * val_frac)
    split = F.when(F.col("rank") < tests, "test").when(F.col("rank") < tests + vals, "val").otherwise("train")
    chosen = ranked.select(*[F.col(k).alias(f"_{k}") for k in keys], split.alias("split"))
    meets = F.lit(True)
    for k in keys:  # rows without a date or station form groups of their own
        meets = meets & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(chosen, meets).drop(*[f"_{k}" for k in keys])


def split_summary(split_rows: DataFrame, label: str = "label") -> DataFrame:
    """Scans and independent events per split, by class; an event is positive if any of its scans is."""
    per_event = split_rows.groupBy("split", "event_id").agg(F.count("*").alias("n"), F.sum(label).alias("pos"), F.max(label).alias("any"))
    return per_event.groupBy("split").agg(
        F.sum("n").alias("scans"), F.sum("pos").alias("positive_scans"), (F.sum("n") - F.sum("pos")).alias("negative_scans"),
        F.count("*").alias("events"), F.sum("any").alias("positive_events"), (F.count("*") - F.sum("any")).alias("negative_events"),
    )


def class_weight(rows: DataFrame, label: str = "label") -> DataFrame:
    """Weight of the positive class: negatives over positives, at least one positive assumed."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) != 1)
    return rows.agg(pos.alias("positives"), neg.alias("negatives"), (neg / F.greatest(F.lit(1), pos)).alias("pos_weight"))


def fingerprint(rows: DataFrame, key: str) -> DataFrame:
    """Order-free content fingerprint: count and xor of two 60-bit md5 parts, hashed to 16 hex digits.

    Mergeable, so it runs as one ordinary aggregate at any size.
    """
    digest = F.md5(F.col(key).cast("string"))
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    facts = rows.agg(F.count("*").alias("n"), F.bit_xor(part(1)).alias("x1"), F.bit_xor(part(16)).alias("x2"))
    return facts.select("n", F.substring(F.sha2(F.concat_ws(":", "n", "x1", "x2"), 256), 1, 16).alias("fingerprint"))


def score_steps(predictions: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row per distinct score with counts at or above it: (score, pos, neg, tp, fp, p, n).

    Ties collapse first. Distinct scores are range-partitioned, so raw rare-event scores spread as evenly as any;
    running counts are a window inside each range plus the sums of the ranges above.
    """
    counts = predictions.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    parts = ranged(counts, F.desc("score"), name="scores")
    sums = parts.groupBy("_part").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above, everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # one row per range
    carried = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    opening = sums.select("_part", carried("_p").alias("op"), carried("_n").alias("on"), F.sum("_p").over(everything).alias("p"), F.sum("_n").over(everything).alias("n"))
    inside = Window.partitionBy("_part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select("_part", "score", "pos", "neg", F.sum("pos").over(inside).alias("ip"), F.sum("neg").over(inside).alias("in"))
    return local.join(opening, "_part").select(
        "score", "pos", "neg", (F.col("ip") + F.col("op")).alias("tp"), (F.col("in") + F.col("on")).alias("fp"), "p", "n"
    )


def ranking_metrics(predictions: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Average precision (step sum), ROC-AUC (half credit for ties), base rate; NaN with one class."""
    steps = score_steps(predictions, label, score)
    both = (F.max("p") > 0) & (F.max("n") > 0)
    precision = F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")
    ap = F.sum(F.col("pos") * precision) / F.nullif(F.max("p"), F.lit(0))
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0))
    auc = wins / F.nullif(F.max("p").cast("double") * F.max("n"), F.lit(0.0))
    nan = F.lit(float("nan"))
    return steps.agg(
        (F.max("p") + F.max("n")).alias("n"), F.when(both, ap).otherwise(nan).alias("average_precision"), F.when(both, auc).otherwise(nan).alias("roc_auc"),
        (F.max("p") / (F.max("p") + F.max("n"))).alias("base_rate"),
    )


def precision_at_recall(predictions: DataFrame, targets=(0.3, 0.5, 0.7, 0.9), label: str = "label", score: str = "score") -> DataFrame:
    """Precision and threshold at the recall nearest each target; ties take the lowest threshold.

    The curve ends in (recall 0, precision 1), whose threshold is reported as the highest score.
    """
    steps = score_steps(predictions, label, score)
    points = steps.select(
        "score", (F.col("tp") / F.nullif(F.col("p"), F.lit(0))).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.lit(0).alias("last")
    )
    end = steps.agg(F.max("score").alias("score")).select("score", F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), F.lit(1).alias("last"))
    spread = points.unionByName(end).withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    key = F.struct(F.abs(F.col("recall") - F.col("target")), "last", "score")
    best = spread.groupBy("target").agg(F.min_by(F.struct("recall", "precision", F.col("score").alias("threshold")), key).alias("b"))
    return best.select("target", "b.recall", "b.precision", "b.threshold")


def false_positives(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """False positives of each negative subtype at ``score >= threshold``."""
    negatives = predictions.where(F.col("label") == 0)
    return negatives.groupBy("subtype").agg(
        F.count_if(F.col("score") >= threshold).alias("false_positives"), F.count("*").alias("negatives"),
        (F.count_if(F.col("score") >= threshold) / F.greatest(F.lit(1), F.count("*"))).alias("rate"),
    )


def evaluation_report(predictions: DataFrame, models: dict[str, str], label: str = "label", threshold: float = 0.5, targets=(0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """Rows (section, name, measure, value) of the whole evaluation.

    ``models`` names score columns; the first is the model, the others its baselines. Ranking metrics come for each and
    for the majority answer; precision at recall, thresholds and false positives per subtype for the model.
    """

    def rows(df: DataFrame, section: str, name, measures: dict) -> DataFrame:
        each = F.array(*[F.struct(F.lit(m).alias("measure"), v.cast("double").alias("value")) for m, v in measures.items()])
        return df.select(F.lit(section).alias("section"), name.alias("name"), F.explode(each).alias("v")).select("section", "name", "v.*")

    first = next(iter(models.values()))
    parts = []
    for name, column in models.items():
        got = ranking_metrics(predictions, label, column)
        parts.append(rows(got, "ranking", F.lit(name), {m: F.col(m) for m in ("n", "base_rate", "average_precision", "roc_auc")}))
    always = base_rate(predictions, label)
    parts.append(rows(always, "ranking", F.lit("majority"), {"average_precision": F.col("base_rate"), "roc_auc": F.lit(0.5)}))
    at = precision_at_recall(predictions, targets, label, first)
    parts.append(rows(at, "recall", F.col("target").cast("string"), {"precision": F.col("precision"), "recall": F.col("recall"), "threshold": F.col("threshold")}))
    wrong = false_positives(predictions.withColumn("label", F.col(label)).withColumn("score", F.col(first)), threshold)
    parts.append(rows(wrong, "false_positives", F.col("subtype"), {m: F.col(m) for m in ("false_positives", "negatives", "rate")}))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def base_rate(predictions: DataFrame, label: str = "label") -> DataFrame:
    """Share of positives: the average precision of always answering yes."""
    return predictions.agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("base_rate"))


def baseline_features(tensors: DataFrame, column: str = "tensor", size: int | Column | None = None) -> DataFrame:
    """Mean of the first channel and range of the second from a two-channel array."""
    half = F.floor(F.size(column) / 2).cast("int") if size is None else (F.lit(size) if isinstance(size, int) else size)
    first, second = F.slice(column, F.lit(1), half), F.slice(column, half + 1, half)
    mean = F.aggregate(first, F.lit(0.0), lambda acc, x: acc + x.cast("double")) / half
    return tensors.select(
        "*", mean.alias("refl_mean"), (F.array_max(second).cast("double") - F.array_min(second).cast("double")).alias("vel_range")
    )


def score_scans(features: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """Logistic score of named feature columns, four decimals."""
    logit = F.lit(float(bias))
    for name, weight in weights.items():
        logit = logit + F.col(name) * F.lit(float(weight))
    return features.withColumn("score", logistic_score(logit))
