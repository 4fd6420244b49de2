"""Queries of splitting, scoring and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustfront.catalog.registry import query, rnd, sql_rnd, sql_stamp, stamp
from gustfront.operators import evaluation, merkle, sampling

SPLIT = """g as (select date, station, max(label) as positive, md5('42:' || date || '|' || station) as h from {tensor_rows} group by 1, 2),
 k as (select *, row_number() over (partition by positive order by h) - 1 as rank, count(*) over (partition by positive) as total from g),
 s as (select date, station, case when rank < floor(total * 0.15e0) then 'test' when rank < floor(total * 0.15e0) + floor(total * 0.15e0) then 'val' else 'train' end as split from k)"""


@query("w01_leakage_safe_split", f"with {SPLIT} select t.report_id, s.split from {{tensor_rows}} t join s on s.date = t.date and s.station = t.station")
def _(i):
    return evaluation.split_by_group(i.tensor_rows).select("report_id", "split")


@query(
    "a18_split_summary",
    f"""with {SPLIT}, r as (select t.subtype || '_' || cast(t.report_id % 700 as string) as event_id, t.label, s.split from {{tensor_rows}} t join s on s.date = t.date and s.station = t.station)
    select split, count(*) as scans, cast(sum(label) as bigint) as positive_scans, cast(count(*) - sum(label) as bigint) as negative_scans, count(distinct event_id) as events,
      count(distinct case when label = 1 then event_id end) as positive_events, count(distinct event_id) - count(distinct case when label = 1 then event_id end) as negative_events from r group by 1""",
)
def _(i):
    rows = evaluation.split_by_group(i.tensor_rows)
    shared = rows.withColumn("event_id", F.concat("subtype", F.lit("_"), (F.col("report_id") % 700).cast("string")))
    return evaluation.split_summary(shared)


@query(
    "a19_class_weight",
    f"select cast(count_if(quality = 1) as bigint) as positives, cast(count_if(quality <> 1) as bigint) as negatives, {sql_rnd('count_if(quality <> 1) / cast(greatest(1, count_if(quality = 1)) as double)')} as pos_weight from {{labels}}",
)
def _(i):
    return evaluation.class_weight(i.labels, "quality").withColumn("pos_weight", rnd("pos_weight"))


@query(
    "a20_dataset_fingerprint",
    """with d as (select md5(source || '/' || cast(doc_id as string)) as m from {documents}), f as (select count(*) as n, bit_xor(cast('0x' || substring(m, 1, 15) as bigint)) as x1, bit_xor(cast('0x' || substring(m, 16, 15) as bigint)) as x2 from d)
    select n, substring(sha256(cast(n as string) || ':' || cast(x1 as string) || ':' || cast(x2 as string)), 1, 16) as fingerprint from f""",
)
def _(i):
    return evaluation.fingerprint(i.documents.select(F.concat_ws("/", "source", "doc_id").alias("tensor")), "tensor")


@query(
    "a20_merkle_differences",
    """with k as (select source || '/' || cast(doc_id as string) as t, doc_id from {documents}),
    a as (select (cast('0x' || substring(md5(t), 1, 13) as bigint) >> 40) as leaf, count(*) as n from k group by 1),
    gone as (select (cast('0x' || substring(md5(t), 1, 13) as bigint) >> 40) as leaf, count(*) as n from k where doc_id % 90 = 0 group by 1)
    select a.leaf, cast(a.n as bigint) as left_n, cast(a.n - gone.n as bigint) as right_n from a join gone on a.leaf = gone.leaf""",
)
def _(i):
    # the second table is brought up to date after rows have gone
    rows = i.documents.select("doc_id", F.concat_ws("/", "source", "doc_id").alias("tensor"))
    leaves = merkle.merkle_leaves(rows, "tensor")
    gone = F.col("doc_id") % 90 == 0
    return merkle.differing_ranges(leaves, merkle.updated_leaves(leaves, rows.where(~gone), rows.where(gone), "tensor"))


STEPS = """st as (select score, count_if(label = 1) as pos, count_if(label <> 1) as neg from {predictions} group by 1),
 cu as (select *, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp, sum(pos) over () as p, sum(neg) over () as n from st)"""


@query(
    "a25_score_steps",
    f"with {STEPS} select {sql_rnd('score')} as score, cast(pos as bigint) as pos, cast(neg as bigint) as neg, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(p as bigint) as p, cast(n as bigint) as n from cu",
)
def _(i):
    return evaluation.score_steps(i.predictions).withColumn("score", rnd("score"))


@query(
    "a25_a26_ranking_metrics",
    f"""with {STEPS}, pairs as (select sum(case when a.score > b.score then 1e0 when a.score = b.score then 0.5e0 else 0e0 end) / count(*) as auc from {{predictions}} a, {{predictions}} b where a.label = 1 and b.label <> 1)
    select cast(max(p) + max(n) as bigint) as n, {sql_rnd('sum(pos * (tp / (tp + fp))) / max(p)')} as average_precision, (select {sql_rnd('auc')} from pairs) as roc_auc, {sql_rnd('max(p) / (max(p) + max(n))')} as base_rate from cu""",
)
def _(i):
    got = evaluation.ranking_metrics(i.predictions)
    return got.select("n", *[rnd(c).alias(c) for c in ("average_precision", "roc_auc", "base_rate")])


@query(
    "a27_precision_at_recall",
    f"""with {STEPS}, pt as (select score, tp / p as recall, tp / (tp + fp) as precision, 0 as last from cu union all select max(score), 0, 1, 1 from cu),
    r as (select t.target, pt.*, row_number() over (partition by t.target order by abs(recall - target), last, score) as k from pt, (select unnest([0.3e0, 0.5e0, 0.7e0, 0.9e0]) as target) t)
    select target, {sql_rnd('recall')} as recall, {sql_rnd('precision')} as precision, {sql_rnd('score')} as threshold from r where k = 1""",
)
def _(i):
    got = evaluation.precision_at_recall(i.predictions)
    return got.select("target", *[rnd(c).alias(c) for c in ("recall", "precision", "threshold")])


def _ap(column: str) -> str:
    return f"""(with c as (select {column} as s, count_if(label = 1) as pos, count_if(label <> 1) as neg from {{predictions}} group by 1),
      u as (select pos, sum(pos) over (order by s desc) as tp, sum(neg) over (order by s desc) as fp, sum(pos) over () as p from c) select {sql_rnd('sum(pos * (tp / cast(tp + fp as double))) / max(p)')} from u)"""


@query(
    "a25_evaluation_report",
    f"""select 'ranking' as section, m.name, 'average_precision' as measure, m.v as value from (select 'model' as name, {_ap('score')} as v union all select 'flipped', {_ap('1e0 - score')}
      union all select 'majority', (select {sql_rnd('avg(cast(label as double))')} from {{predictions}})) m
    union all select 'false_positives', subtype, 'rate', {sql_rnd('count_if(score >= 0.5) / cast(count(*) as double)')} from {{predictions}} where label = 0 group by subtype
    union all select 'false_positives', subtype, 'negatives', cast(count(*) as double) from {{predictions}} where label = 0 group by subtype""",
)
def _(i):
    scored = i.predictions.withColumn("flipped", F.lit(1.0) - F.col("score"))
    report = evaluation.evaluation_report(scored, {"model": "score", "flipped": "flipped"})
    shown = (F.col("measure") == "average_precision") | F.col("measure").isin("rate", "negatives")
    return report.where(shown).withColumn("value", rnd("value"))


@query(
    "a28_false_positives_by_subtype",
    f"select subtype, cast(count_if(score >= 0.5) as bigint) as false_positives, count(*) as negatives, {sql_rnd('count_if(score >= 0.5) / cast(count(*) as double)')} as rate from {{predictions}} where label = 0 group by 1",
)
def _(i):
    return evaluation.false_positives(i.predictions).withColumn("rate", rnd("rate"))


@query("a29_base_rate", f"select count(*) as n, {sql_rnd('avg(label)')} as base_rate from {{predictions}}")
def _(i):
    return evaluation.base_rate(i.predictions).withColumn("base_rate", rnd("base_rate"))


FEATURES = """ft as (select vec_id, avg(v) filter (where pos < 32) as m, max(v) filter (where pos >= 32) - min(v) filter (where pos >= 32) as s from {exploded} group by 1)"""


@query("a30_baseline_features", f"with {FEATURES} select vec_id, {sql_rnd('m')} as refl_mean, {sql_rnd('s')} as vel_range from ft")
def _(i):
    got = evaluation.baseline_features(i.embeddings.withColumnRenamed("embedding", "tensor"))
    return got.select("vec_id", rnd("refl_mean").alias("refl_mean"), rnd("vel_range").alias("vel_range"))


@query(
    "f03_h26_score_scans",
    f"with {FEATURES} select vec_id, round_even(1e4 / (1 + exp(-(m * 8e0 + s * 2.5e0 - 1.25e0))), 0) / 1e4 as score from ft",
)
def _(i):
    features = evaluation.baseline_features(i.embeddings.withColumnRenamed("embedding", "tensor"))
    return evaluation.score_scans(features, {"refl_mean": 8.0, "vel_range": 2.5}, -1.25).select("vec_id", "score")


@query(
    "s15_tensor_scan",
    f"select vec_id, label, len(embedding) as size, {sql_rnd('list_min(embedding)')} as low, {sql_rnd('list_max(embedding)')} as high from {{embeddings}}",
)
def _(i):
    from gustfront.sources.frames import read_tensors

    t = read_tensors(i.spark, f"{i.folder}/embeddings.parquet")
    low, high = F.array_min("embedding").cast("double"), F.array_max("embedding").cast("double")
    return t.select("vec_id", "label", F.size("embedding").alias("size"), rnd(low).alias("low"), rnd(high).alias("high"))


STRIDE = """r as (select *, row_number() over (order by event_ts, report_id) - 1 as k, count(*) over () as n from {storm_events} where subtype = '%s'),
 c as (select *, greatest(1, n // %d) as step from r)"""


@query("l01_stride_sample", f"with {STRIDE % ('hail', 100)} select report_id, subtype from c where k % step = 0 and k < step * 100")
def _(i):
    got = sampling.stride_cap(i.storm_events.where("subtype = 'hail'"), 100, ["event_ts", "report_id"], "report_id")
    return got.select("report_id", "subtype")


def _capped(name: str, cap: int) -> str:
    return f"select report_id, subtype from (with {STRIDE % (name, cap)} select * from c) t where k % step = 0 and k < step * {cap}"


@query("u01_positives_and_capped_negatives", f"select * from ({_capped('tornado', 250)}) union all select * from ({_capped('hail', 100)}) union all select * from ({_capped('wind', 100)})")
def _(i):
    kind = lambda s: i.storm_events.where(F.col("subtype") == s)
    got = sampling.positives_and_negatives(kind("tornado"), {"hail": kind("hail"), "wind": kind("wind")}, 250, 100, ["event_ts", "report_id"], "report_id")
    return got.select("report_id", "subtype")


@query("l05_seeded_sample", "select scan_id, station from {scans} order by md5('42:' || cast(scan_id as string)), scan_id limit 5")
def _(i):
    return sampling.seeded_sample(i.scans, 5, 42, "scan_id").select("scan_id", "station")


@query(
    "l02_latest_file",
    f"select folder, filename, {sql_stamp('done_ts')} as done_ts from (select file_id % 20 as folder, filename, done_ts, row_number() over (partition by file_id % 20 order by done_ts desc, filename desc) as n from {{conversions}}) t where n = 1",
)
def _(i):
    files = i.conversions.withColumn("folder", F.col("file_id") % 20)
    return sampling.latest_file(files, ["folder"], "filename", "done_ts").withColumn("done_ts", stamp("done_ts"))


@query("l06_oldest_first_queue", "select file_id, row_number() over (order by done_ts, filename) as place from {conversions}")
def _(i):
    return sampling.oldest_first(i.conversions, "done_ts", "filename").select("file_id", "place")


@query("l06_newest_first_log", "select file_id, row_number() over (order by done_ts desc, file_id desc) as place from {conversions}")
def _(i):
    return sampling.newest_first(i.conversions, "done_ts", "file_id").select("file_id", "place")
