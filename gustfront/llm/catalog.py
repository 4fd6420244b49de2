"""Named queries of the subpackage and the SQL texts that some of them can be checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustfront.llm import exact_dedup, fill_in_middle, filter_audit, html_extraction, line_dedup, packing, pii, sentencepiece_codec, simhash, substring_dedup, token_rollup, topk, toxicity
from gustfront.llm.common import table
from gustfront.session import scratch_path


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode_checked(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "round_trip")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents")).drop("rid", "base")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.maintain(table(spark, sf_dir, "documents"), scratch_path(spark, "rollup")).totals()


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("rid")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_toxicity": op2_toxicity,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_personal_data": op4_personal_data,
    "op5_token_counts": op5_token_counts,
    "op6_packing": op6_packing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_html_extraction": op12_html_extraction,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op3_exact_top_k": """
        with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
                   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.r, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
              from v q join v c on q.vec_id % 50 = 0 and c.r <> q.r and len(c.e) = len(q.e))
        select query_id, cast(rank as integer) as rank, vec_id, score
        from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s) where rank <= 5
    """,
    "op7_exact_dedup": f"""
        with t as (select doc_id, {_LOWER} as x from documents),
        g as (select x, max(doc_id) as keep_id, count(*) as group_size from t group by x)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(x) as text_sha256 from t join g using (x)
    """,
    "op8_substring_dedup": r"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        p as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) as s from w),
        k as (select doc_id, s, sha256(list_aggregate(list_slice(ws, s, s + 19), 'string_agg', ' ')) as h from p),
        r as (select doc_id, s, row_number() over (partition by h order by doc_id, s) > 1 as again from k),
        c as (select distinct doc_id, unnest(range(s, s + 20)) as i from r where again),
        n as (select doc_id, ws[i] as word, i from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w)),
        j as (select n.doc_id, string_agg(word, ' ' order by n.i) as kept, count(*) as stay from n anti join c on n.doc_id = c.doc_id and n.i = c.i group by n.doc_id)
        select w.doc_id, cast(len(ws) as bigint) as n_words, len(ws) - coalesce(stay, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from w left join j on w.doc_id = j.doc_id
    """,
    "op11_filter_audit": r"""
        with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as x from documents),
        w as (select *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by x) as least from t),
        f as (select doc_id, part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
                     100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 10 * length(x),
                     regexp_matches(x, '[#$%&*|]'), coalesce(doc_id > least, false)] as fails from w),
        l as (select doc_id, coalesce(max(case when quality = 1 then 1 end), 0) as good, coalesce(max(case when toxic = 1 then 1 end), 0) as toxic from labels group by doc_id),
        h as (select part, fails, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from f left join l using (doc_id) group by part, fails),
        c as (select unnest(range(1, 6)) as i),
        o as (select [a.i, b.i, d.i, e.i, g.i] as ord from c a, c b, c d, c e, c g
              where len(list_distinct([a.i, b.i, d.i, e.i, g.i])) = 5),
        s as (select part, ord, cast(step as integer) as step, n, good, toxic, fails[ord[step]] as hit,
                     len(list_filter(list_slice(ord, 1, step - 1), lambda k: fails[k])) > 0 as gone,
                     len(list_filter(fails, lambda k: k)) as many
              from h, o, (select unnest(range(1, 6)) as step)),
        r as (select part, ord, step, coalesce(sum(n) filter (not gone and not hit), 0) as kept, coalesce(sum(n) filter (not gone and hit), 0) as removed,
                     coalesce(sum(n) filter (gone and hit), 0) as redundant, coalesce(sum(n) filter (hit and many = 1), 0) as unique_fails,
                     coalesce(sum(good) filter (not gone and hit), 0) as good_lost, coalesce(sum(toxic) filter (not gone and hit), 0) as toxic_lost
              from s group by part, ord, step)
        select part, list_aggregate(list_transform(ord, lambda k: substr('ABCDE', k, 1)), 'string_agg', '') as filter_order, step,
               cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
               cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
               cast(sum(removed) over (partition by part, ord[step]) as bigint) as shapley from r
    """,
    "op13_fill_in_middle": r"""
        with t as (select doc_id, coalesce(text, '') as x, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
        u as (select doc_id, x, regexp_extract_all(x, '[^\n]*\n|[^\n]+') as ls, list_transform(range(0, 4), lambda k: cast('0x' || substr(h, 8 * k + 1, 8) as bigint)) as d from t),
        k as (select *, len(ls) as n, least(d[1] % (len(ls) + 1), d[2] % (len(ls) + 1)) as lo, greatest(d[1] % (len(ls) + 1), d[2] % (len(ls) + 1)) as hi,
                     case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') then 'plain' when d[4] % 100 < 50 then 'spm' else 'psm' end as form from u),
        c as (select doc_id, x, cast(n as bigint) as n, form, coalesce(array_to_string(ls[1:lo], ''), '') as p,
                     coalesce(array_to_string(ls[lo + 1:hi], ''), '') as m, coalesce(array_to_string(ls[hi + 1:n], ''), '') as s from k)
        select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
               sha256(case form when 'plain' then x when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
               sha256(x) as restored_sha256 from c
    """,
}
