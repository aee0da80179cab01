"""Queries of the training-data operators, by name, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontaminate, langid, lm_score, mixing, neighbours, simhash, substring_dedup, suffix_dedup, token_counts, warc
from strata.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.corpus_rollup(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_lm_score, op3_source_mix, op4_decontaminate, op5_suffix_dedup, op6_warc_index, op7_token_rollup, op8_embedding_dedup, op9_substring_dedup, op10_simhash_dedup)}

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op2_lm_score": rf"""
with w as (select doc_id, unnest({_WORDS}) w, generate_subscripts({_WORDS}, 1) i from documents),
b as (select doc_id, i, w, lag(w) over (partition by doc_id order by i) p, lag(w, 2) over (partition by doc_id order by i) pp, lead(w) over (partition by doc_id order by i) x from w),
c1 as (select w, count(*) n, count(x) f from b group by w),
c2 as (select p, w, count(*) n, count(x) f from b where p is not null group by p, w),
c3 as (select pp, p, w, count(*) n from b where pp is not null group by pp, p, w having count(*) >= 2),
s as (select b.doc_id, c3.n is null backed, round(ln(case when c3.n is not null then c3.n / cc.f when c2.n >= 2 then c2.n / cp.f * 0.4::double else c1.n / (select count(*) from w)::double * pow(0.4, 2) end) * 1e6)::bigint v
  from b join c1 using (w) left join c1 cp on cp.w = b.p left join c2 on c2.p = b.p and c2.w = b.w
  left join c2 cc on cc.p = b.pp and cc.w = b.p left join c3 on c3.pp = b.pp and c3.p = b.p and c3.w = b.w),
t as (select doc_id, count(*) n_words, count(*) filter (backed) n_backoff, sum(v)::bigint v from s group by doc_id)
select d.doc_id, coalesce(n_words, 0) n_words, coalesce(n_backoff, 0) n_backoff, coalesce(v, 0) / 1e6 score,
  floor(coalesce(v, 0) / greatest(coalesce(n_words, 0), 1)::double + 0.5) / 1e6 mean_score
from documents d left join t using (doc_id)""",
    "op6_warc_index": """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
h as (select page_id, octet_length(b) n, lower(sha1(b)) h from p),
k as (select *, max(page_id) over (partition by h) keep from h),
c as (select *, list_transform(range(8), lambda i: ('0x' || substr(h, (5 * i + 1)::int, 5))::bigint) v from k)
select page_id, n payload_bytes, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31)::int + 1, 1)), '')), '') payload_digest,
  case when page_id = keep then 'response' else 'revisit' end record_type, case when page_id <> keep then keep end refers_to
from c""",
    "op8_embedding_dedup": """
with recursive e as (select vec_id, list_transform(embedding, lambda x: x::double) v from embeddings),
g as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) n from e where v is not null and len(v) > 0 and not list_contains(list_transform(v, lambda x: coalesce(isfinite(x), false)), false)),
l as (select a.vec_id a, b.vec_id b from g a join g b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.n > 0 and b.n > 0 and list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
r as (select vec_id, vec_id c from e union select l.b, r.c from r join l on l.a = r.vec_id),
m as (select vec_id, min(c) component_id from r group by vec_id)
select m.vec_id, coalesce(k.n, 0)::bigint n_links, component_id, m.vec_id = component_id kept from m left join (select a, count(*) n from l group by a) k on k.a = m.vec_id""",
    "op9_substring_dedup": rf"""
with d as (select doc_id, {_WORDS} a from documents),
w as (select doc_id, unnest(a) w, generate_subscripts(a, 1) i from d),
s as (select doc_id, i, array_to_string(list_slice(a, i, i + 34), ' ') g from (select doc_id, a, unnest(range(1, greatest(len(a) - 33, 1))) i from d where len(a) >= 35)),
r as (select g from s group by g having count(*) > 1),
m as (select doc_id, i from s where g in (select g from r)),
k as (select w.doc_id, w.i, w.w, coalesce(w.i - max(m.i) over (partition by w.doc_id order by w.i) <= 34, false) gone from w left join m on m.doc_id = w.doc_id and m.i = w.i)
select d.doc_id, len(coalesce(d.a, [])) n_words, coalesce(sum(gone::int), 0)::bigint n_removed, sha256(coalesce(string_agg(w, ' ' order by i) filter (not gone), '')) kept_sha256
from d left join k using (doc_id) group by d.doc_id, d.a""",
}
