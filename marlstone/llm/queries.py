"""The registered queries of this subpackage, with DuckDB SQL where SQL can state their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common, decontaminate, language_model, near_duplicates, packing, quality, secrets, substring_dedup, token_counts, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica with known damage."""
    records = warc.render(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    work = common.Workspace(spark, "warc")
    return warc.audit(work.save(warc.digests(records), "primary"), work.save(warc.digests(warc.damaged(records)), "replica"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("failed_rules")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.rule_table(spark))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.cross_entropy_difference(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_token_counts, op2_suffix_array_dedup, op3_warc_fixity, op4_secret_scans, op5_best_fit_packing, op6_quality_rules, op7_url_filters,
    op8_minhash_near_dedup, op9_benchmark_decontamination, op10_lm_scoring)}

_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

ORACLES: dict[str, str] = {
    "op6_quality_rules": f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\x0C\\r]+') as w from documents),
l as (select r, unnest(string_split(text, chr(10))) as line from d),
ls as (select r, line, translate(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') as bare from l),
lc as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup,
         count(*) filter (regexp_matches(line, '^ *[-*•]')) as n_bullet,
         count(*) filter (regexp_matches(line, '(\\.\\.\\.|…) *$')) as n_dots
       from ls where bare != '' group by r),
g as (select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select r, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
rep as (select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from g) where n >= 2),
cov as (select r, count(distinct i + k) as n from rep, (values (0), (1), (2)) as t(k) group by r),
m as (select doc_id, len(w) as n_words,
        length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as word_chars,
        length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
        coalesce(n_dup, 0) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words,
        len(list_filter(w, lambda x: lower(x) in ({_STOPS}))) as n_stops,
        coalesce(n_lines, 0) as n_lines, coalesce(n_bullet, 0) as n_bullet, coalesce(n_dots, 0) as n_dots
      from d left join lc using (r) left join cov using (r)),
j as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and n_words <= 100000 and word_chars / n_words between 2 and 20 and n_symbols / n_words <= 0.1
    and n_stops / n_words >= 0.02 and n_dup_lines / n_lines <= 0.5 and n_bullet / n_lines <= 0.9 and n_dots / n_lines <= 0.5 as kept
from j""",
    "op8_minhash_near_dedup": """
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\x0C\\r]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:least(i + 4, len(w))], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id != b.doc_id group by 1, 2),
e as (select p.a, p.b from p join n x on p.a = x.doc_id join n y on p.b = y.doc_id where 100 * p.c >= 85 * (x.n + y.n - p.c)),
r(doc_id, reach) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on r.reach = e.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.c as component_id, d.doc_id = m.c as kept
from documents d left join n on d.doc_id = n.doc_id join (select doc_id, min(reach) as c from r group by doc_id) m on d.doc_id = m.doc_id""",
    "op3_warc_fixity": """
with r as (select page_id, coalesce(page_id // 1024, 0) as volume, coalesce(html, '') as html, coalesce(url, '') as url from pages),
w as (select page_id, volume, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
        || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
        || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) as record from r),
o as (select *, coalesce(sum(strlen(record)) over (partition by volume order by page_id rows between unbounded preceding and 1 preceding), 0)::bigint as "offset", encode(record) as raw, hex(encode(record)) as h from w),
d as (select *, strlen(record) // 2 as half, case when page_id % 97 = 13 then 'flip' when page_id % 211 = 7 then 'cut' when page_id % 307 = 11 then 'lost' end as damage from o)
select page_id, volume, "offset", strlen(record)::bigint as length, case damage when 'lost' then 'missing' else 'corrupt' end as status, sha256(raw) as sha256,
  case damage when 'flip' then sha256(unhex(substr(h, 1, 2 * half) || '00' || substr(h, 2 * half + 3))) when 'cut' then sha256(unhex(substr(h, 1, 2 * half))) end as replica_sha256
from d where damage is not null""",
    "op7_url_filters": """
with r as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path from r),
rules(rule, host, path, verdict) as (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
        ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow'))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from (
  select p.page_id, p.host, p.path, r.rule, r.verdict,
    row_number() over (partition by p.page_id order by length(r.rule) desc nulls last, length(r.host) desc, r.verdict desc) as k
  from p left join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)) where k = 1""",
}
