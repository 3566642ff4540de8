"""Summaries, divergences, gates and paired comparisons (grouped aggregates)."""

from marlstone.functions.dialect import sql_query


@sql_query("run_stats")
def run_stats(d):
    """Mean, sample deviation (0 for one run), median, min, max and the runs' count, to 1e-6."""
    return """
select event_type as metric, user_id % 10 as system, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0), 6) as sd,
  round(median(value), 6) as median, round(min(value), 6) as lo, round(max(value), 6) as hi, count(*) as runs from events where value is not null group by event_type, user_id % 10"""


@sql_query("quantile_linear_int")
def quantile_linear_int(d):
    """Linear interpolation, cut to a whole number."""
    f = (lambda p: f"percentile(l_quantity * 10, {p})") if d.spark else (lambda p: f"quantile_cont(l_quantity * 10, {p})")
    return f"select l_returnflag, cast(floor({f(0.5)}) as bigint) as q50, cast(floor({f(0.9)}) as bigint) as q90 from lineitem group by l_returnflag"


@sql_query("census_rollup")
def census_rollup(d):
    """Counts and bytes by two keys, with subtotals and total."""
    return """
select coalesce(l_returnflag, 'all') as role, coalesce(l_linestatus, 'all') as payload, count(*) as tensors, cast(sum(cast(l_quantity as bigint)) as bigint) as elements, cast(sum(cast(l_quantity as bigint) * 2) as bigint) as bytes
from lineitem group by rollup (l_returnflag, l_linestatus)"""


@sql_query("weighted_merge")
def weighted_merge(d):
    """Means merged with their counts as weights; parts made with different settings are flagged."""
    return """
with parts as (select lang, source, count(*) as n, avg(cast(n_chars as double)) as value, min(lang) as harness from documents group by lang, source)
select source, cast(sum(n) as bigint) as n, round(sum(value * n) / sum(n), 6) as value, count(distinct harness) > 1 as conflict from parts group by source"""


@sql_query("entropy_by_column")
def entropy_by_column(d):
    """log2 N - sum(c log2 c) / N for some columns."""
    return """
with v as (select 'event_type' as col, event_type as x from events union all select 'user_id', cast(user_id as string) from events union all select 'props', props from events),
c as (select col, x, count(*) as c from v group by col, x)
select col, cast(sum(c) as bigint) as n, count(*) as kinds, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) as bits from c group by col""".replace("string)", "string)" if d.spark else "varchar)")


@sql_query("conditional_entropy")
def conditional_entropy(d):
    """H(y | x) with the Miller-Madow correction."""
    return """
with xy as (select user_id % 10 as x, event_type as y, count(*) as c from events group by user_id % 10, event_type),
x as (select x, sum(c) as c from xy group by x),
j as (select cast(sum(c) as double) as n, log2(sum(c)) - sum(c * log2(c)) / sum(c) as h, count(*) as nz from xy),
m as (select log2(sum(c)) - sum(c * log2(c)) / sum(c) as h, count(*) as nz from x)
select cast(n as bigint) as n, round(j.h - m.h, 6) as plain_bits, round(j.h - m.h + (j.nz - m.nz) / (2 * n * ln(2)), 6) as bits from j cross join m"""


@sql_query("escape_bits")
def escape_bits(d):
    """Bits when the 2^k - 1 commonest values take k bits and the rest an escape and 16 bits."""
    return f"""
with c as (select l_partkey % 97 as v, count(*) as c from lineitem group by l_partkey % 97),
r as (select c, row_number() over (order by c desc, v) as r from c),
k as (select n + 2 as k from {d.quote(5, 't', 'n')})
select k, cast(sum(c * case when r <= power(2, k) - 1 then k else k + 16 end) as bigint) as bits from r cross join k group by k"""


@sql_query("tiered_bits")
def tiered_bits(d):
    """Bits when ranked symbols fall into tiers of 2^1, 2^2 - 1, ... entries."""
    return """
with c as (select l_partkey % 97 as v, count(*) as c from lineitem group by l_partkey % 97),
r as (select v, c, row_number() over (order by c desc, v) as r from c),
t as (select c, case when r <= 1 then 1 when r <= 4 then 3 when r <= 11 then 6 when r <= 26 then 10 when r <= 57 then 15 else 21 end as bits from r)
select cast(sum(c) as bigint) as n, cast(sum(c * bits) as bigint) as bits from t"""


@sql_query("byte_histogram")
def byte_histogram(d):
    """Counts of the 256 low bytes of a column."""
    return "select l_extendedprice_cents % 256 as byte, count(*) as n from (select cast(round(l_extendedprice * 100) as bigint) as l_extendedprice_cents from lineitem) t group by l_extendedprice_cents % 256"


@sql_query("best_window")
def best_window(d):
    """Start of the eight neighbouring bins with the most mass, the first on ties."""
    return """
with h as (select user_id % 5 as g, cast(floor(value) as bigint) % 64 as bin, count(*) as n from events where value is not null group by user_id % 5, cast(floor(value) as bigint) % 64),
w as (select g, bin, sum(n) over (partition by g order by bin range between current row and 7 following) as mass from h),
r as (select g, bin, mass, row_number() over (partition by g order by mass desc, bin) as k from w)
select g, bin, cast(mass as bigint) as mass from r where k = 1"""


@sql_query("sweep_stats")
def sweep_stats(d):
    """Per row: mean over the layers under capacity, how many are over, and the largest."""
    return """
with c as (select l_suppkey as row_id, l_linenumber as layer, count(*) as chunks from lineitem group by l_suppkey, l_linenumber)
select row_id, round(avg(case when chunks <= 80 then cast(chunks as double) end), 6) as mean_under, sum(case when chunks > 80 then 1 else 0 end) as n_over, max(chunks) as most from c group by row_id""".replace("sum(case when chunks > 80 then 1 else 0 end)", "cast(sum(case when chunks > 80 then 1 else 0 end) as bigint)")


@sql_query("usage_counts")
def usage_counts(d):
    """Choices per (layer, expert), those out of bounds apart."""
    return "select l_linenumber as layer, l_suppkey % 64 as expert, count(*) as n from lineitem where l_suppkey % 64 between 0 and 63 and l_linenumber between 1 and 64 group by l_linenumber, l_suppkey % 64"


@sql_query("top_share_coverage")
def top_share_coverage(d):
    """Share of accesses that the most used k = max(1, round(p n / 100)) items get."""
    return f"""
with c as (select l_linenumber as layer, l_suppkey as expert, count(*) as c from lineitem group by l_linenumber, l_suppkey),
r as (select layer, c, row_number() over (partition by layer order by c desc, expert) as r, count(*) over (partition by layer) as n from c),
p as (select 10 as p union all select 25 union all select 50)
select layer, p, round(sum(case when r <= greatest(1, floor(n * p / 100.0 + 0.5)) then c else 0 end) / cast(sum(c) as double), 6) as share from r cross join p group by layer, p"""


@sql_query("transfer_matrix")
def transfer_matrix(d):
    """Share of one group's accesses that the items most used in another would cover."""
    return """
with c as (select l_returnflag as dom, l_suppkey as expert, count(*) as c from lineitem group by l_returnflag, l_suppkey),
top as (select dom, expert from (select dom, expert, row_number() over (partition by dom order by c desc, expert) as r from c) t where r <= 20),
tot as (select dom, sum(c) as n from c group by dom),
hit as (select top.dom as learned, c.dom as used, sum(c.c) as n from top join c on top.expert = c.expert group by top.dom, c.dom)
select learned, used, round(hit.n / cast(tot.n as double), 6) as share from hit join tot on hit.used = tot.dom"""


def _two_rows(d):
    """Log-probabilities of row r and of the next row as its candidate, over 64 tokens."""
    return f"""
s as (select row_id, token_id, logit, max(logit) over (partition by row_id) as m from {d.logits} l),
p as (select row_id, token_id, logit - m - ln(sum(exp(logit - m)) over (partition by row_id)) as lp, row_number() over (partition by row_id order by logit desc, token_id) as r from s),
ref as (select row_id, token_id, lp, r from p where r <= 16), cand as (select row_id - 1 as row_id, token_id, lp from p where row_id >= 1)"""


@sql_query("kl_rest_bin")
def kl_rest_bin(d):
    """KL divergence over the reference's kept tokens and one bin for the rest, at least 0."""
    return f"""
with {_two_rows(d)},
j as (select ref.row_id, sum(exp(ref.lp) * (ref.lp - cand.lp)) as s, sum(exp(ref.lp)) as p, sum(exp(cand.lp)) as q from ref join cand on ref.row_id = cand.row_id and ref.token_id = cand.token_id group by ref.row_id)
select row_id, round(greatest(0, s + case when 1 - p > 0 and 1 - q > 0 then (1 - p) * ln((1 - p) / (1 - q)) else 0 end), 6) as kl from j"""


@sql_query("kl_next_token")
def kl_next_token(d):
    """As above over two top lists; a token that the candidate misses gets its floor less 1."""
    return f"""
with {_two_rows(d)},
c16 as (select row_id - 1 as row_id, token_id, lp from p where row_id >= 1 and r <= 16),
lo as (select row_id, min(lp) - 1 as lo from c16 group by row_id)
select ref.row_id, round(sum(exp(ref.lp) * (ref.lp - coalesce(c16.lp, lo.lo))), 6) as kl
from ref join lo on ref.row_id = lo.row_id left join c16 on ref.row_id = c16.row_id and ref.token_id = c16.token_id group by ref.row_id"""


@sql_query("kld_summary")
def kld_summary(d):
    """Mean, standard error, median, tails, largest and perplexity ratio of per-row divergences."""
    q = (lambda p: f"percentile(kl, {p})") if d.spark else (lambda p: f"quantile_cont(kl, {p})")
    return f"""
with {_two_rows(d)},
k as (select ref.row_id, sum(exp(ref.lp) * (ref.lp - cand.lp)) as kl, max(case when ref.r = 1 then ref.lp end) as a, max(case when ref.r = 1 then cand.lp end) as b from ref join cand on ref.row_id = cand.row_id and ref.token_id = cand.token_id group by ref.row_id)
select count(*) as n, round(avg(kl), 6) as mean, round(stddev_samp(kl) / sqrt(count(*)), 6) as se, round({q(0.5)}, 6) as median, round({q(0.99)}, 6) as p99, round(max(kl), 6) as most,
  round(exp(-avg(a)), 4) as ppl_ref, round(exp(-avg(b)), 4) as ppl_cand, round(exp(avg(a) - avg(b)), 4) as ratio from k"""


@sql_query("verdict_bounds")
def verdict_bounds(d):
    """Pass if all rows are equal, or mean and largest divergence and top-1 agreement keep their bounds."""
    return f"""
with {_two_rows(d)},
best as (select row_id, token_id from (select row_id, token_id, row_number() over (partition by row_id order by lp desc, token_id) as r from cand) t where r = 1),
k as (select ref.row_id, sum(exp(ref.lp) * (ref.lp - cand.lp)) as kl, max(case when ref.r = 1 then ref.token_id end) as top, max(case when ref.r = 1 then ref.lp end) - max(case when ref.r = 2 then ref.lp end) as lead
  from ref join cand on ref.row_id = cand.row_id and ref.token_id = cand.token_id group by ref.row_id)
select count(*) as n, round(avg(kl), 6) as mean_kl, round(max(kl), 6) as max_kl, cast(sum(case when lead > 0.1 then 1 else 0 end) as bigint) as n_clear, cast(sum(case when lead > 0.1 and top = best.token_id then 1 else 0 end) as bigint) as n_agree,
  avg(kl) <= 0.5 and max(kl) <= 5 and sum(case when lead > 0.1 and top = best.token_id then 1 else 0 end) >= 0.9 * sum(case when lead > 0.1 then 1 else 0 end) as pass
from k join best on k.row_id = best.row_id"""


@sql_query("choice_accuracy")
def choice_accuracy(d):
    """Accuracy of the largest score and of the largest score per length; the first choice on ties."""
    return f"""
with c as (select row_id, token_id, logit, logit / (1 + token_id % 3) as norm from {d.logits} l),
b as (select row_id, row_id % 64 as gold, row_number() over (partition by row_id order by logit desc, token_id) as a, row_number() over (partition by row_id order by norm desc, token_id) as n, token_id from c)
select count(distinct row_id) as items, cast(sum(case when a = 1 and token_id = gold then 1 else 0 end) as bigint) as acc, cast(sum(case when n = 1 and token_id = gold then 1 else 0 end) as bigint) as acc_norm from b"""


def _arms(d):
    return "arms as (select e.doc_id as id, case when e.quality = 1 then 1 else 0 end as base, case when d.n_chars % 7 <> 0 then 1 else 0 end as cand, d.lang as grp from labels e join documents d on e.doc_id = d.doc_id)"


@sql_query("paired_harm_gain")
def paired_harm_gain(d):
    """Items that only one of two arms gets right."""
    return f"with {_arms(d)} select grp, count(*) as n, cast(sum(case when base = 1 and cand = 0 then 1 else 0 end) as bigint) as harm, cast(sum(case when base = 0 and cand = 1 then 1 else 0 end) as bigint) as gain from arms group by grp"


@sql_query("paired_outcomes")
def paired_outcomes(d):
    """Both arms' outcomes by item."""
    return f"with {_arms(d)} select id, base, cand, cand - base as diff from arms"


@sql_query("suite_decision")
def suite_decision(d):
    """Failed, uncertain or continue, from each group's change against two limits, and for the macro mean."""
    return f"""
with {_arms(d)}, g as (select grp, avg(cast(cand - base as double)) as delta, count(*) as n from arms group by grp),
a as (select grp, delta, n from g union all select 'macro', avg(delta), cast(sum(n) as bigint) from g)
select grp, n, round(delta, 6) as delta, case when delta < -0.2 then 'failed' when delta < -0.05 then 'uncertain' else 'continue' end as decision from a"""


@sql_query("round_metrics")
def round_metrics(d):
    """Median of first values, pooled tail of gaps, and rate over the span."""
    gap = f"({d.epoch_us('ts')} - lag({d.epoch_us('ts')}) over (partition by user_id order by ts, event_id)) / 1000.0"
    q = "percentile(g, 0.99)" if d.spark else "quantile_cont(g, 0.99)"
    return f"""
with e as (select user_id % 10 as round, value, cast({gap} as double) as g, {d.epoch_us('ts')} as us from events)
select round, count(*) as n, round(median(value), 6) as median_value, round({q}, 6) as p99_gap_ms, round(count(*) * 1000000.0 / (max(us) - min(us)), 9) as per_s from e group by round""".replace("round(count(*) * 1000000.0 / (max(us) - min(us)), 9)", "round(cast(count(*) * 1000000 as double) / (max(us) - min(us)), 9)")


@sql_query("class_ranking", longs="by_bytes by_models")
def class_ranking(d):
    """Bytes and number of members per class, ranked both ways."""
    return """
with c as (select p_type as class, cast(sum(p_size) as bigint) as bytes, count(distinct p_brand) as models from part group by p_type)
select class, bytes, models, row_number() over (order by bytes desc, class) as by_bytes, row_number() over (order by models desc, bytes desc, class) as by_models from c"""


@sql_query("store_stats")
def store_stats(d):
    """Totals of raw and stored sizes."""
    return "select count(*) as objects, cast(sum(n_chars) as bigint) as raw, cast(sum(length(text)) as bigint) as stored, count(distinct text) as contents from documents"


@sql_query("stable_sum")
def stable_sum(d):
    """Sums that do not depend on the order of rows."""
    return "select l_returnflag, cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) as total, cast(sum(cast(l_discount as decimal(18, 4))) as double) as discount from lineitem group by l_returnflag"


@sql_query("metric_value_valid")
def metric_value_valid(d):
    """Bounds of metric values: finite, 0 to 1e15, whole where counts, at most 1 where fractions."""
    return """
select event_type, count(*) as n, cast(sum(case when value >= 0 and value <= 1e15 then 1 else 0 end) as bigint) as in_range, cast(sum(case when value = floor(value) then 1 else 0 end) as bigint) as whole,
  cast(sum(case when value between 0 and 1 then 1 else 0 end) as bigint) as fraction, cast(sum(case when value >= 1 then 1 else 0 end) as bigint) as perplexity from events where value is not null group by event_type"""


@sql_query("metric_directions")
def metric_directions(d):
    """Metrics with unit and direction, as a small dimension table."""
    return """
with m as (select 'view' as event_type, 'count' as unit, true as higher_better union all select 'click', 'count', true union all select 'purchase', 'money', true union all select 'signup', 'count', true union all select 'error', 'count', false)
select e.event_type, unit, higher_better, count(*) as n from events e join m on e.event_type = m.event_type group by e.event_type, unit, higher_better"""


@sql_query("deviation_report")
def deviation_report(d):
    """|observed - predicted| and its ratio to the prediction, null where that is 0."""
    return """
with p as (select l_suppkey, avg(l_quantity) as observed, avg(l_discount * 100) as predicted from lineitem group by l_suppkey)
select l_suppkey, round(abs(observed - predicted), 6) as deviation, round(abs(observed - predicted) / nullif(predicted, 0), 6) as relative from p"""


def _systems(d):
    return """runs as (select event_type as metric, case when user_id % 2 = 0 then 'a' else 'b' end as sys, user_id % 8 as repeat, avg(value) as value from events where value is not null group by event_type, case when user_id % 2 = 0 then 'a' else 'b' end, user_id % 8),
cells as (select metric, sys, count(*) as n, avg(value) as mean, stddev_samp(value) as sd, median(value) as med, min(value) as lo, max(value) as hi from runs group by metric, sys)"""


@sql_query("bench_compare")
def bench_compare(d):
    """Base and candidate cells side by side."""
    return f"with {_systems(d)} select x.metric, round(x.mean, 6) as base, round(y.mean, 6) as cand, round(y.mean / nullif(x.mean, 0) - 1, 6) as change from cells x join cells y on x.metric = y.metric and x.sys = 'a' and y.sys = 'b'"


@sql_query("route_decision")
def route_decision(d):
    """A class is routed anew if its gain is at least G and no member loses more than W."""
    return """
with m as (select p_brand, p_type as class, avg(p_retailprice) as a, avg(p_retailprice * (1 + (p_size % 7) / 100.0)) as b from part group by p_brand, p_type),
g as (select class, p_brand, b / a - 1 as gain from m)
select class, round(avg(gain), 6) as gain, round(min(gain), 6) as worst, avg(gain) >= 0.03 and min(gain) >= -0.01 as route from g group by class"""
