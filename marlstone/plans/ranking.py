"""Ranking, cutting and sampling of scored candidates, with ties by the smaller key."""

from marlstone.functions.dialect import sql_query


def ranked(d) -> str:
    return f"r as (select row_id, token_id, logit, row_number() over (partition by row_id order by logit desc, token_id) as k from {d.logits} l)"


def probs(d, temperature: float = 1.0) -> str:
    return f"""m as (select row_id, token_id, logit, max(logit) over (partition by row_id) as top from {d.logits} l),
x as (select row_id, token_id, logit, exp((logit - top) / {temperature}) as e from m),
p as (select row_id, token_id, logit, e / sum(e) over (partition by row_id) as p from x)"""


@sql_query("argmax_first")
def argmax_first(d):
    """The first largest entry of each row."""
    return f"with {ranked(d)} select row_id, token_id, round(logit, 6) as logit from r where k = 1"


@sql_query("topk_ties", longs="k")
def topk_ties(d):
    """The eight largest; on ties the smaller id."""
    return f"with {ranked(d)} select row_id, token_id, k, round(logit, 6) as logit from r where k <= 8"


@sql_query("minp_cut")
def minp_cut(d):
    """Entries with at least a fraction of the largest probability."""
    return f"with {probs(d)} select row_id, token_id, round(p, 6) as p from (select row_id, token_id, p, max(p) over (partition by row_id) as top from p) q where round(p - 0.2 * top, 12) >= 0"


@sql_query("topp_cut")
def topp_cut(d):
    """Min-p first; then the largest until their sum reaches top-p, the crossing entry included."""
    return f"""
with {probs(d)}, q as (select row_id, token_id, p, max(p) over (partition by row_id) as top from p),
c as (select row_id, token_id, p, sum(p) over (partition by row_id order by p desc, token_id rows between unbounded preceding and current row) as cum from q where round(p - 0.01 * top, 12) >= 0)
select row_id, token_id, round(p, 6) as p from c where round(cum - p, 9) < 0.5"""


@sql_query("softmax_temp")
def softmax_temp(d):
    """Probabilities at a temperature."""
    return f"with {probs(d, 0.7)} select row_id, token_id, round(p, 6) as p from p"


@sql_query("inverse_cdf_draw", longs="k")
def inverse_cdf_draw(d):
    """The entry at which the running sum reaches a seeded uniform number."""
    return f"""
with {probs(d)}, c as (select row_id, token_id, sum(p) over (partition by row_id order by p desc, token_id rows between unbounded preceding and current row) as cum, (row_id * 7919 % 1000) / 1000.0 as u from p)
select row_id, token_id, k from (select row_id, token_id, row_number() over (partition by row_id order by cum, token_id) as k from c where round(cum, 9) >= u) t where k = 1"""


@sql_query("penalised_scores")
def penalised_scores(d):
    """Bias, repetition, presence and frequency penalties by how often a token was used before."""
    return f"""
with c as (select row_id, token_id, case when (row_id + token_id) % 5 = 0 then 1 + token_id % 3 else 0 end as n, logit + case when token_id = 7 then 0.5 else 0 end as s from {d.logits} l where token_id <> 13)
select row_id, token_id, round(case when n = 0 then s when s > 0 then s / 1.2 - 0.3 - 0.1 * n else s * 1.2 - 0.3 - 0.1 * n end, 6) as score from c"""


@sql_query("logprobs_topk", longs="k")
def logprobs_topk(d):
    """Log-softmax of the raw row, the five largest."""
    return f"""
with m as (select row_id, token_id, logit, max(logit) over (partition by row_id) as top, row_number() over (partition by row_id order by logit desc, token_id) as k from {d.logits} l),
z as (select row_id, token_id, k, logit - top - ln(sum(exp(logit - top)) over (partition by row_id)) as lp from m)
select row_id, token_id, k, round(lp, 6) as logprob from z where k <= 5"""


@sql_query("router_topk", longs="k")
def router_topk(d):
    """Sigmoid, softmax and root-softplus scores (by row), a bias that only picks, the picked weights renormalised and scaled."""
    return f"""
with m as (select row_id, token_id, logit, max(logit) over (partition by row_id) as top from {d.logits} l),
x as (select row_id, token_id, case row_id % 3 when 0 then 1 / (1 + exp(-logit)) when 1 then exp(logit - top) / sum(exp(logit - top)) over (partition by row_id) else sqrt(ln(1 + exp(logit))) end as s from m),
s as (select row_id, token_id, s, s + (token_id % 4) * 0.01 as pick from x),
k as (select row_id, token_id, s, row_number() over (partition by row_id order by round(pick, 12) desc, token_id) as k from s)
select row_id, token_id, k, round(2.5 * s / sum(s) over (partition by row_id), 6) as weight from k where k <= 4"""


@sql_query("mask_allowed")
def mask_allowed(d):
    """Entries outside the allowed list get no score."""
    return f"select row_id, l.token_id, case when a.token_id is null then null else round(logit, 6) end as logit from {d.logits} l left join (select n * 3 as token_id from {d.quote(22, 't', 'n')}) a on l.token_id = a.token_id"


@sql_query("ranked_candidates", longs="k")
def ranked_candidates(d):
    """Score rising, then the key; the best k of each group."""
    return "select n_name, s_suppkey, k, round(s_acctbal, 2) as score from (select n_name, s_suppkey, s_acctbal, row_number() over (partition by n_name order by s_acctbal, s_suppkey) as k from supplier s join nation n on s.s_nationkey = n.n_nationkey) t where k <= 3"


@sql_query("winner_runner_up", longs="place")
def winner_runner_up(d):
    """Best row of each digest, then the first two of each group."""
    return """
with a as (select p_brand, p_type as digest, p_partkey, p_retailprice, row_number() over (partition by p_brand, p_type order by p_retailprice, p_partkey) as k from part),
b as (select p_brand, digest, p_partkey, p_retailprice, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as place from a where k = 1)
select p_brand, digest, p_partkey, place, round(p_retailprice, 2) as price from b where place <= 2"""


@sql_query("least_loaded")
def least_loaded(d):
    """The replica with the least latency times (active + 1), among those under their limits."""
    return """
with r as (select s_nationkey as model, s_suppkey as replica, 1 + s_suppkey % 17 as ms, s_suppkey % 5 as active, s_acctbal as free from supplier where s_suppkey % 5 < 4 and s_acctbal > 0),
k as (select model, replica, ms * (active + 1) as cost, row_number() over (partition by model order by ms * (active + 1), replica) as k from r)
select model, replica, cost from k where k = 1"""


@sql_query("latest_per_key")
def latest_per_key(d):
    """The newest row of each key."""
    return "select user_id, event_type, event_id from (select user_id, event_type, event_id, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) t where k = 1"


@sql_query("hash_sample")
def hash_sample(d):
    """The first 20 of each group by the digest of (seed, group, key)."""
    key = "concat('17:', lang, ':', cast(doc_id as string))" if d.spark else "concat('17:', lang, ':', doc_id)"
    return f"select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by {d.sha(key)}, doc_id) as k from documents) t where k <= 20"


@sql_query("dequantise_runs")
def dequantise_runs(d):
    """(code - bias) x scale over runs of 32 with a scale from each run's largest magnitude."""
    return f"""
with s as (select row_id, token_id, logit, max(abs(logit)) over (partition by row_id, {d.idiv('token_id', '32')}) / 7 as scale from {d.logits} l),
q as (select row_id, token_id, scale, floor(logit / nullif(scale, 0) + 0.5) + 8 as code from s)
select row_id, token_id, cast(code as bigint) as code, round((code - 8) * scale, 6) as value from q"""


@sql_query("activation_values")
def activation_values(d):
    """SwiGLU's gate, GELU by tanh, softplus and its root."""
    return f"""
select row_id, token_id, round(logit / (1 + exp(-logit)), 6) as silu, round(0.5 * logit * (1 + tanh(0.7978845608028654 * (logit + 0.044715 * logit * logit * logit))), 6) as gelu,
  round(ln(1 + exp(logit)), 6) as softplus, round(sqrt(ln(1 + exp(logit))), 6) as root from {d.logits} l"""


@sql_query("bits_by_use")
def bits_by_use(d):
    """The ceil(n p / 100) most used of each layer get 3 bits, the others 2."""
    return """
with c as (select l_linenumber as layer, l_suppkey as expert, count(*) as n from lineitem group by l_linenumber, l_suppkey),
r as (select layer, expert, row_number() over (partition by layer order by n desc, expert) as k, count(*) over (partition by layer) as m from c)
select layer, expert, case when k <= ceil(m * 25 / 100.0) then 3 else 2 end as bits from r"""
