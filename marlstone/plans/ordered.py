"""Windows and computations in the order of an explicit key."""

from marlstone.functions.dialect import sql_query


@sql_query("zigzag_delta")
def zigzag_delta(d):
    """Differences to the previous value, mapped to whole numbers from 0 on."""
    return f"""
with x as (select l_orderkey, l_linenumber, l_partkey, l_partkey - coalesce(lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey), 0) as delta from lineitem)
select l_orderkey, l_linenumber, l_partkey, delta, case when delta >= 0 then 2 * delta else -2 * delta - 1 end as zigzag from x"""


@sql_query("prefix_bytes")
def prefix_bytes(d):
    """Running sums of layer sizes."""
    return "select p_brand, p_partkey, cast(sum(p_size) over (partition by p_brand order by p_partkey rows between unbounded preceding and current row) as bigint) as bytes from part"


@sql_query("event_gaps")
def event_gaps(d):
    """Microseconds since the user's previous event."""
    return f"select event_id, user_id, {d.epoch_us('ts')} - lag({d.epoch_us('ts')}) over (partition by user_id order by ts, event_id) as gap_us from events"


@sql_query("last_n_per_user", longs="k")
def last_n_per_user(d):
    """The newest 30 events of each user."""
    return "select user_id, event_id, k from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) t where k <= 30"


@sql_query("even_windows")
def even_windows(d):
    """Four windows of 20 words, evenly spaced: start_i = i (n - len) / (count - 1)."""
    return f"""
with w as (select doc_id, {d.size(d.words('text'))} as n from documents)
select doc_id, i, {d.idiv('i * (n - 20)', '3')} as start, {d.idiv('i * (n - 20)', '3')} + 20 as stop from w cross join {d.quote(4, 't', 'i')} where n >= 20"""


@sql_query("chunk_tokens")
def chunk_tokens(d):
    """Whole chunks of 128 words of each document; the rest is dropped."""
    return f"""
with c as (select doc_id, {d.idiv('pos', '128')} as chunk, count(*) as n, min(pos) as start from {d.doc_words} w group by doc_id, {d.idiv('pos', '128')})
select doc_id, chunk, start from c where n = 128"""


@sql_query("config_islands")
def config_islands(d):
    """Neighbouring rows with one setting as one interval."""
    return """
with f as (select user_id, event_id, ts, event_type, case when event_type = lag(event_type) over (partition by user_id order by ts, event_id) then 0 else 1 end as new from events),
g as (select user_id, event_id, event_type, sum(new) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as island from f)
select user_id, cast(island as bigint) as island, event_type, count(*) as n, min(event_id) as first_id, max(event_id) as last_id from g group by user_id, island, event_type"""


CHAIN = "chain as (select o_orderkey as id, case when o_orderkey % 5 = 1 then null else o_orderkey - 1 end as base, cast(floor(o_totalprice) as bigint) as raw, o_orderkey % 11 = 3 as deleted from orders)"


def depths(d) -> str:
    steps = "d0 as (select id, base, 0 as depth, id as root from chain where base is null or base not in (select id from chain))"
    if d.spark:
        steps = "d0 as (select c.id, c.base, 0 as depth, c.id as root from chain c left anti join chain b on c.base = b.id)"
    for k in range(1, 5):
        steps += f", d{k} as (select c.id, c.base, {k} as depth, p.root from chain c join d{k - 1} p on c.base = p.id)"
    return steps + ", dd as (" + " union all ".join(f"select * from d{k}" for k in range(5)) + ")"


@sql_query("chain_depth")
def chain_depth(d):
    """Depth of an object along its chain of bases, four at most."""
    return f"with {CHAIN}, {depths(d)} select id, base, cast(depth as bigint) as depth, root from dd"


@sql_query("request_spans")
def request_spans(d):
    """Root, queue, prefill and decode spans of each request, none of negative length."""
    return f"""
with r as (select event_id, {d.epoch_us('ts')} as t0, cast(floor(greatest(value, 0) * 1000) as bigint) as us from events where value is not null),
k as (select n from {d.quote(4, 't', 'n')})
select event_id, case n when 0 then 'root' when 1 then 'queue' when 2 then 'prefill' else 'decode' end as span,
  t0 + case n when 0 then 0 when 1 then 0 when 2 then {d.idiv('us', '10')} else {d.idiv('us', '4')} end as start_us,
  case n when 0 then us when 1 then {d.idiv('us', '10')} when 2 then {d.idiv('us', '4')} - {d.idiv('us', '10')} else us - {d.idiv('us', '4')} end as duration_us from r cross join k"""
