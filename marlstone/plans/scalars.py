"""Scalar functions: dates, text, numbers and digests."""

from marlstone.functions.dialect import sql_query


@sql_query("days_from_civil")
def days_from_civil(d):
    """Days since 1970-01-01 by the proleptic Gregorian rule, and back to year, month and day."""
    return f"select o_orderkey, {d.day('o_orderdate')} as days, cast(year(o_orderdate) as bigint) as y, cast(month(o_orderdate) as bigint) as m, cast(day(o_orderdate) as bigint) as dd from orders"


@sql_query("age_days")
def age_days(d):
    """Days from a date to a fixed day."""
    return f"select o_orderkey, 20000 - {d.day('o_orderdate')} as age from orders"


@sql_query("varint_len")
def varint_len(d):
    """Bytes of the base-128 form of a number and of its zigzag form."""
    size = lambda x: "case " + " ".join(f"when {x} < {1 << 7 * k} then {k}" for k in range(1, 9)) + " else 9 end"
    return f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, {size('l_partkey')} as n, {size('2 * abs(l_partkey - l_suppkey)')} as z from lineitem"


@sql_query("last_number")
def last_number(d):
    """The last number in a text, commas dropped, a trailing dot cut."""
    found = d.all(d.sub("coalesce(text, '')", ",", ""), "[0-9]+(?:[.][0-9]+)?")
    last = d.at("f", "size(f)" if d.spark else "len(f)")
    return f"select doc_id, case when {d.size('f')} > 0 then {last} end as number from (select doc_id, {found} as f from documents) t"


@sql_query("split_reasoning")
def split_reasoning(d):
    """Thought and answer, if the opening mark is the first text; else all is answer."""
    body = "concat(case when turn % 3 = 0 then concat('  <think>', role, ' plans ', '</think>  ') else '' end, text)"
    tag = d.like("t", "^ *<think>")
    return f"""
select conv_id, turn, case when {tag} then rtrim({d.get('t', '^ *<think>([^<]*)</think>')}) else '' end as reasoning,
  case when {tag} then ltrim(substr(t, instr(t, '</think>') + 8)) else t end as answer from (select conv_id, turn, {body} as t from conversations) x"""


@sql_query("stop_cut")
def stop_cut(d):
    """Text before the earliest of some stop strings."""
    p = lambda s: f"case when instr(text, '{s}') > 0 then instr(text, '{s}') else 1000000000 end"
    return f"select doc_id, substr(text, 1, cast(least(least({p(' and ')}, {p(' de ')}), length(text) + 1) - 1 as int)) as kept from documents"


@sql_query("token_counts")
def token_counts(d):
    """Tokens of a blank-separated text, and its bytes."""
    n = "octet_length(text)" if d.spark else "strlen(text)"
    return f"select doc_id, {d.size(d.words('text'))} as tokens, cast({n} as bigint) as bytes from documents"


@sql_query("capacity_users")
def capacity_users(d):
    """Bytes per token and how many users fit a device."""
    return f"""
select s_suppkey, 2 * 32 * 8 * 128 * 2 as bytes_per_token, {d.idiv('cast(greatest(s_acctbal, 0) * 1000000 as bigint)', '2 * 32 * 8 * 128 * 2 * 4096')} as users from supplier"""


@sql_query("checked_sum")
def checked_sum(d):
    """Sums that would pass the range of 64 bits become null."""
    return "select o_custkey, case when sum(cast(o_orderkey as decimal(38, 0)) * 1000000000000000) > 9223372036854775807 then null else cast(sum(cast(o_orderkey as decimal(38, 0)) * 1000000000000000) as bigint) end as total from orders group by o_custkey"


@sql_query("constraint_regex_filter")
def constraint_regex_filter(d):
    """Texts that a pattern, a choice or a JSON shape admits."""
    return f"select event_id, {d.like('props', '^[{]\"[a-z]+\": [0-9]+[}]$')} as shape, event_type in ('view', 'click') as choice from events"


@sql_query("bf16_round")
def bf16_round(d):
    """Prices rounded to eight significant bits, ties to even."""
    return """
with x as (select p_partkey, p_retailprice as v, floor(log2(p_retailprice)) as e from part where p_retailprice > 0),
y as (select p_partkey, v, power(2.0, e - 7) as u from x),
z as (select p_partkey, v, u, floor(v / u) as f, v / u - floor(v / u) as r from y)
select p_partkey, round((f + case when r > 0.5 or (r = 0.5 and f % 2 = 1) then 1 else 0 end) * u, 6) as value from z"""


@sql_query("py_json")
def py_json(d):
    """Rows as JSON with sorted keys and the separators of a common library."""
    s = (lambda x: f"cast({x} as string)") if d.spark else (lambda x: f"cast({x} as varchar)")
    return f"""select o_orderkey, concat('{{"key": ', {s('o_orderkey')}, ', "status": "', o_orderstatus, '"}}') as compact from orders"""


@sql_query("pack_roundtrip")
def pack_roundtrip(d):
    """Small objects packed into one per group; each read back by its place."""
    rows = "collect_list(struct(event_id, props))" if d.spark else None
    if d.spark:
        return f"""with p as (select user_id, array_sort({rows}) as pack from events group by user_id)
select user_id, cast(i as bigint) as place, e.event_id as event_id, e.props as props from p lateral view posexplode(pack) as i, e"""
    return "select user_id, row_number() over (partition by user_id order by event_id, props) - 1 as place, event_id, props from events"


@sql_query("corpus_sections")
def corpus_sections(d):
    """Sections of a corpus text by their heading marks."""
    if d.spark:
        return """
with t as (select conv_id, concat_ws('', transform(array_sort(collect_list(struct(turn, concat('@@@ ', role, chr(10), text, chr(10)) as t))), x -> x.t)) as t from conversations group by conv_id)
select conv_id, cast(i as bigint) as section, substring_index(s, chr(10), 1) as kind from (select conv_id, i, s from t lateral view posexplode(split(t, '@@@ ')) as i, s) x where i > 0"""
    return """
with t as (select conv_id, string_agg('@@@ ' || role || chr(10) || text || chr(10), '' order by turn, '@@@ ' || role || chr(10) || text || chr(10)) as t from conversations group by conv_id),
x as (select conv_id, string_split(t, '@@@ ') as p from t), y as (select conv_id, unnest(range(0, len(p))) as i, unnest(p) as s from x)
select conv_id, i as section, split_part(s, chr(10), 1) as kind from y where i > 0"""


@sql_query("scan_select_columns")
def scan_select_columns(d):
    """A scan that reads two columns and pushes its filter down."""
    return "select l_orderkey, l_quantity from lineitem where l_quantity >= 45"


@sql_query("log_field_extract")
def log_field_extract(d):
    """Fields of rendered log lines by pattern."""
    s = (lambda x: f"cast({x} as string)") if d.spark else (lambda x: f"cast({x} as varchar)")
    line = f"concat('server v1.', {s('user_id % 7')}, ' model=m', {s('user_id')}, ' took ', {s('event_id')}, ' ms')"
    return f"select event_id, {d.get('l', 'v([0-9.]+)')} as version, {d.get('l', 'model=([a-z0-9]+)')} as model, cast({d.get('l', 'took ([0-9]+) ms')} as bigint) as ms from (select event_id, {line} as l from events) t"


@sql_query("bench_normalise")
def bench_normalise(d):
    """Two layouts of one record brought to one row; other records give nulls."""
    s = (lambda x: f"cast({x} as string)") if d.spark else (lambda x: f"cast({x} as varchar)")
    doc = f"case when event_id % 2 = 0 then concat('{{\"rate\": ', {s('event_id')}, '}}') else concat('{{\"metrics\": {{\"rate\": ', {s('event_id')}, '}}}}') end"
    return f"select event_id, cast(coalesce({d.json('doc', 'rate')}, {d.json('doc', 'metrics.rate')}) as bigint) as rate from (select event_id, {doc} as doc from events) t"
