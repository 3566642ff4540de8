"""Shape detection, column types and predicates over text and records."""

from marlstone.functions.dialect import sql_query


def csv_lines(d) -> str:
    s = (lambda x: f"cast({x} as string)") if d.spark else (lambda x: f"cast({x} as varchar)")
    return f"(select event_id as line_no, concat({s('event_id')}, ',', {s('user_id')}, ',', event_type, ',', {s('event_id % 7')}) as line from events)"


def votes(lines: str) -> str:
    """Modal field count of each delimiter and its share of the lines."""
    one = lambda name, c, order: f"select '{name}' as delim, {order} as pref, length(line) - length(replace(line, {c}, '')) + 1 as fields from {lines} z where line <> ''"
    return f"""v as ({one('space', "' '", 1)} union all {one('tab', 'chr(9)', 2)} union all {one('comma', "','", 3)}),
c as (select delim, pref, fields, count(*) as n from v group by delim, pref, fields),
m as (select delim, pref, fields, n, sum(n) over (partition by delim) as total, row_number() over (partition by delim order by n desc, fields desc) as k from c),
vote as (select delim, pref, fields, n / cast(total as double) as share from m where k = 1)"""


def shape(d, lines: str, order: str) -> str:
    """Shape of lines; whether all are bracketed or tagged is judged on the first 64 in ``order``."""
    return f"""
with {votes(lines)},
f as (select count(*) as n, sum(case when {d.like('line', '^[{].*[}]$')} then 1 else 0 end) as n_json, sum(case when line like 'INSERT INTO%' then 1 else 0 end) as n_sql,
  sum(case when {d.like('line', '^[(].*[)][,;]?$')} then 1 else 0 end) as n_tuple, sum(case when instr(line, chr(0)) > 0 then 1 else 0 end) as n_nul from {lines} y where line <> ''),
first as (select sum(case when line like '[%' or line like '<%' then 0 else 1 end) as n_bare from (select line from {lines} x where line <> '' order by {order} limit 64) h),
best as (select max(case when share >= 0.98 and fields between 2 and 64 then fields end) as fine, max(case when share >= 0.9 and fields between 2 and 64 then fields end) as ok from vote)
select cast(n as bigint) as n_lines, case when n_nul > 0 then 'none' when n_sql > 0 then 'sql' when n >= 8 and n_json >= 0.9 * n then 'json' when n_bare = 0 then 'none' when n_tuple >= 0.9 * n then 'sql' when n < 8 then 'none'
  when coalesce(fine, ok) is not null then 'delimited' else 'template' end as shape, cast(coalesce(fine, ok) as bigint) as fields from f cross join best cross join first"""


@sql_query("detect_shape_events_csv")
def detect_shape_events_csv(d):
    """Shape of rendered event lines."""
    return shape(d, csv_lines(d), "line_no")


@sql_query("detect_shape_docs")
def detect_shape_docs(d):
    """Shape of the lines of all documents."""
    return shape(d, d.doc_lines, "doc_id, pos")


@sql_query("delimiter_vote")
def delimiter_vote(d):
    """Modal field count of each delimiter."""
    return f"with {votes(csv_lines(d))} select delim, cast(fields as bigint) as fields, round(share, 6) as share, share >= 0.9 and fields between 2 and 64 as accepted from vote"


@sql_query("delimited_scan")
def delimited_scan(d):
    """Lines of the modal number of fields as columns; the others stay raw."""
    return f"""
select line_no, case when {d.size('p')} = 4 then {d.at('p', '1')} end as c1, case when {d.size('p')} = 4 then {d.at('p', '3')} end as c3, case when {d.size('p')} <> 4 then line end as raw
from (select line_no, line, {d.split('line', ',')} as p from {csv_lines(d)} x) y"""


@sql_query("log_templates")
def log_templates(d):
    """Lines with every token that holds a digit made a hole; templates by count."""
    s = (lambda x: f"cast({x} as string)") if d.spark else (lambda x: f"cast({x} as varchar)")
    line = f"concat('user ', {s('user_id')}, ' did ', event_type, ' at t', {s('event_id')}, ': ok')"
    return f"select template, count(*) as n from (select {d.sub(line, '[A-Za-z0-9_.:/-]*[0-9][A-Za-z0-9_.:/-]*', '<*>')} as template from events) t group by template"


def _texts(d) -> str:
    s = (lambda x: f"cast({x} as string)") if d.spark else (lambda x: f"cast({x} as varchar)")
    t = "date_format(ts, 'yyyy-MM-dd HH:mm:ss')" if d.spark else "strftime(ts, '%Y-%m-%d %H:%M:%S')"
    return f"(select 'event_id' as col, event_id as at, {s('event_id')} as v from events union all select 'user_id', event_id, {s('user_id')} from events union all select 'event_type', event_id, event_type from events union all select 'props', event_id, props from events union all select 'value', event_id, {s('value')} from events where value is not null union all select 'ts', event_id, {t} from events union all select 'day', event_id, concat(substr({t}, 1, 10), 'T00:00:00Z') from events)"


INT = "^(0|-?[1-9][0-9]{0,17})$"
DEC = "^(0|-?[1-9][0-9]{0,8}|-?0)[.][0-9]{1,9}$"


_DAY, _HOUR = "(0[1-9]|[12][0-9]|3[01])", "([01][0-9]|2[0-3])(:[0-5][0-9]){2}"
_MONTH, _DATE = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)", f"[0-9]{{4}}-(0[1-9]|1[0-2])-{_DAY}"
#: The layouts of times; a column of times has one of them in all rows.
TIMES = (f"@{_DAY}/{_MONTH}/[0-9]{{4}}:{_HOUR}", f"{_DATE}T{_HOUR}Z", f"{_DATE} {_HOUR}", f"{_DAY}/{_MONTH}/[0-9]{{4}}:{_HOUR}",
         f"{_DATE} {_HOUR}[.][0-9]{{6}}", f"{_DATE}T{_HOUR}[.][0-9]{{3}}Z", f"{_DATE}T{_HOUR}[.][0-9]{{6}}Z", f"{_DATE} {_HOUR}[.][0-9]{{3}}")


def _time(d) -> str:
    """Whether all values are times of one layout (@ stands for the opening bracket)."""
    bracket = "\\\\[" if d.spark else "\\["
    return "greatest(" + ", ".join("sum(case when {} then 1 else 0 end)".format(d.like("v", f"^{p}$".replace("@", bracket))) for p in TIMES) + ") = count(*)"


@sql_query("infer_types_all")
def infer_types_all(d):
    """INT if all are canonical, TIME if all have one layout; DICT8, DICT and DEC by share and count of distinct values; else TEXT."""
    return f"""
select col, count(*) as n, case when sum(case when {d.like('v', INT)} then 0 else 1 end) = 0 then 'INT' when {_time(d)} then 'TIME' when count(distinct v) <= count(*) / 3.0 + 1 and count(distinct v) <= 256 then 'DICT8'
  when count(distinct v) <= count(*) / 3.0 + 1 then 'DICT' when sum(case when {d.like('v', DEC)} then 1 else 0 end) >= 0.9 * count(*) then 'DEC' else 'TEXT' end as kind from {_texts(d)} t group by col"""


@sql_query("infer_types_tolerant")
def infer_types_tolerant(d):
    """As above, times too, with a tenth of exceptions for integers, and CONST for one value."""
    return f"""
select col, count(*) as n, case when sum(case when {d.like('v', INT)} then 1 else 0 end) >= 0.9 * count(*) then 'INT' when count(distinct v) = 1 then 'CONST' when {_time(d)} then 'TIME' when count(distinct v) <= count(*) / 3.0 + 1 then 'DICT'
  when sum(case when {d.like('v', DEC)} then 1 else 0 end) >= 0.9 * count(*) then 'DEC' else 'TEXT' end as kind from {_texts(d)} t group by col"""


@sql_query("shape_dictionary", longs="k")
def shape_dictionary(d):
    """Seeds of a trained dictionary: values by count, then by value, 4096 at most a column."""
    return f"select col, v, n, k from (select col, v, n, row_number() over (partition by col order by n desc, v) as k from (select col, v, count(*) as n from {_texts(d)} t group by col, v) c) r where k <= 4096"


@sql_query("decimal_scale", longs="places")
def decimal_scale(d):
    """Decimals as whole numbers at the column's largest number of places."""
    return """
with k as (select n, cast(power(10, n) as bigint) as p from (select 0 as n union all select 1 union all select 2 union all select 3 union all select 4) t),
m as (select min(n) as places from (select n from lineitem cross join k group by n, p having max(abs(l_discount * p - round(l_discount * p))) < 1e-6) x)
select l_orderkey, l_linenumber, l_discount, cast(round(l_discount * power(10, m.places)) as bigint) as scaled, m.places from lineitem cross join m"""


@sql_query("byte_planes")
def byte_planes(d):
    """The k-th byte of every value together: distinct values and most frequent share of each plane."""
    return f"""
with b as (select n as k, {d.idiv('l_partkey', 'cast(power(256, n) as bigint)')} % 256 as b from lineitem cross join {d.quote(4, 't', 'n')}),
c as (select k, b, count(*) as n from b group by k, b)
select k, count(*) as kinds, round(max(n) / cast(sum(n) as double), 6) as top_share from c group by k"""


@sql_query("common_power")
def common_power(d):
    """The largest power of ten, up to 9, that divides all values."""
    return f"""
with v as (select p_brand, cast(p_size * 100 as bigint) as v from part), k as (select n from {d.quote(10, 't', 'n')}),
a as (select p_brand, n, max(v % cast(power(10, n) as bigint)) as m from v cross join k group by p_brand, n)
select p_brand, max(n) as power from a where m = 0 group by p_brand"""


@sql_query("decimal_exact_places")
def decimal_exact_places(d):
    """The least number of places at which every value returns to itself."""
    return f"""
with k as (select n from {d.quote(7, 't', 'n')}),
a as (select p_type, n, min(case when round(p_retailprice * power(10, n)) / power(10, n) = p_retailprice then 1 else 0 end) as ok from part cross join k group by p_type, n)
select p_type, min(n) as places from a where ok = 1 group by p_type"""


@sql_query("dict_index_width")
def dict_index_width(d):
    """Bytes of a dictionary index by the number of entries."""
    return f"select col, kinds, case when kinds <= 256 then 1 when kinds <= 65536 then 2 else 4 end as width from (select col, count(distinct v) as kinds from {_texts(d)} t group by col) c"


@sql_query("record_pays")
def record_pays(d):
    """A transform is kept if its size is under 95% of the plain one."""
    return f"""
with t as (select col, sum(length(v)) as plain, sum(case when {d.like('v', INT)} then 2 else length(v) end) as image from {_texts(d)} t group by col)
select col, cast(plain as bigint) as plain, cast(image as bigint) as image, image < 0.95 * plain as pays from t"""


@sql_query("role_classify")
def role_classify(d):
    """Ordered patterns give a role; the first that fits."""
    return f"select p_partkey, case when {d.like('p_type', 'BRASS|COPPER')} then 'metal' when {d.like('p_type', '^STANDARD')} then 'standard' when {d.like('p_name', 'red|blue')} then 'coloured' else 'other' end as role from part"


@sql_query("canon_label")
def canon_label(d):
    """The first fitting pattern's label, else the value itself."""
    return f"select p_partkey, coalesce(case when {d.like('p_brand', '1$')} then 'first' when {d.like('p_brand', '2$')} then 'second' end, p_brand) as label from part"


@sql_query("fresh_rows")
def fresh_rows(d):
    """Rows younger than a time to live, seen from the newest row."""
    return f"select event_id from events cross join (select max({d.epoch_us('ts')}) as now from events) n where now - {d.epoch_us('ts')} < 86400000000"


@sql_query("refusal_counts")
def refusal_counts(d):
    """Each refused node under its first reason."""
    return """
select reason, count(*) as n from (select case when s_acctbal < 0 then 'no_budget' when s_nationkey % 5 = 0 then 'wrong_region' when s_suppkey % 7 = 0 then 'busy' else 'eligible' end as reason from supplier) t group by reason"""


@sql_query("label_valid")
def label_valid(d):
    """Labels that are not empty, not long, and of a subset of ASCII."""
    return f"select p_partkey, {d.like('p_name', '^[A-Za-z0-9 ._-]{1,64}$')} as valid from part"
