"""State that expires, replays and admissions, in their batch form; ``marlstone.streaming`` has the streams."""

from marlstone.functions.dialect import sql_query


@sql_query("current_links")
def current_links(d):
    """Newest sample of each link, if it has not outlived its time to live."""
    return f"""
with k as (select user_id, event_type, event_id, {d.epoch_us('ts')} as us, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events),
n as (select max(us) as now from k)
select user_id, event_type, event_id, now - us as age_us from k cross join n where k = 1 and now - us < 3 * 86400000000"""


@sql_query("idempotent_apply")
def idempotent_apply(d):
    """By (user, key): first use applied, same content cached, other content a conflict, an old sequence expired."""
    return """
with e as (select event_id, user_id, event_id % 50 as key, event_type, row_number() over (partition by user_id order by event_id) as seq from events),
k as (select event_id, user_id, key, event_type, seq, first_value(event_type) over (partition by user_id, key order by seq) as first_type, row_number() over (partition by user_id, key order by seq) as turn, min(seq) over (partition by user_id, key) as first_seq from e)
select event_id, case when turn = 1 then 'applied' when seq - first_seq > 200 then 'expired' when event_type = first_type then 'cached' else 'conflict' end as outcome from k"""


@sql_query("expired_leases")
def expired_leases(d):
    """Leases whose deadline passed before the user's next event renewed them."""
    return f"""
with e as (select event_id, user_id, {d.epoch_us('ts')} as us, lead({d.epoch_us('ts')}) over (partition by user_id order by ts, event_id) as next_us from events)
select event_id, user_id, us + 3600000000 as expired_us from e where next_us is null or next_us > us + 3600000000"""


@sql_query("admit_by_capacity")
def admit_by_capacity(d):
    """Requests in order while their pages, ceil(tokens / 16) + 1, fit."""
    return f"""
with p as (select user_id, event_id, {d.idiv('event_id % 500 + 15', '16')} + 1 as pages from events),
r as (select user_id, event_id, pages, sum(pages) over (partition by user_id order by event_id rows between unbounded preceding and current row) as used from p)
select user_id, event_id, pages, used <= 400 as admitted from r"""


@sql_query("event_histogram_windowed")
def event_histogram_windowed(d):
    """Cumulative bucket counts, sum and count by hour."""
    return f"""
select event_type, {d.idiv(d.epoch_us('ts'), '3600000000')} as hour, count(*) as n, round(cast(sum(cast(value as decimal(18, 4))) as double), 4) as total,
  cast(sum(case when value <= 1 then 1 else 0 end) as bigint) as le_1, cast(sum(case when value <= 10 then 1 else 0 end) as bigint) as le_10, cast(sum(case when value <= 100 then 1 else 0 end) as bigint) as le_100
from events where value is not null group by event_type, {d.idiv(d.epoch_us('ts'), '3600000000')}"""


@sql_query("event_tumbling")
def event_tumbling(d):
    """Counts by day and type."""
    return f"select {d.day('ts')} as day, event_type, count(*) as n, count(distinct user_id) as users from events group by {d.day('ts')}, event_type"


@sql_query("event_sessions")
def event_sessions(d):
    """Sessions of a user: events less than 30 minutes apart."""
    if d.spark:
        return "select user_id, unix_micros(cast(session_window.start as timestamp)) as start_us, count(*) as n from events group by user_id, session_window(ts, '30 minutes')"
    return """
with g as (select user_id, epoch_us(ts) as us, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 1800000000 then 0 else 1 end as new from events),
s as (select user_id, us, sum(new) over (partition by user_id order by us range between unbounded preceding and current row) as k from g)
select user_id, min(us) as start_us, count(*) as n from s group by user_id, k"""


@sql_query("lru_victim")
def lru_victim(d):
    """The entry used longest ago with nothing in flight."""
    return f"""
with e as (select user_id % 10 as pool, user_id, max({d.epoch_us('ts')}) as used, cast(sum(case when event_type = 'click' then 1 else 0 end) as bigint) % 3 as flights from events group by user_id % 10, user_id)
select pool, user_id from (select pool, user_id, row_number() over (partition by pool order by used, user_id) as k from e where flights = 0) t where k = 1"""


@sql_query("idle_reap")
def idle_reap(d):
    """Entries idle for at least the keep-alive time."""
    return f"""
with e as (select user_id, max({d.epoch_us('ts')}) as used from events group by user_id), n as (select max({d.epoch_us('ts')}) as now from events)
select user_id, now - used as idle_us from e cross join n where now - used >= 3600000000"""


@sql_query("latest_capability")
def latest_capability(d):
    """Newest observation of each node, eligible if ready and fresh."""
    return f"""
with k as (select user_id as node, event_id, event_type, {d.epoch_us('ts')} as us, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events), n as (select max(us) as now from k)
select node, event_id, event_type <> 'error' and now - us < 86400000000 as eligible from k cross join n where k = 1"""
