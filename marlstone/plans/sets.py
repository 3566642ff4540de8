"""Joins, lookups, set operations and deduplication."""

from marlstone.functions.dialect import sql_query
from marlstone.plans.ordered import CHAIN, depths


@sql_query("latest_by_name")
def latest_by_name(d):
    """The last id of each name."""
    return "select source as name, lang, max(doc_id) as id from documents group by source, lang"


@sql_query("arm_coverage_anti")
def arm_coverage_anti(d):
    """Ids of one side that the other lacks."""
    return """
select coalesce(a.doc_id, b.doc_id) as id, case when a.doc_id is null then 'unexpected' when b.doc_id is null then 'missing' end as problem
from (select doc_id from documents) a full join (select distinct doc_id from labels) b on a.doc_id = b.doc_id where a.doc_id is null or b.doc_id is null"""


@sql_query("range_route")
def range_route(d):
    """The first row whose range holds the value."""
    return """
with r as (select 1 as id, 0 as lo, 10 as hi union all select 2, 5, 20 union all select 3, 20, 51),
j as (select p_partkey, id, row_number() over (partition by p_partkey order by id) as k from part join r on p_size >= lo and p_size < hi)
select p_partkey, id from j where k = 1"""


def _pairs(d) -> str:
    return "nl as (select a.n_nationkey as src, b.n_nationkey as dst from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey where (a.n_nationkey * 7 + b.n_nationkey) % 3 <> 0)"


@sql_query("missing_links")
def missing_links(d):
    """Directed links that a placement needs and the table lacks."""
    return f"with {_pairs(d)}, need as (select a.n_nationkey as src, b.n_nationkey as dst from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey) select need.src, need.dst from need left join nl on need.src = nl.src and need.dst = nl.dst where nl.src is null"


@sql_query("missing_evidence")
def missing_evidence(d):
    """References without a row."""
    return "select o_orderkey, o_custkey from orders o where not exists (select 1 from customer c where c.c_custkey = o.o_custkey and c.c_acctbal >= 0)"


@sql_query("union_unexpired")
def union_unexpired(d):
    """Members and previous records that have not expired."""
    return "select c_custkey as id, 'member' as kind from customer where c_nationkey < 12 union all select c_custkey, 'previous' from customer where c_nationkey >= 12 and c_acctbal > 5000"


@sql_query("duplicate_keys")
def duplicate_keys(d):
    """Keys that occur more than once."""
    return f"select {d.sha('text')} as digest, count(*) as n, min(doc_id) as first_id from documents group by {d.sha('text')} having count(*) > 1"


@sql_query("id_set_diff")
def id_set_diff(d):
    """Both differences of two sets of ids."""
    return "select id, 'only_a' as side from (select o_custkey as id from orders except select c_custkey from customer where c_nationkey < 20) a union all select id, 'only_b' from (select c_custkey as id from customer where c_nationkey < 20 except select o_custkey from orders) b"


@sql_query("common_configs")
def common_configs(d):
    """Settings measured for every member of a class."""
    return """
with m as (select distinct p_type as class, p_size % 10 as config, p_brand from part), n as (select class, count(distinct p_brand) as members from m group by class)
select m.class, config, count(*) as members from m join n on m.class = n.class group by m.class, config, n.members having count(*) >= n.members * 0.6"""


@sql_query("replay_conflicts")
def replay_conflicts(d):
    """The same key again: with the same content a replay, with other content a conflict."""
    return """
with k as (select user_id, event_type, props, event_id, row_number() over (partition by user_id, event_type, props order by event_id) as turn, first_value(value) over (partition by user_id, event_type, props order by event_id) as v, value from events)
select event_id, case when turn = 1 then 'accepted' when value = v then 'replay' else 'conflict' end as outcome from k"""


@sql_query("log_compaction")
def log_compaction(d):
    """The newest line of an id stands; a deleting line removes it."""
    return """
with log as (select o_custkey as id, o_orderkey as seq, o_orderstatus as state from orders),
k as (select id, seq, state, row_number() over (partition by id order by seq desc) as k from log)
select id, seq, state from k where k = 1 and state <> 'F'"""


@sql_query("gc_reachable")
def gc_reachable(d):
    """Objects that are live, or that a live object's chain of bases needs."""
    return f"""
with {CHAIN}, {depths(d)}, need as (select dd.root, max(dd.depth) as depth from dd join chain c on dd.id = c.id where not c.deleted group by dd.root)
select dd.id from dd join need on dd.root = need.root and dd.depth <= need.depth"""


