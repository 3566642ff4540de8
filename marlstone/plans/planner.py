"""Choices by cost over small tables of devices, levels and layers."""

from marlstone.functions.dialect import sql_query

LEVELS = "levels as (select 1 as level, 16.0 as bits union all select 2, 12.0 union all select 3, 6.5 union all select 4, 5.5 union all select 5, 4.0)"
CONTEXTS = "contexts as (select 4096 as ctx union all select 8192 union all select 16384 union all select 32768 union all select 65536 union all select 131072)"
DEVICES = "devices as (select s_suppkey as device, greatest(s_acctbal, 0) * 4 as free_mb, 100 + s_suppkey % 900 as gbps from supplier)"


@sql_query("plan_ladder")
def plan_ladder(d):
    """The best level that fits one device, else a split, else host memory, else a reason."""
    return f"""
with {LEVELS}, {DEVICES},
t as (select device, level, bits * 1000 as need, free_mb from devices cross join levels),
p as (select device, level, case when need <= free_mb then 'one' when need <= 2 * free_mb then 'split' when need <= 4 * free_mb then 'host' else 'none' end as place from t),
k as (select device, level, place, row_number() over (partition by device order by case place when 'one' then 0 when 'split' then 1 when 'host' then 2 else 3 end, level) as k from p)
select device, level, place from k where k = 1"""


@sql_query("largest_context")
def largest_context(d):
    """The largest context of a fixed list under the budget."""
    return f"with {CONTEXTS}, {DEVICES} select device, max(ctx) as ctx from devices left join contexts on ctx * 0.25 <= free_mb group by device"


@sql_query("predicted_rate")
def predicted_rate(d):
    """Bandwidth x efficiency over bytes read, with a cache hit share of (cache / experts)^0.23."""
    return f"with {DEVICES} select device, round(gbps * 0.7 / (8 * (1 - power(least(1.0, free_mb / 40000), 0.23)) + 1), 6) as rate from devices"


STAGES = "stages as (select p_brand as node, cast(p_size as bigint) as layer, p_partkey % 3 as pool, p_partkey % 1000 as bytes, case when p_partkey % 97 = 0 then null else p_partkey % 500 end as us from part)"


@sql_query("stage_cost")
def stage_cost(d):
    """Cost of a range of layers: sums by pool; a missing time makes the sum null."""
    return f"with {STAGES} select node, pool, cast(sum(bytes) as bigint) as bytes, case when count(*) = count(us) then cast(sum(us) as bigint) end as us from stages where layer between 10 and 30 group by node, pool"


@sql_query("placement_score")
def placement_score(d):
    """Latency (sum) and throughput (bottleneck) scores of a placement."""
    return f"with {STAGES}, s as (select node, pool, sum(us) as us from stages where us is not null group by node, pool) select node, cast(sum(us) * 64 as bigint) as latency, cast(max(us) as bigint) as bottleneck from s group by node"


@sql_query("tier_cost")
def tier_cost(d):
    """Whole microseconds, rounded up, of bytes over each tier's rate."""
    up = lambda a, b: d.idiv(f"{a} + {b} - 1", b)
    return f"with {STAGES}, b as (select node, cast(sum(bytes) as bigint) * 1000000 as x from stages group by node) select node, {up('x', '900000')} as memory_us, {up('x', '7000')} as storage_us, {up('x', '900000')} + {up('x', '7000')} + 120 as total_us from b"


@sql_query("layer_cut")
def layer_cut(d):
    """The cut between two machines with the smallest worst ratio of need to free memory."""
    return f"""
with {STAGES}, l as (select node, layer, sum(bytes) as b from stages group by node, layer),
c as (select node, layer, sum(b) over (partition by node order by layer rows between unbounded preceding and current row) as low, sum(b) over (partition by node) as total from l),
r as (select node, layer, greatest(low / 20000.0, (total - low) / 12000.0) as ratio from c where low <= 20000 and total - low <= 12000),
k as (select node, layer, ratio, row_number() over (partition by node order by round(cast(ratio as double), 9), layer) as k from r),
nodes as (select distinct node from stages)
select nodes.node, k.layer, round(cast(k.ratio as double), 6) as ratio from nodes left join k on nodes.node = k.node and k.k = 1"""


@sql_query("cost_profile")
def cost_profile(d):
    """Resident and active bytes of each layer."""
    return f"with {STAGES} select layer, cast(sum(bytes) as bigint) as resident, cast(sum(case when pool = 0 then bytes else {d.idiv('bytes', '8')} end) as bigint) as active from stages group by layer"


@sql_query("tier_prediction")
def tier_prediction(d):
    """Sum of bytes over rates; a tier that is read but has no rate makes the result null."""
    return f"""
with {STAGES}, rates as (select 0 as pool, 900.0 as rate union all select 1, 60.0 union all select 2, null),
t as (select node, s.pool, sum(bytes) as b, max(rate) as rate from stages s join rates r on s.pool = r.pool where layer <= 5 + length(node) % 3 group by node, s.pool)
select node, case when count(*) = count(rate) then round(cast(sum(b / rate) as double), 6) end as serial, case when count(*) = count(rate) then round(cast(max(b / rate) as double), 6) end as overlapped from t group by node"""


@sql_query("placement_traffic")
def placement_traffic(d):
    """Bytes per tier of each placement from clamped shares."""
    return f"""
with {DEVICES}, places as (select 'gpu' as place, 1.0 as hit, 1.0 as gpu union all select 'host', 0.6, 0.4 union all select 'disk', 0.3, 0.2)
select device, place, round(1000 * least(1.0, greatest(0.0, hit * gpu)), 6) as gpu_mb, round(1000 * least(1.0, greatest(0.0, hit - hit * gpu)), 6) as ram_mb, round(1000 * least(1.0, greatest(0.0, 1 - hit)), 6) as disk_mb from devices cross join places""".replace("1000 *", "cast(1000 as double) *")


@sql_query("fit_check")
def fit_check(d):
    """Weights, cache and runtime against memory; cache = full x context + sliding x min(context, window)."""
    return f"with {CONTEXTS}, {DEVICES} select device, ctx, 4000 + 0.1 * ctx + 0.05 * least(ctx, 8192) + 500 <= free_mb as fits from devices cross join contexts"


@sql_query("layout_pick")
def layout_pick(d):
    """Of two layouts of one model, the one is dropped where the other exists."""
    return """
with f as (select p_brand as model, p_type as file, p_partkey % 2 = 0 as sharded from part), g as (select model, max(case when sharded then 1 else 0 end) as any_sharded from f group by model)
select f.model, count(*) as files from f join g on f.model = g.model where sharded or any_sharded = 0 group by f.model"""
