"""Gates over repeated runs, and the draw behind a drafted token. The oracles are written apart from the plans."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.registry import query
from marlstone.sources.tables import table

#: Deviations from the base that a change may have, the least band, and sessions from which their spread counts.
Z, FLOOR, SESSIONS = 3.0, 0.003, 3
#: Paired repeats that a comparison needs.
REPEATS = 5
#: (metric, higher is better, a speed).
METRICS = (("view", True, True), ("click", True, True), ("purchase", True, False), ("signup", True, False), ("error", False, True))


def metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METRICS, "metric string, higher boolean, speed boolean")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, sys, repeat, value): six repeats of two systems, from events by user."""
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.groupBy(F.col("event_type").alias("metric"), F.expr("case when user_id % 2 = 0 then 'base' else 'cand' end").alias("sys"), F.expr("(user_id div 2) % 6").alias("repeat")).agg(F.avg("value").alias("value"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, session, value): earlier sessions of the base system, from events by user."""
    e = table(spark, sf_dir, "events").where("value is not null and user_id % 2 = 0")
    return e.groupBy(F.col("event_type").alias("metric"), F.expr("user_id % 14").alias("session")).agg(F.avg("value").alias("value"))


def judge(cells: DataFrame, history: DataFrame, directions: DataFrame, z: float = Z, floor: float = FLOOR) -> DataFrame:
    """One row per metric: (metric, base, cand, worse, band, source, regressed).

    ``cells`` are runs (metric, sys, repeat, value). Medians are compared; worse is the change in the bad direction
    as a fraction of the base. The band is the widest of: z standard errors of the difference of two
    medians, the floor, and, from SESSIONS sessions on, z deviations of the sessions' means for one more session.
    """
    c = cells.groupBy("metric", "sys").agg(F.median("value").alias("med"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))
    c = c.withColumn("rel", F.when((F.col("mean") != 0) & F.col("sd").isNotNull(), F.col("sd") / F.col("mean")).otherwise(0.0))
    side = lambda name: c.where(F.col("sys") == name).select("metric", *(F.col(x).alias(f"{x}_{name}") for x in ("med", "rel", "n")))
    h = history.groupBy("metric").agg(F.count("*").alias("k"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    j = side("base").join(side("cand"), "metric").join(directions, "metric").join(h, "metric", "left")
    within = z * 1.25 * F.sqrt(F.pow("rel_base", F.lit(2)) / F.col("n_base") + F.pow("rel_cand", F.lit(2)) / F.col("n_cand"))
    across = F.when(F.col("k") >= SESSIONS, z * F.col("s") / F.greatest(F.abs("m"), F.lit(1e-12)) * F.sqrt(1 + 1 / F.col("k")))
    j = j.withColumn("near", F.greatest(within, F.lit(floor))).withColumn("far", across)
    spread = F.coalesce(F.col("far") > F.col("near"), F.lit(False))
    j = j.withColumn("band", F.when(spread, F.col("far")).otherwise(F.col("near")))
    change = (F.col("med_base") - F.col("med_cand")) / F.col("med_base")
    j = j.withColumn("worse", F.when(F.col("higher"), change).otherwise(-change))
    source = F.when(spread, "sessions").when(within >= floor, "runs").otherwise("floor")
    return j.select("metric", F.round("med_base", 6).alias("base"), F.round("med_cand", 6).alias("cand"), F.round("worse", 6).alias("worse"), F.round("band", 6).alias("band"), source.alias("source"), (F.col("worse") > F.col("band")).alias("regressed"))


_RUNS = "r as (select event_type as metric, case when user_id % 2 = 0 then 'base' else 'cand' end as sys, (user_id // 2) % 6 as repeat, avg(value) as value from events where value is not null group by all)"
_DIRECTIONS = "d(metric, higher, speed) as (values ('view', true, true), ('click', true, true), ('purchase', true, false), ('signup', true, false), ('error', false, true))"


@query("regression_gate", f"""
with {_RUNS}, {_DIRECTIONS},
hist as (select event_type as metric, user_id % 14 as session, avg(value) as value from events where value is not null and user_id % 2 = 0 group by all),
h as (select metric, count(*) as k, avg(value) as m, stddev_samp(value) as s from hist group by metric),
x as (select metric,
    quantile_cont(value, 0.5) filter (sys = 'base') as mb, quantile_cont(value, 0.5) filter (sys = 'cand') as mc,
    3.0 * 1.25 * sqrt(pow(coalesce(stddev_samp(value) filter (sys = 'base') / avg(value) filter (sys = 'base'), 0), 2) / count(*) filter (sys = 'base')
                    + pow(coalesce(stddev_samp(value) filter (sys = 'cand') / avg(value) filter (sys = 'cand'), 0), 2) / count(*) filter (sys = 'cand')) as within
  from r group by metric having count(*) filter (sys = 'base') > 0 and count(*) filter (sys = 'cand') > 0),
y as (select x.*, d.higher, greatest(within, 0.003) as near, case when k >= 3 then 3.0 * s / greatest(abs(m), 1e-12) * sqrt(1 + 1.0 / k) end as far from x join d using (metric) left join h using (metric)),
z as (select *, coalesce(far > near, false) as wide, case when higher then mb - mc else mc - mb end / mb as worse from y)
select metric, round(mb, 6) as base, round(mc, 6) as cand, round(worse, 6) as worse, round(if(wide, far, near), 6) as band,
  case when wide then 'sessions' when within >= 0.003 then 'runs' else 'floor' end as source, worse > if(wide, far, near) as regressed from z""")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which metrics of the candidate are worse than the base by more than the runs and sessions spread."""
    return judge(runs(spark, sf_dir), sessions(spark, sf_dir), metrics(spark))


def wins(cells: DataFrame, directions: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """One row per metric: (metric, pairs, status, reason).

    The candidate wins if both systems have the same repeats, at least ``repeats`` of them, its worst run
    is better than the base's best, and, for speeds, its median is better by a tenth.
    """
    c = cells.groupBy("metric").pivot("sys", ["base", "cand"]).agg(F.collect_set("repeat").alias("keys"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.median("value").alias("med"))
    paired = (F.size(F.array_except("base_keys", "cand_keys")) == 0) & (F.size(F.array_except("cand_keys", "base_keys")) == 0) & (F.size("base_keys") >= repeats)
    apart = F.when(F.col("higher"), F.col("cand_lo") > F.col("base_hi")).otherwise(F.col("cand_hi") < F.col("base_lo"))
    margin = ~F.col("speed") | F.when(F.col("higher"), 10 * F.col("cand_med") >= 11 * F.col("base_med")).otherwise(10 * F.col("cand_med") <= 9 * F.col("base_med"))
    won = F.coalesce(apart & margin, F.lit(False))
    ok = F.coalesce(paired, F.lit(False))
    return c.join(directions, "metric").select(
        "metric", F.size(F.array_intersect("base_keys", "cand_keys")).cast("long").alias("pairs"), F.when(~ok, "unavailable").when(won, "won").otherwise("lost").alias("status"),
        F.when(~ok, f"at least {repeats} paired repeats required").when(won, "rule satisfied").otherwise("rule not satisfied").alias("reason"))


@query("win_rule", f"""
with {_RUNS}, {_DIRECTIONS},
b as (select * from r where sys = 'base'), c as (select * from r where sys = 'cand'),
p as (select metric, count(b.value) as nb, count(c.value) as nc, count(*) filter (b.value is not null and c.value is not null) as pairs,
    min(b.value) as blo, max(b.value) as bhi, quantile_cont(b.value, 0.5) as bmed, min(c.value) as clo, max(c.value) as chi, quantile_cont(c.value, 0.5) as cmed
  from b full join c using (metric, repeat) group by metric),
w as (select metric, pairs, pairs >= 5 and nb = pairs and nc = pairs as ok,
    case when higher then clo > bhi and (not speed or cmed * 10 >= bmed * 11) else chi < blo and (not speed or cmed * 10 <= bmed * 9) end as won from p join d using (metric))
select metric, pairs, case when not ok then 'unavailable' when won then 'won' else 'lost' end as status,
  case when not ok then 'at least 5 paired repeats required' when won then 'rule satisfied' else 'rule not satisfied' end as reason from w""")
def win_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the candidate wins each metric."""
    return wins(runs(spark, sf_dir), metrics(spark))


def check_draft(rows: DataFrame) -> DataFrame:
    """(row_id, draft, p_draft, accepted, token_id) from rows (row_id, token_id, p, draft, u, v).

    The drafted token is kept if u lies under its probability; else a token is drawn from the others: the
    first, by falling probability, then token, at which their running sum reaches v of their total. A
    draft that is the only token stays.
    """
    rest = Window.partitionBy("row_id").orderBy(F.col("p").desc(), "token_id").rowsBetween(Window.unboundedPreceding, 0)
    other = F.when(F.col("token_id") != F.col("draft"), F.col("p")).otherwise(0.0)
    r = rows.withColumn("cum", F.sum(other).over(rest)).withColumn("total", F.sum(other).over(Window.partitionBy("row_id")))
    drawn = F.when((F.col("token_id") != F.col("draft")) & (F.round(F.col("cum") - F.col("v") * F.col("total"), 12) >= 0), F.struct("cum", "token_id"))
    g = r.groupBy("row_id", "draft", "u").agg(F.max(F.when(F.col("token_id") == F.col("draft"), F.col("p"))).alias("p"), F.min(drawn).alias("drawn"))
    accepted = F.coalesce((F.col("p") > 0) & (F.col("u") < F.col("p")), F.lit(False))
    return g.select("row_id", "draft", F.round(F.coalesce("p", F.lit(0.0)), 6).alias("p_draft"), accepted.alias("accepted"), F.when(accepted, F.col("draft")).otherwise(F.coalesce("drawn.token_id", "draft")).alias("token_id"))


@query("draft_accept", """
with l as (select vec_id as row_id, unnest(range(0, len(embedding))) as token_id, unnest(embedding)::double as x from embeddings),
p as (select row_id, token_id, exp(x) / sum(exp(x)) over (partition by row_id) as p, row_id % 64 as draft, (row_id * 104729 % 1000) / 1000.0 as u, (row_id * 7919 % 997) / 997.0 as v from l),
kept as (select row_id, draft, p as p_draft, u < p as accepted from p where token_id = draft),
others as (select row_id, token_id, v, sum(p) over (partition by row_id order by p desc, token_id rows unbounded preceding) as cum, sum(p) over (partition by row_id) as total from p where token_id <> draft),
drawn as (select row_id, arg_min(token_id, cum) as token_id from others where round(cum - v * total, 12) >= 0 group by row_id)
select kept.row_id, kept.draft, round(p_draft, 6) as p_draft, accepted, case when accepted then kept.draft else coalesce(drawn.token_id, kept.draft) end as token_id from kept left join drawn using (row_id)""")
def draft_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drafted token for each row of logits, checked against its distribution."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("token_id", "x"))
    own = Window.partitionBy("row_id")
    e = e.withColumn("e", F.exp(F.col("x").cast("double") - F.max(F.col("x").cast("double")).over(own)))
    rows = e.select("row_id", F.col("token_id").cast("long").alias("token_id"), (F.col("e") / F.sum("e").over(own)).alias("p"), (F.col("row_id") % 64).alias("draft"),
                    (F.col("row_id") * 104729 % 1000 / 1000).alias("u"), (F.col("row_id") * 7919 % 997 / 997).alias("v"))
    return check_draft(rows)
