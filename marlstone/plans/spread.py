"""Plans whose groups may hold a large part of all rows: ranks, running counts and rolling windows spread over tasks."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import ranks
from marlstone.registry import query
from marlstone.sources.tables import table

OUTCOMES = ("view", "click", "purchase", "signup", "error", "timeout")
BOUNDS = (1.0, 5.0, 10.0, 50.0, 100.0, 1e18)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _rank(p: float):
    return F.ceil(F.col("n") * p)


@query("outcome_latency", """
with dom as (select unnest(['view', 'click', 'purchase', 'signup', 'error', 'timeout']) as outcome),
v as (select event_type as outcome, list_sort(list(value)) as v from events where value is not null group by event_type)
select outcome, coalesce(len(v), 0) as n, round(v[1], 6) as min_ms, round(v[-1], 6) as max_ms, round(v[ceil(len(v) * 0.5)::bigint], 6) as p50_ms,
  case when len(v) >= 20 then round(v[ceil(len(v) * 0.95)::bigint], 6) end as p95_ms, case when len(v) >= 100 then round(v[ceil(len(v) * 0.99)::bigint], 6) end as p99_ms from dom left join v using (outcome)""")
def outcome_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome counts over a fixed domain, zero-filled, with nearest-rank tails only where there are enough rows."""
    e = _events(spark, sf_dir).select(F.col("event_type").alias("outcome"), "value")
    tails = {"min_ms": F.lit(1), "max_ms": F.col("n"), "p50_ms": _rank(0.5), "p95_ms": F.when(F.col("n") >= 20, _rank(0.95)), "p99_ms": F.when(F.col("n") >= 100, _rank(0.99))}
    domain = spark.createDataFrame([(x,) for x in OUTCOMES], "outcome string")
    found = domain.join(ranks.nearest_rank(e, "outcome", "value", tails), "outcome", "left")
    return found.select("outcome", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *(F.round(c, 6).alias(c) for c in tails))


@query("summary_gated_tails", """
with v as (select user_id, list_sort(list(value)) as v from events where value is not null group by user_id)
select user_id, len(v) as n, round(v[1], 6) as lo, round((v[(len(v) + 1) // 2] + v[(len(v) + 2) // 2]) / 2, 6) as median, round(v[-1], 6) as hi,
  case when len(v) >= 20 then round(v[ceil(len(v) * 0.95)::bigint], 6) end as p95, case when len(v) >= 100 then round(v[ceil(len(v) * 0.99)::bigint], 6) end as p99 from v""")
def summary_gated_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, min, midpoint median, max; p95 from 20 values, p99 from 100, nearest rank."""
    tails = {"lo": F.lit(1), "m1": F.expr("(n + 1) div 2"), "m2": F.expr("(n + 2) div 2"), "hi": F.col("n"), "p95": F.when(F.col("n") >= 20, _rank(0.95)), "p99": F.when(F.col("n") >= 100, _rank(0.99))}
    r = ranks.nearest_rank(_events(spark, sf_dir), "user_id", "value", tails)
    return r.select("user_id", "n", F.round("lo", 6).alias("lo"), F.round((F.col("m1") + F.col("m2")) / 2, 6).alias("median"), F.round("hi", 6).alias("hi"), F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"))


@query("percentile_rounded", """
with v as (select event_type, list_sort(list(value)) as v from events where value is not null group by event_type)
select event_type, round(v[floor((len(v) - 1) * 0.5 + 0.5)::bigint + 1], 6) as p50, round(v[floor((len(v) - 1) * 0.9 + 0.5)::bigint + 1], 6) as p90 from v""")
def percentile_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element round((n - 1) p) of the sorted values."""
    at = lambda p: F.floor((F.col("n") - 1) * p + 0.5) + 1
    r = ranks.nearest_rank(_events(spark, sf_dir), "event_type", "value", {"p50": at(0.5), "p90": at(0.9)})
    return r.select("event_type", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))


@query("cumulative_histogram", """
with b as (select unnest([1.0, 5.0, 10.0, 50.0, 100.0, 1e18]::double[]) as le), t as (select distinct event_type from events)
select t.event_type, b.le, (select count(*) from events e where e.event_type = t.event_type and e.value <= b.le) as n from t, b""")
def cumulative_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts up to and including each bound, the unbounded one last: one count for each bound in one aggregation."""
    counts = [F.count(F.when(F.col("value") <= le, 1)).alias(str(k)) for k, le in enumerate(BOUNDS)]
    pairs = F.array(*(F.struct(F.lit(le).alias("le"), F.col(str(k)).alias("n")) for k, le in enumerate(BOUNDS)))
    return _events(spark, sf_dir).groupBy("event_type").agg(*counts).select("event_type", F.explode(pairs).alias("x")).select("event_type", "x.le", "x.n")


@query("first_seen_id", "select user_id, min(event_id) as first_at, row_number() over (order by min(event_id)) - 1 as id from events group by user_id")
def first_seen_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary ids by first appearance."""
    first = _events(spark, sf_dir).groupBy("user_id").agg(F.min("event_id").alias("first_at"))
    return ranks.numbered(first, ["first_at"], "k").select("user_id", "first_at", (F.col("k") - 1).alias("id"))


@query("rolling_2min", """
select a.event_id, count(*) as n from events a join events b on a.event_type = b.event_type and b.ts <= a.ts and b.ts >= a.ts - interval 120 seconds group by a.event_id""")
def rolling_2min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same type in the last two minutes, this one included."""
    e = _events(spark, sf_dir).select("event_id", "event_type", F.expr("unix_micros(cast(ts as timestamp))").alias("us"))
    return ranks.counted_within(e, "event_type", "us", 120_000_000, "n").select("event_id", "n")


@query("stride_holdout", """
select source, doc_id, k // 3 as turn, k // 3 % 8 = 7 as held_out from (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as k from documents) where k % 3 = 0""")
def stride_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row of a source; each eighth of those is held out."""
    r = ranks.numbered(table(spark, sf_dir, "documents").select("source", "doc_id"), ["doc_id"], "k", ["source"]).where("(k - 1) % 3 = 0")
    return r.select("source", "doc_id", F.expr("(k - 1) div 3").alias("turn"), F.expr("(k - 1) div 3 % 8 = 7").alias("held_out"))


@query("round_robin_mix", """
with r as (select lang, doc_id, row_number() over (partition by lang order by doc_id) as turn from documents)
select turn, lang, doc_id, row_number() over (partition by turn order by lang) as place from r""")
def round_robin_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each language in turn."""
    r = ranks.numbered(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["doc_id"], "turn", ["lang"])
    return r.withColumn("place", F.row_number().over(Window.partitionBy("turn").orderBy("lang")).cast("long"))


@query("interleave_kinds", """
with r as (select event_id, user_id % 2 as kind, row_number() over (partition by user_id % 2 order by event_id) - 1 as k, count(*) over (partition by user_id % 2) as n from events),
m as (select max(n) as longest from r),
laps as (select r.*, unnest(range(0, (longest + n - 1) // n)) as lap, longest from r, m),
p as (select event_id, kind, lap, lap * n + case when kind = 0 then k else (n - 1 - k + 8) % n end as place_at from laps where lap * n + case when kind = 0 then k else (n - 1 - k + 8) % n end < longest)
select event_id, kind, lap, place_at // 16 * 2 + kind as slot, place_at % 16 as place from p""")
def interleave_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of two kinds in turn; the second runs backwards and starts half a chunk later. The shorter kind
    is run through again, lap by lap, until the longer one ends."""
    r = ranks.numbered(_events(spark, sf_dir).select("event_id", F.expr("user_id % 2").alias("kind")), ["event_id"], "k", ["kind"])
    sizes = r.groupBy("kind").agg(F.count("*").alias("n"))
    sizes = sizes.crossJoin(sizes.agg(F.max("n").alias("longest")))
    r = r.join(F.broadcast(sizes), "kind").withColumn("lap", F.explode(F.expr("sequence(0L, (longest + n - 1) div n - 1)")))
    r = r.withColumn("at", F.expr("lap * n + case when kind = 0 then k - 1 else (n - k + 8) % n end")).where("at < longest")
    return r.select("event_id", "kind", "lap", F.expr("at div 16 * 2 + kind").alias("slot"), F.expr("at % 16").alias("place"))


@query("topk_per_group_vs_global", """
with c as (select l_linenumber as layer, l_suppkey as expert, count(*) as n from lineitem group by all),
g as (select l_suppkey as expert, row_number() over (order by count(*) desc, l_suppkey) as overall from lineitem group by l_suppkey)
select layer, expert, k, n, overall from (select *, row_number() over (partition by layer order by n desc, expert) as k from c) join g using (expert) where k <= 10""")
def topk_per_group_vs_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most used per group beside the most used overall."""
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("layer"), F.col("l_suppkey").alias("expert")).agg(F.count("*").alias("n"))
    total = used.groupBy("expert").agg((-F.sum("n")).alias("minus"))
    overall = ranks.numbered(total, ["minus", "expert"], "overall").select("expert", "overall")
    top = used.withColumn("k", F.row_number().over(Window.partitionBy("layer").orderBy(F.col("n").desc(), "expert")).cast("long")).where("k <= 10")
    return top.join(overall, "expert").select("layer", "expert", "k", "n", "overall")


@query("layout_join", """
with p as (select p_partkey, p_brand, p_type, p_size, p_partkey % 2 as version, row_number() over (partition by p_brand, p_type, p_size, p_partkey % 2 order by p_partkey) as part from part)
select a.p_partkey as old_key, b.p_partkey as new_key, a.p_size from p a join p b on a.version = 0 and b.version = 1 and a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_size = b.p_size and a.part = b.part""")
def layout_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of two versions with the same name and layout, one to one (equal names by their place)."""
    name = ["p_brand", "p_type", "p_size"]
    p = table(spark, sf_dir, "part").select("p_partkey", *name, (F.col("p_partkey") % 2).alias("version"))
    p = p.withColumn("part", F.row_number().over(Window.partitionBy(*name, "version").orderBy("p_partkey")))
    side = lambda v, key: p.where(F.col("version") == v).select(*name, "part", F.col("p_partkey").alias(key))
    return side(0, "old_key").join(side(1, "new_key"), [*name, "part"]).select("old_key", "new_key", "p_size")
