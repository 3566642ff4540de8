"""Queries over the numeric kernels, ordered folds, file readers and streams."""

from __future__ import annotations

import functools
import gzip
import io
import json
import struct
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.dialect import DUCK
from marlstone.operators import kernels as K
from marlstone.operators import ranks, training
from marlstone.plans import stateful
from marlstone.registry import QUERIES, query
from marlstone.sources import files
from marlstone.sources.tables import table
from marlstone.streaming import events as S


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("mtf_rank")
def mtf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency rank of each user's event values."""
    return K.mtf_rank(_events(spark, sf_dir), "user_id", ["event_id"], "props")


@query("huffman_bits")
def huffman_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of an optimal prefix code of each type's props."""
    return K.huffman_bits(_events(spark, sf_dir), "event_type", "props")


@query("quantise_runs")
def quantise_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in runs of 32 with scale and codes of three to six bits."""
    return functools.reduce(DataFrame.unionAll, [K.quantise_runs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", bits).withColumn("bits", F.lit(bits)) for bits in (3, 4, 5, 6)])


@query("lloyd_max")
def lloyd_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codebook of eight levels for each label's entries."""
    return K.codebooks(table(spark, sf_dir, "embeddings"), "label", "embedding")


@query("hadamard_embeddings")
def hadamard_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with random signs, rotated."""
    return K.rotate(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("greedy_budget")
def greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upgrades by gain per cost within a budget, for each brand."""
    part = table(spark, sf_dir, "part")
    options = part.select("p_brand", F.col("p_partkey").alias("item"), F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("level"), (F.col("p_size") * k).cast("double").alias("cost"), (F.col("p_retailprice") / (k + 1)).alias("gain")) for k in (1, 2, 3)])).alias("o"))
    return K.allocate(options.select("p_brand", "item", "o.level", "o.cost", "o.gain"), "p_brand", 2000.0)


@query("cache_replay")
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of LRU and LFU caches over each line number's supplier trace, from a profile of the most used suppliers."""
    lineitem = table(spark, sf_dir, "lineitem")
    uses = lineitem.groupBy("l_linenumber", "l_suppkey").agg(F.count("*").alias("n"))
    top = uses.withColumn("k", F.row_number().over(Window.partitionBy("l_linenumber").orderBy(F.col("n").desc(), "l_suppkey"))).where("k <= 16")
    seeds = top.groupBy("l_linenumber").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("seed"))
    return K.replay_cache(lineitem, "l_linenumber", ["l_orderkey", "l_partkey"], "l_suppkey", seeds=seeds)


@query("prefix_cache_hits")
def prefix_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each document's prompt found in its source's prefix cache."""
    return K.prefix_cache(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query("longest_prefix", """
with w as (select doc_id, source, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+') as w from documents),
p as (select doc_id, source, unnest(range(1, len(w) // 16 + 1)) as n, w from w), k as (select doc_id, source, n, array_to_string(w[1:n * 16], ' ') as key from p),
f as (select source, key, min(doc_id) as first_id from k group by source, key)
select w.doc_id, coalesce(max(n) filter (first_id < w.doc_id), 0)::bigint as pages from w left join k on w.doc_id = k.doc_id left join f on k.source = f.source and k.key = f.key group by w.doc_id""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of 16-word pages from the start that an earlier document of the source has, by chained digests."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \t\n\r]+"), F.lit(0))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", words.alias("w"))
    pages = d.select("doc_id", "source", F.expr("transform(case when size(w) >= 16 then sequence(1, size(w) div 16) else array() end, n -> array_join(slice(w, n * 16 - 15, 16), ' '))").alias("p"))
    chain = F.expr("aggregate(p, cast(array() as array<string>), (a, x) -> array_append(a, sha2(concat(coalesce(try_element_at(a, -1), ''), x), 256)))")
    keys = pages.select("doc_id", "source", F.posexplode(chain).alias("n", "key"))
    first = keys.groupBy("source", "key").agg(F.min("doc_id").alias("first_id"))
    found = keys.join(first, ["source", "key"]).where("first_id < doc_id").groupBy("doc_id").agg((F.max("n") + 1).cast("long").alias("pages"))
    return d.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("pages", F.lit(0).cast("long")).alias("pages"))


VERBS = ["prepare", "commit", "done", "release", "drained"]


@query("admission_fsm")
def admission_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as steps of a two-phase admission with a deadline of a day."""
    e = _events(spark, sf_dir)
    verb = F.when(F.col("event_type") == "error", "abort").otherwise(F.element_at(F.array(*map(F.lit, VERBS)), (F.col("event_id") % 5 + 1).cast("int")))
    return K.admissions(e.select("user_id", "event_id", verb.alias("verb"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), "user_id", ["event_id"], "verb", "us", 86_400_000_000)


def _requests(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("user_id", F.col("event_id").alias("id"), (F.col("event_id") % 97 + 8).alias("prompt"), (F.col("event_id") % 13 + 1).alias("new"))


@query("batch_simulation")
def batch_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous batching of each user's requests."""
    return K.simulate_batches(_requests(spark, sf_dir), "user_id").drop("preempted")


@query("preempt_newest")
def preempt_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each request gave its pages back under a small page pool."""
    return K.simulate_batches(_requests(spark, sf_dir), "user_id", 12).select("user_id", "id", "preempted")


@query("queue_assign")
def queue_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests of each day start under limits by client and model."""
    e = _events(spark, sf_dir)
    return K.assign_queues(e.select(F.to_date("ts").cast("string").alias("day"), F.col("event_id").alias("id"), F.col("user_id").alias("client"), (F.col("event_id") % 5).alias("model")), "day")


@query("change_point_cut")
def change_point_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to cut each document's bytes in two parts of different statistics."""
    return K.change_points(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("grid_calibrate")
def grid_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power law of price over quantity for each return flag."""
    return K.calibrate(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")


@query("partition_search")
def partition_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous cuts of each brand's layers (one for each size) over up to three nodes, best five."""
    part = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.sum("p_retailprice").alias("bytes"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        size = f.sort_values("p_size")["bytes"].to_numpy(float)
        room = {1: size.sum() * 0.6, 2: size.sum() * 0.5, 3: size.sum() * 0.4}
        best = K.partitions(size, {1: 3.0, 2: 2.0, 3: 1.0}, room, keep=5)
        return pd.DataFrame({"p_brand": f["p_brand"].iloc[0], "place": range(len(best)), "score": [round(b, 4) for b, _ in best], "cuts": [c for _, c in best]})

    return part.groupBy("p_brand").applyInPandas(run, "p_brand string, place long, score double, cuts string")


@query("paired_interval")
def paired_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact limits, a quarter of 5% in each tail, of the shares of items that a candidate harms and gains in each language."""
    g = QUERIES["paired_harm_gain"](spark, sf_dir)

    def run(frames):
        for f in frames:
            for kind in ("harm", "gain"):
                limits = [K.clopper_pearson(int(k), int(n), 0.0125) for k, n in zip(f[kind], f["n"], strict=True)]
                f = f.assign(**{f"{kind}_low": [round(a, 6) for a, _ in limits], f"{kind}_high": [round(b, 6) for _, b in limits]})
            yield f

    return g.mapInPandas(run, "grp string, n long, harm long, gain long, harm_low double, harm_high double, gain_low double, gain_high double")


@query("bpe_merges", """
with w as (select unnest(regexp_extract_all(p_name, '[a-z]+')) as word from part),
q as (select substr(word, 1, k::int) as piece, 1 as n from w, range(1, 6) r(k) where length(word) >= k union all select chr(96 + k::int), 0 from range(1, 27) r(k)),
p as (select piece, sum(n)::bigint as n from q group by piece),
v as (select row_number() over (order by n desc, piece) as id, piece, n::double as score from p),
c as (select v.id, v.score, substr(v.piece, 1, k::int) as l, substr(v.piece, k::int + 1) as r from v, range(1, 6) t(k) where k < length(v.piece)),
m as (select c.*, a.id as lid, b.id as rid from c join v a on a.piece = c.l join v b on b.piece = c.r)
select row_number() over (order by score desc, length(l) desc, length(r) desc, id, lid, rid) as rank, l as "left", r as "right" from m""")
def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of a vocabulary of word beginnings, scored by their counts."""
    words = table(spark, sf_dir, "part").select(F.explode(F.expr("regexp_extract_all(p_name, '[a-z]+', 0)")).alias("w"))
    begins = words.select(F.explode(F.expr("transform(sequence(1, least(length(w), 5)), k -> substring(w, 1, k))")).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    letters = spark.createDataFrame([(chr(97 + k), 0) for k in range(26)], "piece string, n long")
    pieces = begins.unionAll(letters).groupBy("piece").agg(F.sum("n").alias("n"))
    ids = ranks.numbered(pieces.withColumn("minus", -F.col("n")), ["minus", "piece"], "id")
    return training.merges_from_scores(ids.select("id", "piece", F.col("n").cast("double").alias("score")))


@query("dictionary_cover")
def dictionary_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of frequent strings for each source's texts."""
    return training.dictionaries(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query("feedback_rounding")
def feedback_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's mean vector laid out as an 8 x 8 matrix, rounded with the second moments of its entries by row."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("at", "x")).withColumn("row", F.expr("at div 8"))
    mean = e.groupBy("label", "at").agg(F.avg("x").alias("w"))
    parts = table(spark, sf_dir, "embeddings").select("label", F.expr("transform(sequence(0, 7), i -> aggregate(slice(embedding, i * 8 + 1, 8), 0.0D, (a, x) -> a + x))").alias("s"))
    pairs = parts.select("label", F.posexplode("s").alias("i", "a"), "s").select("label", "i", "a", F.posexplode("s").alias("j", "b"))
    moments = pairs.groupBy("label", "i", "j").agg(F.avg(F.col("a") * F.col("b")).alias("h"))
    both = mean.select("label", F.lit(0).alias("kind"), F.col("at"), F.lit(0).alias("j"), "w").unionAll(moments.select("label", F.lit(1).alias("kind"), F.col("i").alias("at"), "j", F.col("h").alias("w")))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        w = f[f["kind"] == 0].sort_values("at")["w"].to_numpy(float).reshape(8, 8)
        h = f[f["kind"] == 1].sort_values(["at", "j"])["w"].to_numpy(float).reshape(8, 8)
        rounded = training.feedback_rounding(w, h, 4, 0.05, 8)
        return pd.DataFrame({"label": f["label"].iloc[0], "row": range(8), "values": [r.round(6).tolist() for r in rounded]})

    return both.groupBy("label").applyInPandas(run, "label int, row long, values array<double>")


@query("parquet_chunks")
def parquet_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column chunks of the events file."""
    return files.parquet_chunks(spark, f"{sf_dir}/events.parquet")


@query("parquet_pages")
def parquet_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the events file."""
    return files.parquet_pages(spark, f"{sf_dir}/events.parquet")


@query("tensor_headers")
def tensor_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of each label written as one tensor file, its header read back."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("vec_id")
        raw = b"".join(struct.pack(f"<{len(v)}f", *v) for v in f["embedding"])
        head = json.dumps({"rows": {"dtype": "F32", "shape": [len(f), len(raw) // 4 // len(f)], "data_offsets": [0, len(raw)]}}).encode()
        return pd.DataFrame([(int(f["label"].iloc[0]), *r) for r in files.tensor_rows(struct.pack("<Q", len(head)) + head + raw)], columns=["label", "name", "dtype", "shape", "begin", "end"])

    return table(spark, sf_dir, "embeddings").groupBy("label").applyInPandas(run, "label long, name string, dtype string, shape array<long>, begin long, end long")


@query("gguf_headers")
def gguf_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tensor table per nation, written and read back."""
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()

    def run(frames):
        for f in frames:
            rows = []
            for key, name in zip(f["n_nationkey"], f["n_name"], strict=True):
                data = b"GGUF" + struct.pack("<IQQ", 3, 2, 1) + text("general.name") + struct.pack("<I", 8) + text(name)
                for k in range(2):
                    data += text(f"blk.{k}") + struct.pack("<IQQIQ", 2, 32, 4 + k, 0, 512 * k)
                rows += [(int(key), *r) for r in files.gguf_rows(data)]
            yield pd.DataFrame(rows, columns=["n_nationkey", "name", "shape", "kind", "offset"])

    return table(spark, sf_dir, "nation").mapInPandas(run, "n_nationkey long, name string, shape array<long>, kind long, offset long")


@query("container_members")
def container_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns put into a zip inside gzip, the members listed."""
    def run(frames):
        for f in frames:
            rows = []
            for conv, turn, text in zip(f["conv_id"], f["turn"], f["text"], strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr(f"{conv}/{turn}.txt", text or "")
                rows += [(conv, turn, *m) for m in files.members(gzip.compress(out.getvalue(), mtime=0))]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "member", "size", "crc32"])

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").mapInPandas(run, "conv_id long, turn long, member string, size long, crc32 long")


_HOURS = stateful.event_histogram_windowed(DUCK)


@query("stream_event_histogram", f"select event_type, hour, n, le_1, le_10, le_100 from ({_HOURS})")
def stream_event_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed bucket counts by a stream."""
    return S.drain(S.histogram(S.read_events(spark, sf_dir)), "complete", "histogram")


@query("stream_sessions", """
with e as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minutes as gap from events),
s as (select user_id, ts, sum(coalesce(gap, true)::int) over (partition by user_id order by ts rows unbounded preceding) as k from e),
g as (select user_id, k, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from s group by user_id, k)
select user_id, epoch_us(first_ts) as start_us, n from g where last_ts + interval 30 minutes <= (select max(ts) - interval 1 day from events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user by a stream: those that the watermark has closed."""
    closed = S.drain(S.sessions(S.read_events(spark, sf_dir)), "append", "sessions")
    return closed.select("user_id", "start_us", "n")


@query("stream_first_uses", "select user_id, event_type, count(*) as n from (select distinct user_id, event_type from events) group by user_id, event_type")
def stream_first_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (user, type) once, by a stream that drops replays."""
    once = S.drain(S.first_uses(S.read_events(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type", "event_id"), "append", "first")
    return once.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("stream_newest", "select user_id, max(event_id) as event_id from (select user_id, event_id, rank() over (partition by user_id order by ts desc) as k from events) where k = 1 group by user_id")
def stream_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest event of each user, by state that expires."""
    rows = S.drain(S.newest(S.read_events(spark, sf_dir)), "update", "newest")
    return rows.groupBy("user_id").agg(F.max(F.struct("us", "event_id")).alias("x")).select("user_id", F.col("x.event_id").alias("event_id"))
