"""Fingerprints of texts: an index of recent holders, base choice, families, regions, shared passages.

Shingles are hashed and sampled where the text is read, so that only the sample is exchanged. The
oracles are written apart from the plans.
"""

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.registry import query
from marlstone.session import shared_dir
from marlstone.sources.tables import table

#: Holders of one fingerprint that the index keeps, the most recent; 840 is divisible by 1 to 8, so that
#: scores (a print shared by n holders gives 1 / n to each) are whole numbers.
HOLDERS, POINTS = 8, 840
#: Shares of the probe's prints: below the first no base is tried, from the second on it is of the base's family.
MIN_SHARE, FAMILY_SHARE = 0.02, 0.98
#: A fingerprint at more places of the base says nothing of where content is; bins are of so many words,
#: a region of so many bins; fewer anchors than this leave the region at the start.
AMBIGUOUS, BIN_WORDS, SPAN, LEAST_ANCHORS = 64, 16, 8, 16
#: Distinct shingles of evaluation texts that are broadcast at most; more are joined by shuffle.
FEW_SHINGLES = 1 << 21
#: Words whose spans are hashed at a time.
SPAN_WORDS = 1 << 20

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+', 0)"


def _shingle(w: Column, i: Column, n: int) -> Column:
    return F.array_join(F.slice(w, i, n), " ")


def _places(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))


def placed_prints(documents: DataFrame, n: int, every: int) -> DataFrame:
    """(doc_id, pos, h, several): 60-bit numbers from SHA-256 of n-word shingles with their places from 0, one in ``every`` (a power of
    two); not ``several`` are those of one repeated word. A row's words are joined once and its shingles are slices of that."""
    words = documents.select("doc_id", F.expr(_WORDS).alias("w")).where(F.size("w") >= n).select("doc_id", F.array_join("w", " ").alias("t"))
    mask = np.uint64(every - 1)

    def of_text(t: bytes):
        gaps = np.flatnonzero(np.frombuffer(t, np.uint8) == 32)
        begin, end = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(t)]
        digests = b"".join([hashlib.sha256(t[i:j]).digest()[:8] for i, j in zip(begin, end[n - 1:])])
        h = np.frombuffer(digests, ">u8").astype(np.uint64) >> np.uint64(4)
        pos = np.flatnonzero(h & mask == 0)
        return pos, h[pos].view(np.int64), [len(set(t[begin[p]:end[p + n - 1]].split(b" "))) > 1 for p in pos.tolist()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                pos, h, several = zip(*(of_text(t.as_buffer().to_pybytes()) for t in part.column(1)))
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(pos)), [len(p) for p in pos])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(pos)), pa.array(np.concatenate(h)), pa.array([x for v in several for x in v], pa.bool_())], ["doc_id", "pos", "h", "several"])

    return words.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, pos long, h long, several boolean")


def prints(documents: DataFrame, n: int = 5, every: int = 16) -> DataFrame:
    """(doc_id, h): distinct hashes of n-word shingles, one in ``every``."""
    return placed_prints(documents, n, every).select("doc_id", "h").distinct()


def _folded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two, in their order."""
    z = x * np.uint64(0x9E3779B97F4A7C15) + (y ^ y >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    z = (z ^ z >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ z >> np.uint64(32)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` words in a row, ``n`` a power of two: two halves at a time, so the time doesn't go with ``n``."""
    step = 1
    while step < n:
        words = _folded(words[:-step], words[step:])
        step *= 2
    return words


def span_hashes(documents: DataFrame, n: int) -> DataFrame:
    """(doc_id, h, g): two hashes of each ``n``-word span of a row, mostly once for each row, whatever the row's length."""
    words = documents.select("doc_id", F.expr(_WORDS).alias("w")).where(F.size("w") >= n)
    hashed = words.select("doc_id", F.transform("w", lambda x: F.xxhash64(x)).alias("a"), F.transform("w", lambda x: F.xxhash64(F.lit(1), x)).alias("b"))

    def run(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                ends = batch.column(1).offsets.to_numpy().astype(np.int64)
                rows = max(1, int(np.searchsorted(ends, ends[at] + SPAN_WORDS, "right")) - 1 - at)
                part = batch.slice(at, rows)
                at += rows
                begin = np.repeat(np.arange(rows), np.diff(ends[at - rows:at + 1]))
                inside = np.flatnonzero(begin[:1 - n] == begin[n - 1:])
                h, g = (run_hashes(part.column(k).flatten().to_numpy().view(np.uint64), n)[inside].view(np.int64) for k in (1, 2))
                row = begin[inside]
                order = np.lexsort((h, row))
                h, g, row = h[order], g[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[new])), pa.array(h[new]), pa.array(g[new])], ["doc_id", "h", "g"])

    return hashed.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, h long, g long")


def scored(documents: DataFrame) -> DataFrame:
    """(probe, cand, shared, points, m): for each document the earlier ones that share prints with it.

    Each print names its HOLDERS most recent earlier holders, whatever their number, so a frequent print is
    neither dropped nor paired off: every holder meets at most HOLDERS others.
    """
    fp = prints(documents)
    recent = Window.partitionBy("h").orderBy("doc_id").rowsBetween(-HOLDERS, -1)
    met = fp.select(F.col("doc_id").alias("probe"), F.collect_list("doc_id").over(recent).alias("held")).where("probe is not null")
    # A null beside the holders counts the probe's own prints, so that these are made once.
    pairs = met.select("probe", F.explode(F.concat("held", F.array(F.lit(None)))).alias("cand"), F.expr(f"{POINTS} div nullif(size(held), 0)").alias("points"))
    pairs = pairs.groupBy("probe", "cand").agg(F.count("*").alias("shared"), F.sum("points").alias("points"))
    own = F.max(F.when(F.col("cand").isNull(), F.col("shared"))).over(Window.partitionBy("probe"))
    return pairs.withColumn("m", own).where("cand is not null")


def bases(documents: DataFrame) -> DataFrame:
    """(probe, best, second, shared, m): within 5% of the best score the most recent; a second with at least half of its score."""
    own = Window.partitionBy("probe")
    sc = scored(documents).withColumn("top", F.max("points").over(own))
    sc = sc.withColumn("best", F.max(F.when(100 * F.col("points") >= 95 * F.col("top"), F.col("cand"))).over(own))
    first = F.max(F.when(F.col("cand") == F.col("best"), F.struct("points", "shared")))
    sc = sc.withColumn("first", first.over(own)).where(F.col("first.points") >= MIN_SHARE * POINTS * F.col("m"))
    rest = F.when((F.col("cand") != F.col("best")) & (2 * F.col("points") >= F.col("first.points")), F.struct("points", "cand"))
    return sc.groupBy("probe", "best", "first", "m").agg(F.max(rest).alias("rest")).select("probe", "best", F.col("rest.cand").alias("second"), F.col("first.shared").alias("shared"), "m")


_PRINTS = """
w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+') as w from documents),
p as (select doc_id, unnest(range(1, len(w) - 3)) as i, w from w),
fp as (select distinct doc_id, h from (select doc_id, ('0x' || substr(sha256(array_to_string(w[i:i + 4], ' ')), 1, 15))::bigint as h from p) t where h % 16 = 0),
r as (select doc_id, h, row_number() over (partition by h order by doc_id) as k from fp),
hit as (select a.doc_id as probe, b.doc_id as cand, 840 // least(a.k - 1, 8) as points from r a join r b on a.h = b.h and b.k < a.k and b.k >= a.k - 8),
sc as (select probe, cand, count(*) as shared, sum(points)::bigint as points from hit group by probe, cand),
own as (select doc_id, count(*) as m from fp group by doc_id)"""
_BASES = _PRINTS + """,
t as (select sc.*, own.m, max(points) over (partition by probe) as top from sc join own on own.doc_id = sc.probe),
f as (select probe, max(cand) as best from t where points >= top * 0.95 group by probe),
g as (select f.probe, f.best, t.points as best_points, t.shared, t.m from f join t on t.probe = f.probe and t.cand = f.best where t.points / 840.0 / t.m >= 0.02)"""


@query("similar_documents", f"with {_PRINTS} select probe, cand, shared, round(points / 840.0::double, 6) as score from sc")
def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier documents that share fingerprints, with scores."""
    return scored(table(spark, sf_dir, "documents")).select("probe", "cand", "shared", F.round(F.col("points") / F.lit(float(POINTS)), 6).alias("score"))


@query("base_candidates", f"""with {_BASES}
select g.probe, g.best, (select max_by(t.cand, t.points * 1000000000 + t.cand) from t where t.probe = g.probe and t.cand <> g.best and t.points * 2 >= g.best_points) as second from g""")
def base_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base of each document, and a second one to try."""
    return bases(table(spark, sf_dir, "documents")).select("probe", "best", "second")


@query("family_assign", f"with {_BASES} select d.doc_id, case when g.shared / g.m::double >= 0.98 then g.best else d.doc_id end as family from documents d left join g on g.probe = d.doc_id")
def family_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document joins its base's family when at least FAMILY_SHARE of its prints are held there."""
    documents = table(spark, sf_dir, "documents")
    kin = bases(documents).where(F.col("shared") >= FAMILY_SHARE * F.col("m")).select(F.col("probe").alias("doc_id"), "best")
    return documents.select("doc_id").join(kin, "doc_id", "left").select("doc_id", F.coalesce("best", "doc_id").alias("family"))


@query("near_duplicates", f"with {_PRINTS} select probe, cand, shared from sc join own on own.doc_id = probe where shared * 2 >= m")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that share at least half of the probe's prints."""
    return scored(table(spark, sf_dir, "documents")).where("2 * shared >= m").select("probe", "cand", "shared")


_PLACED = """
w{n} as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+') as w from documents),
p{n} as (select doc_id, unnest(range(1, len(w) - 2)) as i, w from w{n}),
a{n} as (select doc_id, i - 1 as pos, ('0x' || substr(sha256(array_to_string(w[i:i + 3], ' ')), 1, 15))::bigint as h from p{n} where not (w[i] = w[i + 1] and w[i] = w[i + 2] and w[i] = w[i + 3])),
s{n} as (select * from a{n} where h % {n} = 0)"""


@query("anchors", f"with {_PLACED.format(n=1024)} select distinct doc_id, h from s1024")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 4-word shingle in 1024 by hash, those of one repeated word left out."""
    return placed_prints(table(spark, sf_dir, "documents"), 4, 1024).where("several").select("doc_id", "h").distinct()


@query("region_window", f"""with {_BASES}, {_PLACED.format(n=4)},
k as (select doc_id, h, count(*) as places from s4 group by doc_id, h having count(*) <= 64),
an as (select g.probe, g.best, s4.pos, s4.h, k.places from g join s4 on s4.doc_id = g.probe join k on k.doc_id = g.best and k.h = s4.h),
tot as (select probe, best, count(*) as anchors from an group by probe, best),
b as (select an.probe, s4.pos // 16 as bin, sum(64 // an.places) as hits from an join s4 on s4.doc_id = an.best and s4.h = an.h group by 1, 2),
win as (select x.probe, x.bin, sum(y.hits) as hits from b x join b y on y.probe = x.probe and y.bin between x.bin - 7 and x.bin group by 1, 2),
top as (select probe, bin, hits, row_number() over (partition by probe order by hits desc, bin) as k from win)
select tot.probe, tot.best as base, case when anchors < 16 then 0 else greatest(bin - 7, 0) end as bin, case when anchors < 16 then 0 else hits end::bigint as hits from tot join top on top.probe = tot.probe and top.k = 1""")
def region_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of each document's base that hold most of its anchors; an anchor at k places gives 1 / k to each."""
    documents = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/marlstone/placed-{uuid.uuid4().hex}"  # made once, read three times
    placed_prints(documents, 4, 4).where("several").drop("several").write.parquet(path)
    placed = spark.read.parquet(path)
    chosen = bases(documents).select("probe", "best")
    few = placed.groupBy(F.col("doc_id").alias("best"), "h").agg(F.count("*").alias("k")).where(F.col("k") <= AMBIGUOUS)
    mine = placed.groupBy(F.col("doc_id").alias("probe"), "h").agg(F.count("*").alias("times"))
    met = chosen.join(mine, "probe").join(few, ["best", "h"])
    spots = met.join(placed.select(F.col("doc_id").alias("best"), "h", "pos"), ["best", "h"])
    bins = spots.groupBy("probe", "best", F.expr(f"pos div {BIN_WORDS}").alias("bin")).agg(F.sum(F.expr(f"times * ({AMBIGUOUS} div k)")).alias("hits"))
    window = Window.partitionBy("probe").orderBy("bin").rangeBetween(-(SPAN - 1), 0)
    best = bins.withColumn("mass", F.sum("hits").over(window)).groupBy("probe", "best").agg(F.max(F.struct("mass", (-F.col("bin")).alias("last"))).alias("top"))
    total = met.groupBy("probe").agg(F.sum("times").alias("anchors"))
    enough = F.col("anchors") >= LEAST_ANCHORS
    at = F.greatest(-F.col("top.last") - (SPAN - 1), F.lit(0))
    zero = F.lit(0).cast("long")
    return best.join(total, "probe").select("probe", F.col("best").alias("base"), F.when(enough, at).otherwise(zero).alias("bin"), F.when(enough, F.col("top.mass")).otherwise(zero).alias("hits"))


@query("repeated_spans", """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 31], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 30)) as i from w)),
f as (select g, min(doc_id) as first_doc from s group by g)
select s.doc_id, count(*) as spans, min(first_doc) as earliest from s join f on s.g = f.g and first_doc < s.doc_id group by s.doc_id""")
def repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-word spans that an earlier document has: rows of (document, places). Each span is exchanged once, as two 64-bit hashes."""
    s = span_hashes(table(spark, sf_dir, "documents"), 32)
    same = Window.partitionBy("h", "g").orderBy("doc_id")
    met = s.select("doc_id", F.first("doc_id").over(same.rowsBetween(Window.unboundedPreceding, 0)).alias("first_doc"), F.lag("doc_id").over(same).alias("previous"))
    hits = met.where("first_doc < doc_id and previous < doc_id")  # once for each document
    return hits.groupBy("doc_id").agg(F.count("*").alias("spans"), F.min("first_doc").alias("earliest"))


@query("decontaminate_docs", """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+') as w from documents),
b as (select regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+') as w from benchmark),
bs as (select distinct array_to_string(w[i:i + 31], ' ') as g from (select w, unnest(range(1, len(w) - 30)) as i from b)),
ds as (select doc_id, array_to_string(w[i:i + 31], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 30)) as i from d))
select doc_id from documents where doc_id not in (select ds.doc_id from ds join bs on ds.g = bs.g)""")
def decontaminate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a 32-token run with evaluation text are dropped; here, the ones that stay.

    The evaluation set's hashes go to the scan of the documents (by broadcast, if they are few), so
    documents are not exchanged; only rows that meet a hash are confirmed on the words.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", F.expr(_WORDS).alias("w"))
    spans = lambda w, make: F.transform(_places(w, 32), make)
    both = lambda i: F.struct(F.xxhash64(F.slice("w", i, 32)).alias("h"), _shingle(F.col("w"), i, 32).alias("g"))
    items = table(spark, sf_dir, "benchmark").select(F.expr(_WORDS).alias("w")).select(F.explode(spans(F.col("w"), both)).alias("s")).select("s.h", F.col("s.g").alias("item")).distinct()
    few = items.count() <= FEW_SHINGLES
    side = lambda d: F.broadcast(d) if few else d
    hashes = documents.select("doc_id", F.explode(spans(F.col("w"), lambda i: F.xxhash64(F.slice("w", i, 32)))).alias("h"))
    met = hashes.join(side(items.select("h").distinct()), "h", "left_semi").select("doc_id").distinct()
    confirm = documents.join(met, "doc_id", "left_semi").select("doc_id", F.explode(spans(F.col("w"), both)).alias("s")).select("doc_id", "s.h", "s.g")
    hits = confirm.join(side(items), "h").where("g = item").select("doc_id").distinct()
    return documents.select("doc_id").join(hits, "doc_id", "left_anti")
