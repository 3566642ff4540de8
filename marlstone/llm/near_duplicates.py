"""Near-duplicate groups by bottom-k sketches.

1. A document's set of 5-word shingles is hashed with one function; the k least hashes are its sketch.
   Documents with one and the same set become one node at once.
2. Retained values are joined through inverted lists. Ordered from the rarest on, two sketches that
   share enough values must share one of their first ones, so only those are listed. Sets that are
   retained whole have lists of their own, of fewer values: a link tells how many each may miss.
3. Lists of up to LIST nodes give candidate pairs. A longer list gives no pairs: its members are held
   against one pivot. Links among those near the pivot follow from their differences to it alone
   (``_near_links``); those far from it are listed anew by what they have and it has not, until no list
   is long: members that share one more list share one more value, which their next pivot has too.
4. Candidates are filtered by the Jaccard estimate from the sketch of their union, and confirmed on
   full sets. Connected components follow.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words in a shingle, values in a sketch, and the longest list whose pairs are formed.
WORDS, K, LIST = 5, 48, 32
#: Of 48 values of the union of what two far members add to a pivot, linked ones share 7 or more but for about one in 10^7.
FAR_SHARE = 0.15
#: The least of ``percent`` for which FAR_SHARE holds.
LEAST = 70
#: Shingles of a far member up to which all that the pivot has not are retained, so that its lists stay few.
WHOLE = 1 << 15
#: Members of one pivot that meet a copy of its text in one group of rows.
SHARE_OF_PIVOT = 512
#: Members in the two sides of a block of ``_near_links``, and values of their differences, in the mean.
LEFT, RIGHT, VALUES = 512, 4096, 1 << 20
REMEMBER = 100_000

_known: dict[bytes, int] = {}
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of the text, A-Z lower-cased."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z change, and only ASCII white space cuts
    if len(_known) > REMEMBER:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the text's shingles; fewer words count as one; no words, none."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    width = min(WORDS, n)
    s = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        s = (s ^ h[k:n - width + 1 + k]) * _C1
        s ^= s >> np.uint64(29)
    s *= _C2
    s ^= s >> np.uint64(32)
    return np.unique((s >> np.uint64(1)).astype(np.int64))


def linked(common_n: int, a: int, b: int, percent: int) -> bool:
    """Jaccard of at least ``percent`` hundredths; the empty set is linked with nothing."""
    return a > 0 and b > 0 and 100 * common_n >= percent * (a + b - common_n)


class Bounds(NamedTuple):
    """What a link of ``percent`` hundredths says of sketches and of differences to a pivot.

    share: of 48 values of the union's sketch, a linked pair shares fewer than this part about once in 10^7.
    A member is far from a pivot if it differs in more than ``far`` of their union and more than ``far_new``
    of its own set is new; near, if it differs in up to ``near`` or up to ``near_new`` is new. With d the
    distance of a link, x that differs in more than ``near``, ``near_new`` of it new, has no linked y that
    differs in ``far`` = near - d or less, or of which (near_new - d) / (1 - d) > far_new or less is new:
    so both are near or both are far.
    """

    share: float
    near: float
    far: float
    near_new: float
    far_new: float


def bounds(percent: int) -> Bounds:
    """The bounds for links of ``percent`` hundredths; at 85 a share of 27 of 48, 0.45, 0.30, 0.43 and 0.25."""
    if not LEAST <= percent <= 100:
        raise ValueError(f"percent must be from {LEAST} to 100: {percent}")
    p, least, missed = percent / 100, 0, 0.0
    while least < K and (missed := missed + comb(K, least) * p**least * (1 - p) ** (K - least)) < 4e-7:
        least += 1
    far_new = (100 - percent) / 60
    return Bounds(least / K, (130 - percent) / 100, 0.30, far_new + 0.18, far_new)


def _prints(documents: DataFrame) -> DataFrame:
    """(doc_id, n, k1, k2, sketch): set size, a 128-bit key of the set, its K least values."""
    def run(batches):
        for batch in common.steps(batches):
            sets = [shingles(t) for t in common.texts(batch)]
            keys = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]).reshape(-1, 2)
            offsets = np.cumsum([0, *(min(K, len(s)) for s in sets)]).astype(np.int32)
            flat = np.concatenate([s[:K] for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                                              pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "n", "k1", "k2", "sketch"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sketch array<long>")


def _first_values(nodes: DataFrame, percent: int, share: float, whole: int) -> DataFrame:
    """(key, sid, n, members): the rarest retained values of each node that others retain too.

    Of linked x and y, each misses at most d = 1 - percent / 100 of its own n shingles in the other. Up to
    ``whole`` shingles nothing is left out of ``sketch``, so nodes of that size are listed by d n + 1
    values, among themselves (keys below 0). Nodes that a larger one may be linked with are listed by K values.
    """
    among = nodes.where(F.col("n") <= whole).select("sid", "n", F.lit(True).alias("all"), F.transform("sketch", F.bitwise_not).alias("sketch"))
    other = nodes.where(100 * F.col("n") >= percent * (whole + 1)).select("sid", "n", F.lit(False).alias("all"), F.slice("sketch", 1, K).alias("sketch"))
    values = among.unionAll(other).select("sid", "n", "all", F.size("sketch").alias("m"), F.explode("sketch").alias("key"))
    often = values.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = values.join(often, "key")
    # All but the fewest that a link shares, and one more, are listed; those that no other node has come first and need no list.
    each = shared.groupBy("sid", "n", "all", "m").agg(F.array_sort(F.collect_list(F.struct("members", "key"))).alias("found"))
    most = F.when(F.col("all"), F.floor(F.col("n") * (100 - percent) / 100)).otherwise(F.col("m") - F.greatest(F.floor(share * F.col("m")), F.lit(1)))
    each = each.withColumn("room", (most + 1 - (F.col("m") - F.size("found"))).cast("int")).where("room > 0")
    return each.select("sid", "n", F.explode(F.slice("found", 1, F.col("room"))).alias("v")).select(F.col("v.key").alias("key"), "sid", "n", F.col("v.members").alias("members"))


def _list_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of one list, whose set sizes allow a link."""
    left = entries.select("key", F.col("sid").alias("a"), F.col("n").alias("na"))
    right = entries.select("key", F.col("sid").alias("b"), F.col("n").alias("nb"))
    near = (F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return left.join(right, "key").where(near).select("a", "b").distinct()


def _with_texts(pairs: DataFrame, documents: DataFrame, work: common.Workspace, name: str) -> DataFrame:
    """``pairs`` (a, b), a table, with both texts.

    Only texts of nodes that occur are exchanged. Pairs are dealt by b, and a's texts go to shares of
    at most about SHARE_OF_PIVOT pairs, so that a node with very many partners is spread over tasks.
    """
    used = work.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-used")
    some = work.save(common.only(documents.select("doc_id", "text").where("doc_id is not null"), used, used.count()), f"{name}-texts")
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE_OF_PIVOT).alias("shares"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), "shares").alias("share"))
    left = shares.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    left = left.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "ta")
    right = dealt.hint("merge").join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return right.hint("merge").join(left, ["a", "share"]).select("a", "b", "ta", "tb")


def _confirm(pairs: DataFrame, documents: DataFrame, work: common.Workspace, percent: int) -> DataFrame:
    """The pairs whose full sets are linked."""
    def run(batches):
        for batch in batches:
            for part in common.steps([batch], "ta"):
                held: dict[str, np.ndarray] = {}  # sets of the texts met last

                def own(text, held=held):
                    if text not in held:
                        if len(held) > 64:
                            held.clear()
                        held[text] = shingles(text)
                    return held[text]

                keep = []
                for k, (ta, tb) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    x, y = own(ta or ""), own(tb or "")
                    if linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                        keep.append(k)
                yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return _with_texts(pairs, documents, work, "pair").mapInArrow(run, "a long, b long")


def _estimate(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the sketch of the union does not rule out; exact where both sketches are whole sets."""
    s = lambda a, c: nodes.select(F.col("sid").alias(a), F.col("sketch").alias(c), F.col("n").alias(f"n{a}"))
    both = pairs.join(s("a", "sa"), "a").join(s("b", "sb"), "b")
    union = both.withColumn("u", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)).withColumn("c", F.array_intersect("sa", "sb"))
    hits, m = F.size(F.array_intersect("c", "u")), F.size("u")
    whole = (F.col("na") <= K) & (F.col("nb") <= K)
    share = bounds(percent).share
    exact = 100 * F.size("c") >= percent * (F.col("na") + F.col("nb") - F.size("c"))
    return union.where(F.when(whole, exact).otherwise(hits >= F.floor(share * m))).select("a", "b")


def _refine(star: DataFrame, documents: DataFrame, work: common.Workspace, percent: int, name: str) -> DataFrame:
    """How members x of long lists differ from their pivots p: (p, sid, n, linked, near, delta, sketch).

    delta, of near members, is the symmetric difference of the sets of x and p. sketch, of far ones, is
    N(x) = x - p, salted with p: all of it if x has up to WHOLE shingles, else the bottom-k sketch. For
    linked x and y, N(x) misses at most d |x| values of N(y), d = 1 - percent / 100, and has more than
    far_new = d / 0.6 of x, so the pair shares a value of N. N(x) and N(y) differ in at most d |x u y|: their
    Jaccard index is above (1.4 - d) / (2.6 - d), 0.47 or more, so sketches of N find the pair as well,
    and what many members share with p no longer lists them.
    """
    limit = bounds(percent)

    def run(batches):
        for batch in batches:
            for part in common.steps([batch], "ta"):
                rows, last, pivot = [], None, None
                for p, x, tp, tx in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if (p, tp) != last:
                        last, pivot = (p, tp), shingles(tp or "")
                    own = shingles(tx or "")
                    differ = np.setxor1d(own, pivot, assume_unique=True)
                    union = (len(own) + len(pivot) + len(differ)) // 2
                    ok = linked(union - len(differ), len(own), len(pivot), percent)
                    new = np.setdiff1d(own, pivot, assume_unique=True)
                    near = len(differ) <= limit.near * union or len(new) <= limit.near_new * len(own)
                    far = len(differ) > limit.far * union and len(new) > limit.far_new * len(own)
                    salted = np.zeros(0, np.int64)
                    if far:
                        salted = np.sort((((new.astype(np.uint64) ^ (np.uint64(p * int(_C1) & 0xFFFFFFFFFFFFFFFF))) * _C2) >> np.uint64(1)).astype(np.int64))
                        salted = salted if len(own) <= WHOLE else salted[:K]
                    rows.append((p, x, len(own), ok, near, differ if near else differ[:0], salted))
                columns = list(zip(*rows, strict=True))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]).astype(np.int32)), pa.array(np.concatenate(c))) for c in columns[5:]]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.bool_()), pa.array(columns[4], pa.bool_()), *lists],
                                                 ["p", "sid", "n", "linked", "near", "delta", "sketch"])

    texts = _with_texts(star, documents, work, name).selectExpr("a as p", "b as sid", "ta as tp", "tb as ta")
    return texts.mapInArrow(run, "p long, sid long, n long, linked boolean, near boolean, delta array<long>, sketch array<long>")


def _near_links(refined: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of near members that are not linked with the pivot themselves, with any near member.

    |x n y| follows from the differences to the pivot: x's set is p's set with D(x) flipped, so
    |x ^ y| = |D(x) ^ D(y)|. Members are dealt into blocks of bounded size; a block counts shared
    differences and returns a spanning forest of its links, at most one row per member.
    """
    near = refined.where("near").withColumn("d", F.size("delta").cast("long"))
    left = near.where("not linked")
    own = lambda e: F.sum(F.when(~F.col("linked"), e).otherwise(0))
    sizes = near.groupBy("p").agg(own(F.lit(1).cast("long")).alias("nl"), own(F.col("d")).alias("dl"), F.count("*").alias("nr"), F.sum("d").alias("dr")).where("nl > 0 and nr > 1")
    blocks = lambda n, d, most: F.greatest(F.ceil(F.col(n) / most), F.ceil(F.col(d) / VALUES))
    sizes = sizes.select("p", blocks("nl", "dl", LEFT).alias("bl"), blocks("nr", "dr", RIGHT).alias("br"))
    fields = [F.col(c).alias(c) for c in ("p", "sid", "n", "delta")]  # new columns: both sides stem from one table
    place = lambda d, own, other, mine, its: d.join(sizes, "p").select(*fields, F.pmod(F.xxhash64("sid"), F.col(own)).alias(mine), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(its))
    one, two = place(left, "bl", "br", "i", "j"), place(near, "br", "bl", "j", "i")

    def run(key, x, y):
        edges: list[tuple[int, int]] = []
        if x.num_rows and y.num_rows:
            ids, n = ([t[c].to_numpy() for t in (x, y)] for c in ("sid", "n"))
            size = [pc.list_value_length(t["delta"]).to_numpy().astype(np.int64) for t in (x, y)]
            mine, flat = (pc.list_flatten(t["delta"]).to_numpy() for t in (x, y))
            ends = np.cumsum(size[0])
            by = np.argsort(flat, kind="stable")
            flat, owner = flat[by], np.repeat(np.arange(len(size[1])), size[1])[by]
            head: dict[int, int] = {}

            def root(k):
                while head.setdefault(k, k) != k:
                    head[k] = k = head[head[k]]
                return k

            for k, (end, m) in enumerate(zip(ends.tolist(), size[0].tolist(), strict=True)):
                low, high = np.searchsorted(flat, mine[end - m:end], "left"), np.searchsorted(flat, mine[end - m:end], "right")
                many = high - low
                at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                shared = np.bincount(owner[at], minlength=len(size[1]))
                both = (n[0][k] + n[1] - (size[0][k] + size[1] - 2 * shared)) // 2
                for j in np.flatnonzero((100 * both >= percent * (n[0][k] + n[1] - both)) & (ids[1] != ids[0][k])).tolist():
                    a, b = int(ids[0][k]), int(ids[1][j])
                    if root(a) != root(b):
                        head[root(a)] = root(b)
                        edges.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return one.groupBy("p", "i", "j").cogroup(two.groupBy("p", "i", "j")).applyInArrow(run, "a long, b long")


def links(documents: DataFrame, work: common.Workspace, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(prints, edges): each document's print with its node, and the confirmed links (a, b) of nodes."""
    documents = documents.select("doc_id", "text")
    prints = work.save(_prints(documents), "prints")
    nodes = prints.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("x"))
    nodes = work.save(nodes.select("k1", "k2", F.col("x.doc_id").alias("sid"), F.col("x.n").alias("n"), F.col("x.sketch").alias("sketch")), "nodes")
    entries = work.save(_first_values(nodes, percent, bounds(percent).share, K), "lists-0")
    candidates, edges, held = [], [], documents
    for turn in itertools.count(1):
        candidates.append(work.save(_list_pairs(entries.where(f"members <= {LIST}"), percent), f"candidates-{turn}"))
        long = entries.where(f"members > {LIST}")
        # Any pivot will do for a list. Lists that share members take the least of their pivots, so that a
        # family of near copies is held against one pivot, not against one for each list.
        pivots = long.groupBy("key").agg(F.min("sid").alias("a"))
        chosen = long.join(pivots, "key").groupBy("sid").agg(F.min("a").alias("a"))
        pivots = work.save(long.join(chosen, "sid").groupBy("key").agg(F.min("a").alias("a")), f"pivots-{turn}")
        star = work.save(long.join(pivots, "key").where("sid != a").select("a", F.col("sid").alias("b")).distinct(), f"star-{turn}")
        work.drop(f"lists-{turn - 1}", f"pivots-{turn}")
        if star.isEmpty():
            break
        refined = work.save(_refine(star, held, work, percent, f"star-{turn}"), f"refined-{turn}")
        work.drop(f"star-{turn}", f"star-{turn}-used")
        if turn == 1:  # all members and pivots of later rounds are members of this one
            held = documents.sparkSession.read.schema(documents.schema).parquet(f"{work.root}/star-1-texts")
        else:
            work.drop(f"star-{turn}-texts")
        edges.append(work.save(refined.where("linked").select(F.col("p").alias("a"), F.col("sid").alias("b")), f"linked-{turn}"))
        edges.append(work.save(_near_links(refined, percent), f"near-{turn}"))
        far = refined.where("size(sketch) > 0").select(F.struct("p", "sid").alias("sid"), "n", "sketch")
        entries = work.save(_first_values(far, percent, FAR_SHARE, WHOLE).withColumn("sid", F.col("sid.sid")), f"lists-{turn}")
        work.drop(f"refined-{turn}")
    pairs = work.save(_estimate(functools.reduce(DataFrame.unionAll, candidates).distinct(), nodes, percent), "pairs")
    work.drop("star-1-texts", *(f"candidates-{k}" for k in range(1, turn + 1)))
    found = functools.reduce(DataFrame.unionAll, edges, _confirm(pairs, documents, work, percent))
    found = work.save(found, "edges")
    work.drop("pairs", "pair-used", "pair-texts", *(f"{name}-{k}" for name in ("linked", "near") for k in range(1, turn + 1)))
    return prints.join(nodes.select("k1", "k2", "sid"), ["k1", "k2"], "left"), found


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """Group near-duplicates: (doc_id, n_shingles, component_id, kept).

    Documents whose 5-word shingle sets have a Jaccard index of ``percent`` hundredths or more are
    linked; component_id is the least doc_id that links reach, kept marks it. Null, empty or blank
    text: an empty set, linked with nothing, its own component. Fewer than five words are one
    shingle. A null doc_id is not linked: component_id is null and kept true. Repeated rows share
    their component. Other columns are not read. An empty table gives no rows.
    """
    work = common.Workspace(documents.sparkSession, "near")
    prints, edges = links(documents, work, percent)
    groups = work.save(common.components(edges, work), "groups")
    work.drop("edges")
    own = prints.select("doc_id", F.col("n").alias("n_shingles"), "sid").join(groups, F.col("sid") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "sid", "doc_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(documents: DataFrame, percent: int = 85) -> DataFrame:
    """``documents`` without those of a group but its least doc_id; all columns stay.

    Rows with a null doc_id stay. Of repeated rows with the kept doc_id, all stay.
    """
    gone, = common.fresh(documents.columns, "gone")
    marks = near_duplicates(documents, percent).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return documents.join(marks, F.col("doc_id") == F.col(gone), "left_anti")
