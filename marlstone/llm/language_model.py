"""Cross-entropy difference between two matched n-gram models over one vocabulary.

Tokens are words (A-Z lower-cased, cut at ASCII white space), between a start and an end sign. The vocabulary is
closed: the most frequent words of all texts, and one sign for all others. Every text counts in the corpus;
the target are the documents labelled good, the background is a sample, of equal size, of the others, so no
document is in both. Both are bigram models that fall back to the bigram model of the whole corpus, and
that one to its words, so they differ only in the counts of their own texts:

    p(w)         = (c(w) + K / V) / (n + K)
    p(w | v)     = (c(v w) + K p(w)) / (c(v) + K)
    p_m(w | v)   = (c_m(v w) + K p(w | v)) / (c_m(v) + K),  m the target or the background

A document is scored by what all others have: its own counts are taken out of each model it is in.

Counts never meet in one place. Texts are dealt into batches by doc_id; a batch's distinct n-grams go, counted,
to buckets by their hash, and a bucket answers each batch with the other batches' counts. What is
exchanged grows with the corpus; a hot n-gram is one entry a batch. Only the vocabulary is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .near_duplicates import word_hashes

#: Weight of the shorter n-gram's estimate, in counts.
K = 4.0
#: Bits of a word's number, and the words that have one of their own; three numbers are signs.
BITS = 15
VOCABULARY = (1 << BITS) - 3
OTHER, START, END = VOCABULARY, VOCABULARY + 1, VOCABULARY + 2
#: Bytes of text in a batch.
BATCH_BYTES = 4 << 20
#: Parts into which documents are dealt to draw the background.
DRAWS = 1 << 20
#: Words that a worker counts before it hands them on, and groups of words whose most frequent are picked.
HELD, GROUPS = 1 << 21, 4
MODELS = ("target", "background", "corpus")
_ONE, _TOTAL, _ODD = np.uint32(1 << 2 * BITS), np.uint32(1 << 31), np.uint32(0x9E3779B1)


def vocabulary(documents: DataFrame, most: int = VOCABULARY) -> np.ndarray:
    """Hashes, in order, of the ``most`` most frequent words of all texts (ties by hash). Words are counted in the
    scan, then by hash; the most frequent ones of GROUPS groups of words are picked first, and only those are
    ranked together, so what reaches the driver is bounded by ``most`` times GROUPS, whatever the corpus."""
    def tally(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold():
            word, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            held[:] = [(word, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64))]

        def flush():
            for word, n in held:
                for x in range(0, len(word), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(word[x:x + 100_000].view(np.int64)), pa.array(n[x:x + 100_000])], ["word", "n"])
            held.clear()

        for batch in common.steps(batches):
            found = [word_hashes(t) for t in common.texts(batch)]
            held.append(np.unique(np.concatenate(found), return_counts=True))
            if sum(len(w) for w, _ in held) > HELD:
                fold()
                if len(held[0][0]) > HELD // 2:
                    yield from flush()
        if held:
            fold()
            yield from flush()

    counts = documents.select("text").mapInArrow(tally, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(F.pmod("word", F.lit(GROUPS))).orderBy(F.col("n").desc(), "word")
    first = counts.withColumn("k", F.row_number().over(own)).where(F.col("k") <= most)
    rows = first.orderBy(F.col("n").desc(), "word").limit(most).select("word").collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


def planes(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32, all lowest bytes first, then the next: small numbers compress to little."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(data: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel()


class Batch:
    """The n-grams of one batch's texts: ``keys`` (distinct, mixed, in order) and their counts in the target, the
    background and all texts; each token's word, its context and the two as a pair, as numbers of keys."""

    def __init__(self, rows: pa.Table, known: np.ndarray):
        named = rows.filter(pc.invert(rows["own"]))
        good = set(named["doc_id"].to_pylist())
        own = rows.filter(rows["own"])
        self.ids = own["doc_id"]
        words = [word_hashes(t) for t in own["text"].to_pylist()]
        self.n = np.fromiter(map(len, words), np.int64, len(words))
        used = np.flatnonzero(self.n)
        size = self.n[used] + 2
        ends = np.cumsum(size)
        flat = np.empty(ends[-1] if len(ends) else 0, np.uint32)
        inner, first, last = (np.ones(len(flat), bool) for _ in range(3))
        first[ends - 1] = last[ends - size] = False  # no bigram begins with an end or ends with a start
        inner = first & last
        if len(used):
            every = np.concatenate([words[k] for k in used.tolist()])
            at = np.minimum(np.searchsorted(known, every), max(len(known) - 1, 0))
            flat[inner] = np.where(known[at] == every, at, OTHER) if len(known) else OTHER
        flat[ends - size], flat[ends - 1] = START, END
        owner = np.repeat(used, size)
        self.owner = owner[last]
        in_target = np.array([i is not None and i in good for i in self.ids.to_pylist()], bool)
        drawn = np.array(own["drawn"].to_pylist(), bool) & ~in_target
        self.member = {"target": in_target, "background": drawn, "corpus": np.ones(len(words), bool)}
        grams = np.concatenate([flat | _ONE, flat[first] << np.uint32(BITS) | flat[last]])
        self.whose = np.concatenate([owner, self.owner])
        self.keys, at = np.unique(np.append(grams, _TOTAL) * _ODD, return_inverse=True)  # spread by an odd factor
        self.at, total = at[:-1], at[-1]
        self.counts = {m: np.bincount(self.at[hit[self.whose]], minlength=len(self.keys)) for m, hit in self.member.items()}
        for m, hit in self.member.items():
            self.counts[m][total] = np.count_nonzero(hit[self.owner])
        self.total, self.first, self.last, self.tokens = total, first, last, len(flat)

    def bucket(self, buckets: int) -> np.ndarray:
        return (self.keys.astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

    def losses(self, others: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Bits of each token under each model, without the token's own document; ``others`` are the counts elsewhere."""
        split = lambda x: (x[:self.tokens][self.last], x[:self.tokens][self.first], x[self.tokens:])
        word, context, pair = split(self.at)
        _, back, often = np.unique(self.whose * len(self.keys) + self.at, return_inverse=True, return_counts=True)
        own_word, own_context, own_pair = split(often[back])
        count = {m: self.counts[m] + others[m] for m in MODELS}
        length = np.bincount(self.owner, minlength=len(self.n))[self.owner]
        p = (count["corpus"][word] - own_word + K / (1 << BITS)) / (count["corpus"][self.total] - length + K)
        out = {}
        for m in ("corpus", "target", "background"):
            here = self.member[m][self.owner]
            both, before = count[m][pair] - np.where(here, own_pair, 0), count[m][context] - np.where(here, own_context, 0)
            q = (both + K * p) / (before + K)
            out[m] = -np.log2(q)
            if m == "corpus":
                p = q
        return out


def cross_entropy_difference(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text: (doc_id, n_tokens, target_loss, background_loss, corpus_loss, score).

    n_tokens are the words, known or not; losses are means in bits over the words and the end sign; ``score`` is target loss
    minus background loss: the lower, the more like the target. A document is in the target if any of its labels has
    quality 1, else in the background if it is drawn: by a hash of its id, with the chance that makes both
    equally large in bytes (if the target is the larger, all others are drawn). Null, empty or
    blank text: no tokens, null losses, and it counts nowhere. A null doc_id is never labelled; repeated
    rows are documents of their own; labels without a document are ignored; other columns are not read; an
    empty table gives no rows.
    """
    spark = documents.sparkSession
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = docs.select("doc_id", F.octet_length("text").cast("long").alias("n")).join(good.withColumn("good", F.lit(True)), "doc_id", "left")
    hit, total = sizes.agg(F.sum(F.when(F.col("good"), F.col("n"))), F.sum("n")).first()
    hit, total = hit or 0, total or 0
    batches = buckets = max(1, -(-total // BATCH_BYTES))
    partitions = common.partitions(spark, total, batches)
    share = DRAWS if 2 * hit >= total else DRAWS * hit // (total - hit)

    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    rows = docs.select(F.pmod(key, F.lit(batches)).alias("batch"), "doc_id", "text", (F.pmod(F.xxhash64(key, F.lit(1)), F.lit(DRAWS)) < share).alias("drawn"), F.lit(True).alias("own"))
    named = good.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch"), "doc_id", F.lit("").alias("text"), F.lit(False).alias("drawn"), F.lit(False).alias("own"))
    rows = rows.unionAll(named).repartition(partitions, "batch")
    blob = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("blob", pa.binary())])
    known = spark.sparkContext.broadcast(vocabulary(docs))

    def counted(key, table):
        """Per bucket: the number of the batch's keys, then the keys' distances and their counts."""
        b, batch = key[0].as_py(), Batch(table, known.value)
        which = batch.bucket(buckets)
        made = []
        for x, y in zip(*common.runs(which), strict=True):
            keys = batch.keys[x:y].astype(np.int64)
            parts = [planes(np.diff(keys, prepend=0)), *(planes(batch.counts[m][x:y]) for m in MODELS)]
            made.append({"bucket": int(which[x]), "batch": b, "blob": int(y - x).to_bytes(8, "little") + b"".join(parts)})
        return pa.Table.from_pylist(made, schema=blob)

    def answered(key, table):
        """Per batch: which of its keys other batches have, and the others' counts."""
        k, keys, counts, sizes = key[0].as_py(), [], [], []
        for x in table["blob"].to_pylist():
            n = int.from_bytes(x[:8], "little")
            sizes.append(n)
            keys.append(np.cumsum(unplanes(x, n, 8).astype(np.int64)))
            counts.append(np.stack([unplanes(x, n, 8 + 4 * n * (i + 1)) for i in range(3)]))
        every = np.concatenate(counts, axis=1).astype(np.int64)
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        others = np.stack([np.bincount(at, weights=c, minlength=len(distinct)).astype(np.int64) for c in every])[:, at] - every
        made, edge = [], np.cumsum([0, *sizes])
        for b, x, y in zip(table["batch"].to_pylist(), edge[:-1], edge[1:], strict=True):
            there = others[2, x:y] > 0
            if there.any():
                # Counts of up to 2^64 in two halves; the upper one is nearly always 0.
                parts = [np.packbits(there).tobytes(), *(planes(half) for c in others[:, x:y][:, there] for half in (c & 0xFFFFFFFF, c >> 32))]
                made.append({"bucket": k, "batch": b, "blob": int(y - x).to_bytes(8, "little") + b"".join(parts)})
        return pa.Table.from_pylist(made, schema=blob)

    names = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((f"{m}_loss", pa.float64()) for m in MODELS), ("score", pa.float64())]

    def scored(key, table, answers):
        batch = Batch(table, known.value)
        which = batch.bucket(buckets)
        others = {m: np.zeros(len(batch.keys), np.int64) for m in MODELS}
        for k, x in zip(answers["bucket"].to_pylist(), answers["blob"].to_pylist(), strict=True):
            n = int.from_bytes(x[:8], "little")
            width = (n + 7) // 8
            place = np.searchsorted(which, k) + np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8, width, 8))[:n])
            for i, m in enumerate(MODELS):
                low, high = (unplanes(x, len(place), 8 + width + 4 * len(place) * (2 * i + j)).astype(np.int64) for j in (0, 1))
                others[m][place] = low | high << 32
        bits = {m: np.bincount(batch.owner, weights=x, minlength=len(batch.n)) / (batch.n + 1) for m, x in batch.losses(others).items()}
        none = batch.n == 0
        column = lambda x: pa.array(np.round(x, 6), pa.float64(), mask=none)
        return pa.table([batch.ids, pa.array(batch.n), *(column(bits[m]) for m in MODELS), column(bits["target"] - bits["background"])], schema=pa.schema(names))

    kinds = "bucket long, batch long, blob binary"
    answers = rows.groupBy("batch").applyInArrow(counted, kinds).repartition(partitions, "bucket").groupBy("bucket").applyInArrow(answered, kinds)
    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, corpus_loss double, score double"
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(scored, schema)
