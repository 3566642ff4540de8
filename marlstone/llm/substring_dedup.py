"""Removal of passages that an earlier document has, with a run-compressed index of each bucket.

A string of LENGTH bytes holds LENGTH - GRAM + 1 grams; the least of their hashes is its anchor, so equal
strings have equal anchors wherever they stand. Texts fall into segments: runs of windows with one
anchor. Only segments with anchors that several documents have are exchanged, by anchor, and each
distinct one once per batch of documents. In a bucket of anchors, the segments of the earliest documents
go into a run-compressed index and the others' matching statistics are streamed over it; what the index
does not have is put into the next one. So the earliest document of each window is found, which goes back
to the batches, where the bytes are marked.

Windows of an anchor that more than ``hot`` batches have are dealt out one by one, by their own hash, so
that no bucket gathers a frequent anchor's segments.

The texts are exchanged once (by a hash of doc_id); the three passes over batches share that exchange. The
number of partitions goes with the bytes up to a bound (``common.partitions``), not with batches and buckets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import bucket_of, runs
from .run_index import NONE, RunIndex, spread, words

LENGTH, GRAM = 50, 16
#: Windows in a segment (longer runs, of repetitive text, are cut), and bytes of text in a batch.
WINDOWS, BATCH_BYTES = 64, 2 << 20
#: Bytes of segments that one index holds; further anchors of a bucket go to a further index.
INDEX_BYTES = 512 << 10
#: Batches that may have an anchor before its windows are dealt out one by one.
HOT = 4096
#: Places whose hashes are worked out at a time, so that they stay in cache.
STEP = 1 << 14
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _gram_hashes(flat: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes (two words of eight) from each place on."""
    word = words(flat)
    h = word[:-8] * _C1
    h ^= h >> np.uint64(32)
    h += word[8:]
    h *= _C2
    h ^= h >> np.uint64(29)
    h *= _C1
    h ^= h >> np.uint64(32)
    return h


def _anchors(flat: np.ndarray, length: int) -> np.ndarray:
    """Least gram hash of the ``length`` bytes from each place on."""
    width = length - GRAM + 1
    out = np.empty(len(flat) - length + 1, np.uint64)
    for a in range(0, len(out), STEP):
        b = min(a + STEP, len(out))
        h, n = _gram_hashes(flat[a:b + length - 1]), 1
        while 2 * n <= width:
            h, n = np.minimum(h[:-n], h[n:]), 2 * n
        np.minimum(h[:b - a], h[width - n:width - n + b - a], out=out[a:b])
    return out


def _window_hashes(windows: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, windows), np.uint64, len(windows))


class Batch:
    """The documents of one batch without copies of earlier texts, in order of doc_id, and their segments.

    Rows with ``first`` set carry no text; they name the documents that have a text first.
    """

    def __init__(self, rows: pa.Table, length: int):
        named = rows.filter(rows["first"])
        first = set(zip(named["doc_id"].to_pylist(), named["key"].to_pylist(), strict=True))
        own = rows.filter(pc.invert(rows["first"]))
        sizes = pc.binary_length(own["text"]).to_numpy()
        keep = [n < length or x in first for n, x in zip(sizes.tolist(), zip(own["doc_id"].to_pylist(), own["key"].to_pylist(), strict=True), strict=True)]
        own = own.filter(pa.array(keep, pa.bool_()))
        own = own.take(pc.sort_indices(own, [("doc_id", "ascending"), ("key", "ascending")]))
        self.ids = own["doc_id"].to_numpy()
        self.length = length
        sizes = pc.binary_length(own["text"]).to_numpy().astype(np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.bytes = b"".join(x.as_buffer() for x in own["text"].cast(pa.large_binary()))
        self.flat = np.frombuffer(self.bytes, np.uint8)
        self.start = self.windows = self.owner = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if len(self.flat) >= length:
            least = _anchors(self.flat, length)
            new = np.append(True, least[1:] != least[:-1])
            stop = self.ends - length + 1  # a document's windows start in [begin, stop)
            new[self.begins[self.begins < len(new)]] = True
            new[stop[(stop >= self.begins) & (stop < len(new))]] = True
            cut = np.flatnonzero(new)
            count = np.diff(np.append(cut, len(new)))
            whose = np.searchsorted(self.ends, cut, "right")
            inside = cut < stop[whose]
            cut, count, whose = cut[inside], count[inside], whose[inside]
            parts = -(-count // WINDOWS)  # repetitive text: cut long runs
            index = np.repeat(np.arange(len(cut)), parts)
            turn = np.arange(len(index)) - np.repeat(np.cumsum(parts) - parts, parts)
            self.start = cut[index] + turn * WINDOWS
            self.windows = np.minimum(WINDOWS, count[index] - turn * WINDOWS)
            self.anchor = least[self.start] * _C1  # least hashes are small numbers: spread them again
            self.owner = whose[index]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors in order, whether several documents have each, and each segment's index among them."""
        order = np.argsort(self.anchor, kind="stable")  # keeps the owners of an anchor in order
        ordered = self.anchor[order]
        new = np.append(True, ordered[1:] != ordered[:-1]) if len(order) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(order)) - 1 if len(order) else first
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        return ordered[first], self.owner[order[first]] != self.owner[order[last]], at

    def shared(self, buckets: int, lists: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct segments with shared anchors: bytes, anchors, first documents; then the starts and windows
        of all such segments and which of the distinct ones each is. Of hot anchors, each window is a segment.

        ``lists`` has for each bucket with shared anchors their flags, and after them those of hot anchors.
        """
        distinct, _, at = self.anchors()
        flag, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
        bucket = bucket_of(distinct, buckets)
        which = lists["bucket"].to_numpy()
        low, high = np.searchsorted(bucket, which), np.searchsorted(bucket, which, "right")
        for a, b, x in zip(low.tolist(), high.tolist(), lists["blob"].to_pylist(), strict=True):
            bits = np.unpackbits(np.frombuffer(x, np.uint8))
            flag[a:b], hot[a:b] = bits[:b - a], bits[b - a:2 * (b - a)]
        use = np.flatnonzero(flag[at])
        single = np.flatnonzero((flag & hot)[at])
        if len(single):
            use = np.flatnonzero((flag & ~hot)[at])
            many = self.windows[single]
            offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            start = np.append(self.start[use], np.repeat(self.start[single], many) + offset)
            windows = np.append(self.windows[use], np.ones(len(offset), np.int64))
            owner = np.append(self.owner[use], np.repeat(self.owner[single], many))
            texts = [self.bytes[a:a + self.length] for a in start[len(use):].tolist()]
            anchor = np.append(self.anchor[use], _window_hashes(texts))
        else:
            start, windows, owner, anchor = self.start[use], self.windows[use], self.owner[use], self.anchor[use]
        known: dict[bytes, int] = {}
        which = np.fromiter((known.setdefault(self.bytes[a:b], len(known)) for a, b in zip(start.tolist(), (start + windows + self.length - 1).tolist(), strict=True)), np.int64, len(start))
        # The first place of each distinct segment; of several documents in a batch the first may not be the least.
        first, place = np.full(len(known), NONE), np.zeros(len(known), np.int64)
        np.minimum.at(first, which, self.ids[owner])
        place[which[::-1]] = np.arange(len(which))[::-1]
        return list(known), anchor[place], first, start, windows, which


def mark(change: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
    """Count ranges into the differences whose running sum is the number of ranges over a place."""
    if len(begins):
        change += np.bincount(begins, minlength=len(change)) - np.bincount(ends, minlength=len(change))


def _pack(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def _promising(eights: np.ndarray, start: np.ndarray, windows: np.ndarray, anchors: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The pieces without windows that hold eight bytes which are met once only under the anchor: no other piece has those."""
    at = spread(start, windows + length - 8)
    piece = np.repeat(np.arange(len(start)), windows + length - 8)
    bits = max(12, len(at).bit_length() + 2)
    slot = ((eights[at] * _C1 ^ anchors[piece]) * _C2 >> np.uint64(64 - bits)).astype(np.int64)
    again = (np.bincount(slot, minlength=1 << bits) > 1)[slot]
    begin, end = runs(piece * 2 + again)
    go = again[begin] & (end - begin >= length - 7)
    begin, end = begin[go], end[go]
    return at[begin], end - begin - (length - 8), anchors[piece[begin]], first[piece[begin]]


def _resolve(flat: np.ndarray, eights: np.ndarray, start: np.ndarray, windows: np.ndarray, anchors: np.ndarray, first: np.ndarray, length: int, out: np.ndarray) -> None:
    """Earliest documents of the windows of pieces of ``flat``, written to ``out`` where they start.

    Of each anchor, the pieces of the earliest documents are indexed, first one, then ever more, and the
    others are streamed over the index. Windows that it has are settled, for the others' documents are not
    earlier; runs of windows that it has not go on to the next index. ``eights`` are the flat bytes' ``words``.
    """
    indexed = 1
    while len(start):
        start, windows, anchors, first = _promising(eights, start, windows, anchors, first, length)
        order = np.lexsort((first, anchors))
        start, windows, anchors, first = start[order], windows[order], anchors[order], first[order]
        begin, end = runs(anchors)
        size = np.repeat(end - begin, end - begin)
        rank = np.arange(len(anchors)) - np.repeat(begin, end - begin)
        into, rest = np.flatnonzero((size > 1) & (rank < indexed)), np.flatnonzero((size > 1) & (rank >= indexed))
        if not len(into):
            return
        cut = lambda some: (flat[spread(start[some], windows[some] + length - 1)], windows[some] + length - 1)
        index = RunIndex(*cut(into), first[into], length)
        out[spread(start[into], windows[into])] = index.own
        got = index.earliest_documents(*cut(rest))
        place = spread(start[rest], windows[rest])
        met = got != NONE
        out[place[met]] = got[met]
        piece = np.repeat(rest, windows[rest])
        begin, end = runs(piece * 2 + met)
        go = ~met[begin]
        begin, end = begin[go], end[go]
        start, windows, anchors, first = place[begin], end - begin, anchors[piece[begin]], first[piece[begin]]
        indexed *= 4


def _earliest(segments: list[bytes], anchors: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Earliest document of each window of distinct segments, and the windows of each segment; only those
    that share an anchor need an index."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    flat = np.frombuffer(b"".join(segments), np.uint8)
    eights = words(flat)
    start, windows = np.cumsum(sizes) - sizes, sizes - length + 1
    out = np.repeat(first, sizes)
    order = np.argsort(anchors, kind="stable")
    begin, end = runs(anchors[order])
    order = order[np.repeat(end - begin > 1, end - begin)]
    begin, end = runs(anchors[order])
    # Whole anchors, up to INDEX_BYTES and then one more.
    group = np.cumsum(np.add.reduceat(sizes[order], begin)) // INDEX_BYTES if len(order) else begin
    for a, b in zip(*runs(group), strict=True):
        some = order[begin[a]:end[b - 1]]
        _resolve(flat, eights, start[some], windows[some], anchors[some], first[some], length, out)
    return out[spread(start, windows)], windows


def remove_repeats(documents: DataFrame, length: int = LENGTH, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """Remove bytes covered by a string of ``length`` bytes that also starts in a document with a smaller doc_id.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256), with ``keep_text`` also ``kept`` (binary:
    the remaining bytes). Strings are judged on the input, matches never cross documents. Null text is
    empty; texts shorter than ``length`` lose nothing. A null doc_id is smaller than none and larger
    than none: such rows lose nothing and take nothing. Rows that share a doc_id do not cut each
    other. Whole copies of an earlier text are settled by their digest and not exchanged again.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    spark = documents.sparkSession
    work = common.Workspace(spark, "repeats")
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select("doc_id", text.alias("text"))
    prints = work.save(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("key")), "prints")
    least = work.save(prints.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")), "least")
    total = prints.agg(F.sum("n_bytes")).first()[0] or 0
    batches = buckets = max(1, -(-total // BATCH_BYTES))
    partitions = common.partitions(spark, total, batches)

    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch")
    rows = docs.where("doc_id is not null").select(batch, "doc_id", F.sha2("text", 256).alias("key"), "text", F.lit(False).alias("first"))
    rows = rows.unionAll(least.select(batch, "doc_id", "key", F.lit(None).cast("string").alias("text"), F.lit(True).alias("first"))).repartition(partitions, "batch")

    blob = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("blob", pa.binary())])
    kinds = "bucket long, batch long, blob binary"

    def first_pass(key, table):
        b = key[0].as_py()
        distinct, several, _ = Batch(table, length).anchors()
        bucket = bucket_of(distinct, buckets)
        # The lowest bit tells whether several documents of the batch have the anchor.
        marked = distinct & ~np.uint64(1) | several.astype(np.uint64)
        return _pack([{"bucket": int(bucket[x]), "batch": b, "blob": marked[x:y].tobytes()} for x, y in zip(*runs(bucket), strict=True)], blob)

    def which_shared(key, table):
        k = key[0].as_py()
        parts = [np.frombuffer(x, np.uint64) for x in table["blob"].to_pylist()]
        every = np.concatenate(parts)
        distinct, at, count = np.unique(every & ~np.uint64(1), return_inverse=True, return_counts=True)
        shared = count > 1
        shared[at[(every & np.uint64(1)).astype(bool)]] = True
        flags, frequent = shared[at], (count > hot)[at]
        edge = np.cumsum([0, *map(len, parts)])
        return _pack([{"bucket": k, "batch": b, "blob": np.packbits(np.append(flags[x:y], frequent[x:y])).tobytes()}
                      for b, x, y in zip(table["batch"].to_pylist(), edge[:-1], edge[1:], strict=True) if flags[x:y].any()], blob)

    def second_pass(key, table, lists):
        b = key[0].as_py()
        segments, anchors, first, *_ = Batch(table, length).shared(buckets, lists)
        bucket = bucket_of(anchors, buckets)
        order = np.argsort(bucket, kind="stable")
        sizes = np.fromiter(map(len, segments), np.uint32, len(segments))
        made = []
        for x, y in zip(*runs(bucket[order]), strict=True):
            mine, k = order[x:y], int(bucket[order[x]])
            head = np.array([len(mine)], np.uint64).tobytes() + anchors[mine].tobytes() + first[mine].tobytes() + mine.astype(np.uint32).tobytes() + sizes[mine].tobytes()
            made.append({"bucket": k, "batch": b, "blob": head + b"".join([segments[i] for i in mine.tolist()])})
        return _pack(made, blob)

    def indexed(key, table):
        k = key[0].as_py()
        known: dict[bytes, int] = {}
        anchors, first, sent = [], [], []
        for b, x in zip(table["batch"].to_pylist(), table["blob"].to_pylist(), strict=True):
            n = int(np.frombuffer(x, np.uint64, 1)[0])
            a = np.frombuffer(x, np.uint64, n, 8).tolist()
            d = np.frombuffer(x, np.int64, n, 8 + 8 * n)
            ref = np.frombuffer(x, np.uint32, n, 8 + 16 * n)
            size = np.frombuffer(x, np.uint32, n, 8 + 20 * n)
            ends = (8 + 24 * n + np.cumsum(size, dtype=np.int64)).tolist()
            which = []
            for i, (end, m, own) in enumerate(zip(ends, size.tolist(), d.tolist(), strict=True)):
                v = known.setdefault(x[end - m:end], len(known))
                if v == len(first):
                    anchors.append(a[i])
                    first.append(own)
                elif own < first[v]:
                    first[v] = own
                which.append(v)
            sent.append((b, ref, d, np.array(which)))
        segments = list(known)
        flat, sizes = _earliest(segments, np.array(anchors, np.uint64), np.array(first, np.int64), length)
        # Runs of windows with one earliest document.
        offset = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        new = np.flatnonzero((offset == 0) | np.append(True, flat[1:] != flat[:-1]))
        count = np.diff(np.append(new, len(flat)))
        whose = np.repeat(np.arange(len(sizes)), sizes)[new]
        edge = np.searchsorted(whose, np.arange(len(sizes) + 1))
        made = []
        for b, ref, d, which in sent:
            parts = edge[which + 1] - edge[which]
            row = np.repeat(np.arange(len(which)), parts)
            run = np.repeat(edge[which], parts) + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            use = flat[new[run]] < d[row]
            row, run = row[use], run[use]
            if len(row):
                made.append({"bucket": k, "batch": b, "blob": np.array([len(row)], np.uint64).tobytes() + flat[new[run]].tobytes() + ref[row].tobytes() + offset[new[run]].astype(np.uint32).tobytes() + count[run].astype(np.uint32).tobytes()})
        return _pack(made, blob)

    names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + ([("kept", pa.binary())] if keep_text else [])

    def third_pass(key, table, found):
        kept = Batch(table, length)
        lists = found.filter(pc.equal(found["kind"], 0))
        segments, _, first, start, windows, which = kept.shared(buckets, lists)
        change = np.zeros(len(kept.flat) + 1, np.int64)
        later = first[which] < kept.ids[np.searchsorted(kept.ends, start, "right")]  # a copy inside the batch
        mark(change, start[later], start[later] + windows[later] + length - 1)
        by = np.argsort(which, kind="stable")
        edge = np.searchsorted(which[by], np.arange(len(segments) + 1))
        begins, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in found.filter(pc.equal(found["kind"], 1))["blob"].to_pylist():
            n = int(np.frombuffer(x, np.uint64, 1)[0])
            ref = np.frombuffer(x, np.uint32, n, 8 + 8 * n).astype(np.int64)
            offset = np.frombuffer(x, np.uint32, n, 8 + 12 * n).astype(np.int64)
            count = np.frombuffer(x, np.uint32, n, 8 + 16 * n).astype(np.int64)
            many = edge[ref + 1] - edge[ref]
            row = np.repeat(np.arange(n), many)
            place = by[np.repeat(edge[ref], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
            begins.append(start[place] + offset[row])
            ends.append(begins[-1] + count[row] + length - 1)
        mark(change, np.concatenate(begins), np.concatenate(ends))
        gone = np.cumsum(change[:-1]) > 0
        out = []
        for d, a, b in zip(kept.ids.tolist(), kept.begins.tolist(), kept.ends.tolist(), strict=True):
            mine = gone[a:b]
            removed = int(np.count_nonzero(mine))
            left = kept.flat[a:b][~mine].tobytes() if removed else kept.bytes[a:b]
            out.append({"doc_id": d, "n_bytes": b - a, "n_removed": removed, "n_spans": int(np.count_nonzero(mine[1:] & ~mine[:-1]) + (b > a and mine[0])) if removed else 0,
                        "kept_sha256": hashlib.sha256(left).hexdigest()} | ({"kept": left} if keep_text else {}))
        return _pack(out, pa.schema(names))

    dealt = lambda d: d.repartition(partitions, "bucket").groupBy("bucket")
    sketch = rows.groupBy("batch").applyInArrow(first_pass, kinds)
    lists = dealt(sketch).applyInArrow(which_shared, kinds)
    sent = rows.groupBy("batch").cogroup(lists.groupBy("batch")).applyInArrow(second_pass, kinds)
    answers = dealt(sent).applyInArrow(indexed, kinds)
    found = lists.select("*", F.lit(0).alias("kind")).unionAll(answers.select("*", F.lit(1).alias("kind")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    main = rows.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(third_pass, schema)

    copies = prints.where(F.col("n_bytes") >= length).join(least.select("key", F.col("doc_id").alias("least")), "key").where("least < doc_id")
    zero = F.lit(0).cast("long")
    columns = ["doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256")]
    rest = ["doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")]
    if keep_text:
        columns.append(F.lit(b"").alias("kept"))
        rest.append(F.encode("text", "utf-8").alias("kept"))
    return main.unionAll(copies.select(*columns)).unionAll(docs.where("doc_id is null").select(*rest))
