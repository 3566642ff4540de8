"""Packing of tokenised documents into sequences of a fixed length.

Patterns of one to three documents that fill a sequence exactly are enumerated, their repeat counts
are fitted to the length histogram by non-negative least squares and rounded down, and what is left
over is packed by best fit on the histogram. The plan is a table of (length, range of ranks) ->
(sequence, offset); no piece ever reaches the driver.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ranked_merge import PairTable, merge

#: Rows of the plan that are broadcast at most, 40 bytes each; a longer plan is joined by shuffle.
FEW_ROWS = 1 << 20
#: Parts and words a worker remembers, and the longest of them.
REMEMBER, LONGEST = 250_000, 256
SAFE = re.compile("[!-~À-ÖØ-öø-ÿ]+")  # words that need no Unicode rules beyond one-to-one lower case
SAFE_TEXT = re.compile("[ \n\r\t!-~À-ÖØ-öø-ÿ]*")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \n\r\ta-zß-öø-ÿ0-9]+")
GAP = re.compile("[ \n\r\t]+")


class WordEncoder:
    """Ids of texts under a lower-casing byte-level BPE whose words end in a suffix.

    The vocabulary's rules cut texts into parts (runs of letters, single digits, runs of signs) and
    drop blanks; each distinct part is merged once, in numpy. That is done here for texts of plain
    Latin letters, digits and ASCII signs. Any other text is cut at blanks; its plain words are
    handled likewise, and its other words, and any with the opening of a special token, go to the
    tokenizers library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or not suffix:
            raise ValueError("only lower-casing BPE vocabularies with a word-end suffix are handled")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.table = PairTable([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], np.arange(len(pairs)), [vocab[a + b] for a, b in pairs])
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves; the rest from 256 on
        show = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.inner = np.array([vocab[show[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[show[b] + suffix] for b in range(256)], np.int32)
        self.opening = tuple(x["content"][:2] for x in spec["added_tokens"])
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _merge_parts(self, parts: list[str]) -> None:
        for begin in range(0, len(parts), 50_000):
            some = parts[begin:begin + 50_000]
            raw = [p.encode() for p in some]
            lengths = np.fromiter(map(len, raw), np.int64, len(raw))
            code = np.frombuffer(b"".join(raw), np.uint8)
            symbols = self.inner[code]
            ends = np.cumsum(lengths) - 1
            symbols[ends] = self.last[code[ends]]
            left, counts = merge(symbols, lengths, self.table)
            flat, cuts = left.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            self.parts.update(zip(some, (flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))

    def _learn(self, words: list[str]) -> None:
        plain, other = {}, []
        for w in words:
            if SAFE.fullmatch(w) and not any(x in w for x in self.opening):
                plain[w] = PARTS.findall(w.lower())
            else:
                other.append(w)
        self._merge_parts(list(set().union(*plain.values()).difference(self.parts)))
        get = self.parts.__getitem__
        for w, parts in plain.items():
            self.words[w] = b"".join(map(get, parts))
        for begin in range(0, len(other), 1000):
            for w, e in zip(other[begin:begin + 1000], self.library.encode_batch(other[begin:begin + 1000], add_special_tokens=False), strict=True):
                self.words[w] = np.asarray(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.words) > REMEMBER:
            self.words = {}
        if len(self.parts) > REMEMBER:
            self.parts = {}
        plain = [bool(SAFE_TEXT.fullmatch(t)) and not any(x in t for x in self.opening) for t in texts]
        cut = [PARTS.findall(t.lower()) if ok else GAP.split(t) for t, ok in zip(texts, plain, strict=True)]
        self._merge_parts(list(set().union(*(c for c, ok in zip(cut, plain, strict=True) if ok)).difference(self.parts)))
        new = set().union(*(c for c, ok in zip(cut, plain, strict=True) if not ok)).difference(self.words)
        new.discard("")
        self.words[""] = b""
        if new:
            self._learn(list(new))
        part, word = self.parts.__getitem__, self.words.__getitem__
        made = [b"".join(map(part if ok else word, c)) for c, ok in zip(cut, plain, strict=True)]
        for held in (self.parts, self.words):  # long ones are kept for this call only
            for w in [w for w in reversed(held) if len(w) > LONGEST] if any(len(w) > LONGEST for c in cut for w in c) else ():
                del held[w]
        return made


_encoders: dict[str, WordEncoder] = {}


def encoder(model: str) -> WordEncoder:
    """The worker's encoder for ``model`` (a path, or a name of the installed vocabularies)."""
    if model not in _encoders:
        path = model
        if "/" not in model:
            import public_tokenizers

            path = public_tokenizers.path(model)
        _encoders[model] = WordEncoder(path)
    return _encoders[model]


def pieces(documents: DataFrame, model: str, limit: int, end_id: int) -> DataFrame:
    """Tokenised pieces (doc_id, piece, start, length, ids_crc32, part, rank).

    ``rank`` counts the pieces of one length inside one scan partition ``part``.
    """
    end = int(end_id).to_bytes(4, "little")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"

    def run(batches):
        from pyspark import TaskContext

        part, seen, tally = TaskContext.get().partitionId(), {}, encoder(model)
        for batch in common.steps(batches):
            rows = ([], [], [], [], [], [], [])
            for doc, ids in zip(batch.column(0).to_pylist(), tally.encode(common.texts(batch)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    one = ids[at:at + 4 * limit]
                    n = len(one) // 4
                    rank = seen[n] = seen.get(n, -1) + 1
                    for column, value in zip(rows, (doc, k, at // 4, n, zlib.crc32(one), part, rank), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def enumerate_patterns(have: np.ndarray, limit: int, most_each: int = 12) -> np.ndarray:
    """Exact fillings of ``limit`` by one to three of the lengths that occur, longest first, padded with 0.

    Of the triples with one longest length, the ``most_each`` whose scarcer short parts are most
    frequent are kept; this bounds the columns of the fit, while documents outside stay residual.
    """
    lengths = np.flatnonzero(have)
    rows = [(limit, 0, 0)] if have[limit] else []
    for a in lengths[lengths < limit].tolist():
        rest = limit - a
        if rest <= a and have[rest]:
            rows.append((a, rest, 0))
        low, high = (rest + 1) // 2, min(a, rest - 1)
        b = np.arange(low, high + 1)
        if len(b):
            b = b[(have[b] > 0) & (have[rest - b] > 0)]
            score = np.minimum(have[b], have[rest - b])
            for x in b[np.argsort(-score, kind="stable")[:most_each]].tolist():
                rows.append((a, x, rest - x))
    return np.array(rows, np.int64).reshape(-1, 3)


def fit_repeats(patterns: np.ndarray, have: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts x with least |A x - have|^2, by accelerated projected gradients."""
    n = len(patterns)
    if not n:
        return np.zeros(0)
    target = have.astype(float)
    used = patterns > 0
    degree = np.bincount(patterns[used], minlength=len(have))
    bound = 3 * max(1, int(degree.max()))  # of the largest eigenvalue of A'A
    x = np.zeros(n)
    y, t = x, 1.0
    for _ in range(rounds):
        made = np.zeros(len(have))
        for k in range(3):
            made += np.bincount(patterns[:, k], weights=y, minlength=len(have))
        made[0] = 0
        miss = made - target
        miss[0] = 0
        new = np.maximum(0, y - miss[patterns].sum(axis=1) / bound)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (before - 1) / t * (new - x)
    return x


def plan(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, offset) that place every piece once.

    Its size depends on the number of distinct lengths, at most ``limit``, not on the documents. Two
    fits are made, with patterns of up to three and of up to two documents (triples can use up the short
    documents that long ones need); the one that needs fewer sequences is kept.
    """
    have = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        have[length] = n
    patterns = enumerate_patterns(have, limit)
    three, n3 = _plan(have, patterns, limit)
    two, n2 = _plan(have, patterns[patterns[:, 2] == 0], limit)
    return two if n2 < n3 else three


def _plan(have: np.ndarray, patterns: np.ndarray, limit: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan from some patterns, and its number of sequences."""
    left, made, sequences = have.copy(), [], 0
    used = np.zeros(limit + 1, np.int64)

    def put(lengths: list[int], repeats: int) -> None:
        nonlocal sequences
        offset = 0
        for one in lengths:
            made.append((one, int(used[one]), int(used[one] + repeats), sequences, offset))
            used[one] += repeats
            left[one] -= repeats
            offset += one
        sequences += repeats

    repeats = np.floor(fit_repeats(patterns, have) + 1e-9).astype(np.int64)
    for k in np.argsort(-repeats, kind="stable").tolist():
        lengths = [x for x in patterns[k].tolist() if x]
        n = min([int(repeats[k]), *(int(left[x]) // lengths.count(x) for x in lengths)])
        if n > 0:
            put(lengths, n)
    # Residuals by best fit on the histogram: the longest left, then ever the longest that fits.
    while left.any():
        room, lengths, taken = limit, [], left.copy()
        while room:
            fits = np.flatnonzero(taken[1:room + 1])
            if not len(fits):
                break
            best = int(fits[-1]) + 1
            lengths.append(best)
            taken[best] -= 1
            room -= best
        put(lengths, min(int(left[x]) // lengths.count(x) for x in set(lengths)))
    return made, sequences


def pack(documents: DataFrame, model: str = "word_bpe_49k.json", limit: int = 4096, end_id: int = 1) -> DataFrame:
    """Place every document's pieces in sequences of at most ``limit`` tokens.

    Returns per piece (doc_id, piece, start, length, ids_crc32, sequence_id, offset). Null or empty
    text: one piece that holds the end id. A null doc_id stays null and is packed like any other;
    repeated rows are packed each; an empty table gives no rows. Only the histogram of lengths (at
    most ``limit`` rows) reaches the driver; the plan has a few rows for each length and pattern, and is
    broadcast only if it has FEW_ROWS or fewer. Ranks are dealt by (length, scan partition), so no length is ever
    gathered in one task.
    """
    spark: SparkSession = documents.sparkSession
    work = common.Workspace(spark, "pack")
    cut = work.save(pieces(documents, model, limit, end_id), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    # Whole-number offsets of each partition's share of a length: a row for each (length, partition).
    from pyspark.sql import Window

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(histogram, limit)
    placed = spark.createDataFrame(rows, "length long, low long, high long, first long, offset long")
    ranked = cut.join(shares, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = placed.withColumnRenamed("length", "of")
    at = ranked.join(F.broadcast(placed) if len(rows) <= FEW_ROWS else placed, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return at.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("offset"))
