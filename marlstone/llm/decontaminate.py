"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be met with up to e errors. Cut into e + 1 pieces, at least one piece
then occurs unchanged. All pieces go into one automaton; each hit marks a window of the text in which
Myers' bit-parallel distance confirms or rejects the item.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Errors allowed per character of an item, and the least length of an item that is allowed any: a few
#: words with a letter changed are no evidence of a leak.
ERROR_RATE, SHORT = 0.05, 32
#: Bytes of item text in one broadcast; a larger benchmark is scanned in so many blocks.
BLOCK_BYTES = 8 << 20


def normal(text: str) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join(text.lower().split())


def budget(n: int, rate: float = ERROR_RATE, short: int = SHORT) -> int:
    """Errors allowed in an item of ``n`` characters; one of fewer than ``short`` must occur exactly."""
    return int(n * rate) if n >= short else 0


def cut(text: str, parts: int) -> list[tuple[int, str]]:
    """``parts`` pieces of nearly one length, with their offsets."""
    n = len(text)
    at = [n * k // parts for k in range(parts + 1)]
    return [(a, text[a:b]) for a, b in zip(at, at[1:], strict=False)]


def distance(pattern: str, text: str) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text``, bit-parallel (Myers 1999)."""
    m = len(pattern)
    if not m:
        return 0
    where: dict[str, int] = {}
    for k, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for c in text:
        eq = where.get(c, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
    return best


class Matcher:
    """Finds items in normalised texts within their error budgets."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE, short: int = SHORT):
        import ahocorasick

        self.items = [(i, normal(t)) for i, t in items]
        self.errors = [budget(len(t), rate, short) for _, t in self.items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.items):
            for offset, piece in cut(t, self.errors[k] + 1) if t else ():
                pieces.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item_id, least distance) of the items that ``text`` holds."""
        if self.empty:
            return []
        text = normal(text)
        starts: dict[int, set[int]] = {}
        for end, (n, places) in self.automaton.iter(text):
            for k, offset in places:
                starts.setdefault(k, set()).add(end - n + 1 - offset)
        found = []
        for k, at in starts.items():
            item, errors = self.items[k][1], self.errors[k]
            best, low, high = errors + 1, None, None
            for s in [*sorted(at), None]:
                if low is not None and (s is None or s > high + len(item)):
                    window = text[max(0, low - errors):high + len(item) + errors]
                    best = 0 if item in window else min(best, distance(item, window)) if errors else best
                    low = None
                if s is not None:
                    low, high = s if low is None else low, s
                if not best:
                    break
            if best <= errors:
                found.append((self.items[k][0], best))
        return sorted(found)


_matchers: dict[tuple, Matcher] = {}


def _matcher(shared, rate: float, short: int) -> Matcher:
    """The worker's matcher of a broadcast block, built once and kept until another block comes."""
    key = shared._path, rate, short
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(shared.value, rate, short)
    return _matchers[key]


def _blocks(benchmark: DataFrame, most: int):
    """Lists of (item_id, text) whose texts have at most ``most`` bytes (a longer one stands alone)."""
    block, held = [], 0
    for row in benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(row["text"].encode())
        if block and held + n > most:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += n
    yield block


def leaks(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES, short: int = SHORT) -> DataFrame:
    """Test items in every whole text: (doc_id, contaminated, item_ids, distances).

    The benchmark is the query set: it is broadcast in blocks of bounded size, and each block scans
    all documents; rows are only passed on, never shuffled. Null or empty text holds nothing; null or
    blank items match nothing; a null doc_id stays null; repeated rows give repeated results; an empty
    table gives no rows. An item of fewer than ``short`` characters must occur exactly. item_ids rise;
    distances go with them; of rows that share an item_id, each distinct text is an item.
    """
    out, items, distances = _scan(documents.select("doc_id", "text"), benchmark, rate, block_bytes, short)
    return out.select("doc_id", (F.size(items) > 0).alias("contaminated"), F.col(items).alias("item_ids"), F.col(distances).alias("distances"))


def _scan(documents: DataFrame, benchmark: DataFrame, rate: float, block_bytes: int, short: int) -> tuple[DataFrame, str, str]:
    """The documents with two more columns, items and distances, and their names."""
    from pyspark.sql import types as T

    spark = documents.sparkSession
    names = common.fresh(documents.columns, "items", "distances")
    schema = T.StructType([*documents.schema.fields, T.StructField(names[0], T.ArrayType(T.LongType())), T.StructField(names[1], T.ArrayType(T.IntegerType()))])
    first = True
    for block in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared, first=first):
            matcher = _matcher(shared, rate, short)
            for batch in common.steps(batches):
                found = [matcher.find(t) for t in common.texts(batch)]
                items, distances = [[i for i, _ in f] for f in found], [[d for _, d in f] for f in found]
                own = batch.columns if first else batch.columns[:-2]
                if not first:
                    both = [sorted(zip([*a, *i], [*b, *d], strict=True)) for a, b, i, d in zip(batch.columns[-2].to_pylist(), batch.columns[-1].to_pylist(), items, distances, strict=True)]
                    items, distances = [[i for i, _ in f] for f in both], [[d for _, d in f] for f in both]
                yield pa.RecordBatch.from_arrays([*own, pa.array(items, pa.list_(pa.int64())), pa.array(distances, pa.list_(pa.int32()))], [*batch.schema.names[:len(own)], *names])

        documents = documents.mapInArrow(run, schema)
        first = False
    return documents, *names


def decontaminate(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES, short: int = SHORT) -> DataFrame:
    """``documents`` without those that hold a test item, as ``leaks`` finds them; all columns stay, whatever
    their names. Null and empty texts stay, repeated rows stay or go together, a null doc_id is judged by its
    text, and an empty table on either side is no error."""
    rows = common.plain(documents, "text")
    out, items, distances = _scan(rows, benchmark, rate, block_bytes, short)
    return out.where(F.size(items) == 0).drop(items, distances).toDF(*documents.columns)
