"""Byte-pair merging of many short sequences at once, held as ragged numpy arrays.

Every sequence applies its lowest-ranked adjacent pair in the same vector step. Equal ranks in one
sequence are taken from the left. All occurrences of a pair go in one step unless the merged symbol
could make a pair of the same or a lower rank; then only the leftmost goes, so that the order is the
sequential one in every case.

A step reads all symbols of the sequences that are not done, so sequences of more than LONG symbols are
merged one by one, each step touching only the places of its rank and their neighbours (``merge_long``).
"""

from __future__ import annotations

import heapq

import numpy as np

#: Symbols of the longest sequence that is merged together with others.
LONG = 1024
NEVER = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left symbol, right symbol) -> (rank, merged symbol), by open addressing in numpy."""

    def __init__(self, left, right, rank, merged):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        self.rank = np.append(np.asarray(rank, np.int32), NEVER)  # the last entry: no such pair
        self.merged = np.append(np.asarray(merged, np.int32), np.int32(-1))
        n = len(left)
        self.none = n
        bits = max(8, int(np.ceil(np.log2(max(n, 1) * 8))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.at = np.full(1 << bits, n, np.int32)
        keys = left << 32 | right
        slot, todo = self._slot(keys), np.arange(n)
        while len(todo):
            free = self.keys[slot[todo]] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(slot[todo], return_index=True)[1]] = True
            put = todo[free & first]
            self.keys[slot[put]], self.at[slot[put]] = keys[put], put
            todo = todo[~(free & first)]
            slot[todo] = (slot[todo] + 1) & self.mask
        symbols = int(max(self.merged.max(initial=0), left.max(initial=0), right.max(initial=0))) + 1
        best = np.full(symbols, NEVER, np.int32)  # least rank of a pair that has the symbol in it
        np.minimum.at(best, left, self.rank[:-1])
        np.minimum.at(best, right, self.rank[:-1])
        top = int(self.rank[:-1].max(initial=0)) + 1
        self.single = np.zeros(top, bool)  # ranks of which only the leftmost pair may go at once
        self.single[self.rank[:-1][best[self.merged[:-1]] <= self.rank[:-1]]] = True

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def find(self, left, right):
        """Index of each pair's entry; ``self.none`` where there is none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.at[slot], self.none)
        more = np.flatnonzero((got != keys) & (got != -1))
        while len(more):
            slot[more] = (slot[more] + 1) & self.mask
            got = self.keys[slot[more]]
            hit = got == keys[more]
            out[more[hit]] = self.at[slot[more[hit]]]
            more = more[~hit & (got != -1)]
        return out


def merge_long(symbols: np.ndarray, table: PairTable) -> np.ndarray:
    """The surviving symbols of one sequence.

    Places wait under the rank of the pair that begins there; the lowest rank is taken with all its places,
    from left to right. If one of the merges makes a pair of the same or a lower rank, those to
    the right of it wait on. Each merge costs its own place and two neighbours, whatever the length.
    """
    n = len(symbols)
    sym = np.append(np.asarray(symbols, np.int32), np.int32(-1))
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    entry, rank = np.full(n + 1, table.none, np.int64), np.full(n + 1, NEVER, np.int32)
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def place(at: np.ndarray) -> None:
        at = at[after[at] < n] if len(at) else at
        entry[at] = table.find(sym[at], sym[after[at]])
        rank[at] = table.rank[entry[at]]
        at = at[rank[at] != NEVER]
        at = at[np.argsort(rank[at], kind="stable")]
        own = rank[at]
        for some in np.split(at, np.flatnonzero(own[1:] != own[:-1]) + 1) if len(at) else ():
            wait(int(rank[some[0]]), some)

    def wait(one: int, at: np.ndarray) -> None:
        if one in waiting:
            waiting[one].append(at)
        else:
            waiting[one] = [at]
            heapq.heappush(heap, one)

    place(np.arange(n))
    while heap:
        now = heapq.heappop(heap)
        at = np.concatenate(waiting.pop(now))
        at = np.unique(at[rank[at] == now])
        if not len(at):
            continue
        if len(at) > 1:  # of overlapping pairs, every other one
            fresh = np.append(True, after[at[:-1]] != at[1:])
            step = np.arange(len(at))
            at = at[(step - np.maximum.accumulate(np.where(fresh, step, 0))) & 1 == 0]
        second, made = after[at], table.merged[entry[at]]
        third = after[second]
        if table.single[now] and len(at) > 1:
            last = np.append(-1, second[:-1])
            left = np.where(before[at] == last, np.append(made[:1], made[:-1]), sym[before[at]])
            low = (before[at] >= 0) & (table.rank[table.find(left, made)] <= now) | (third < n) & (table.rank[table.find(made, sym[third])] <= now)
            if low.any():
                stop = int(low.argmax()) + 1
                wait(now, at[stop:])
                at, second, third, made = at[:stop], second[:stop], third[:stop], made[:stop]
        sym[at] = made
        sym[second], rank[second] = -1, NEVER
        after[at], before[third] = third, at
        rank[at] = NEVER
        left = before[at]
        place(np.unique(np.append(at, left[left >= 0])))
    return sym[:n][sym[:n] >= 0]


def merge(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence to its end; returns the surviving symbols and each sequence's count."""
    symbols, lengths = np.asarray(symbols, np.int32), np.asarray(lengths, np.int64)
    long = lengths > LONG
    if not long.any():
        return _merge(symbols, lengths, table)
    short, counts = _merge(symbols[np.repeat(~long, lengths)], lengths[~long], table)
    ends, rest = np.cumsum(lengths), iter(np.split(short, np.cumsum(counts)[:-1])) if len(counts) else iter(())
    parts = [merge_long(symbols[end - n:end], table) if n > LONG else next(rest) for end, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
    return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def _merge(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    symbols, lengths = symbols.copy(), lengths.copy()
    number = np.flatnonzero(lengths)
    counts = np.zeros(len(lengths), np.int64)
    lengths = lengths[number]
    done_sym, done_seq = [], []
    while len(number):
        starts = np.cumsum(lengths) - lengths
        found = np.full(len(symbols), table.none, np.int64)
        if len(symbols) > 1:
            found[:-1] = table.find(symbols[:-1], symbols[1:])
        found[starts + lengths - 1] = table.none
        rank = table.rank[found]
        least = np.minimum.reduceat(rank, starts)
        over = least == NEVER
        if over.any():
            each = np.repeat(over, lengths)
            done_sym.append(symbols[each])
            done_seq.append(np.repeat(number[over], lengths[over]))
            counts[number[over]] = lengths[over]
            symbols, found, rank = symbols[~each], found[~each], rank[~each]
            number, lengths, least = number[~over], lengths[~over], least[~over]
            if not len(number):
                break
        owner = np.repeat(np.arange(len(number)), lengths)
        at = np.flatnonzero(rank == least[owner])
        whose = owner[at]
        leftmost = np.append(True, whose[1:] != whose[:-1])
        fresh = np.append(True, at[1:] != at[:-1] + 1)  # of overlapping pairs, every other one
        step = np.arange(len(at))
        odd = (step - np.maximum.accumulate(np.where(fresh, step, 0))) & 1
        take = np.where(table.single[least[whose]], leftmost, odd == 0)
        at, whose = at[take], whose[take]
        symbols[at] = table.merged[found[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        lengths = lengths - np.bincount(whose, minlength=len(number))
    if not done_sym:
        return np.zeros(0, np.int32), counts
    order = np.argsort(np.concatenate(done_seq), kind="stable")
    return np.concatenate(done_sym)[order], counts
