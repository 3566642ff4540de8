"""A run-compressed Burrows-Wheeler index of bounded order, and matching statistics streamed over it."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).max
_MIX = np.uint64(0x9E3779B97F4A7C15)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def words(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    out = np.empty(max(len(flat) - 7, 0), np.uint64)
    for k in range(min(8, len(out))):
        out[k::8] = np.frombuffer(flat, "<u8", (len(flat) - k) // 8, k)
    return out


class RunIndex:
    """Index of byte strings whose rows are sorted by their first ``depth`` or more bytes.

    Rows that share their first ``depth`` bytes are a class; its answer is the earliest document in which
    those bytes start. A class follows another if its rows are just the other's rows moved one byte
    to the left, with the same answer: its rows lie in one run, so nothing is kept for it. Kept are the
    texts, the runs of the transform with the text positions of their first and last rows, and samples at
    both ends of each chain of classes: rows and answer of its first and its last class. What is kept besides
    the texts goes with runs and chains; the suffix array is only needed to build it. Texts are UTF-8:
    byte 0xFF, which ends the index, must not be in them. ``own`` holds the answers of the indexed
    texts' windows, text by text. Texts come as one array of bytes and their lengths.
    """

    def __init__(self, texts: np.ndarray, lengths: np.ndarray, documents: np.ndarray, depth: int):
        self.depth = depth
        flat = self.flat = np.append(texts, np.full(2 * depth + 16, 255, np.uint8))
        n = len(flat)
        order, same = self._sort(flat, depth)
        before = flat[order - 1]
        first = np.append(0, np.flatnonzero(before[1:] != before[:-1]) + 1)
        last = np.append(first[1:], n) - 1
        char = before[first].astype(np.int64)
        self.run_first, self.run_char = first, char
        by = np.argsort(char, kind="stable")  # runs by character, then by row
        size = (last - first + 1)[by]
        self.moved = np.empty(len(first), np.int64)  # where a run's rows are, moved one byte to the left
        self.moved[by] = np.cumsum(size) - size
        self.key = char[by] * (n + 1) + first[by]
        self.by = by
        self.first_at, self.last_at, self.run_last = order[first], order[last], last
        bits = max(12, n.bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        self.has = np.zeros(1 << bits, bool)  # eight bytes that are not marked here are not in the texts
        self.has[words(flat) * _MIX >> self.shift] = True
        # Classes and their answers.
        begin = np.append(0, np.flatnonzero(~same) + 1)
        end = np.append(begin[1:], n)
        owner = np.full(n, NONE)
        ends = np.cumsum(lengths)
        count = np.maximum(lengths - depth + 1, 0)
        inside = spread(ends - lengths, count)
        owner[inside] = np.repeat(documents, count)
        answer = np.minimum.reduceat(owner[order], begin)
        group = np.empty(n, np.int64)  # class of each place
        group[order] = np.repeat(np.arange(len(begin)), end - begin)
        self.own = answer[group[inside]]
        # The class that each class is moved to, if all of its rows are in one run.
        one = np.searchsorted(first, begin, "right") == np.searchsorted(first, end - 1, "right")
        to = group[order[begin] - 1]
        chain = one & (end - begin == (end - begin)[to]) & (answer == answer[to])
        head = np.ones(len(begin), bool)
        head[to[chain]] = False
        self.head_first, self.head_end, self.head_answer = begin[head], end[head], answer[head]
        self.tail_first, self.tail_end, self.tail_answer = begin[~chain], end[~chain], answer[~chain]

    @staticmethod
    def _sort(flat: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows in order of more than their first ``depth`` bytes (the end wraps round), by doubling,
        and whether each row shares its first ``depth`` bytes with the next."""
        n = len(flat)
        wide = np.append(flat, flat[:8]).astype(np.uint64)
        width = min(8, 1 << (depth.bit_length() - 1))
        key = np.zeros(n, np.uint64)
        for k in range(width):
            key = key << np.uint64(8) | wide[k:n + k]
        whole = None
        while True:
            order = np.argsort(key)
            sorted_key = key[order]
            step = np.append(0, sorted_key[1:] != sorted_key[:-1]).cumsum()
            rank = np.empty(n, np.uint64)
            rank[order] = step.astype(np.uint64)
            if width <= depth < 2 * width:
                tail = np.roll(rank, width - depth)  # two ranges of ``width`` that overlap make ``depth``
                whole = rank, tail
            if step[-1] == n - 1 and whole is None:
                return order, np.zeros(n - 1, bool)
            if width > depth or step[-1] == n - 1:
                break
            key = rank << np.uint64(32) | np.roll(rank, -width)
            width *= 2
        head, tail = whole
        return order, (head[order[1:]] == head[order[:-1]]) & (tail[order[1:]] == tail[order[:-1]])

    def _left(self, row: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Rows moved one byte to the left in their texts."""
        return self.moved[run] + row - self.run_first[run]

    def _walk(self, row: np.ndarray) -> np.ndarray:
        """Answers of the classes that hold the rows: on to the left, up to the last class of each chain."""
        out, todo = np.empty(len(row), np.int64), np.arange(len(row))
        while len(todo):
            at = np.maximum(np.searchsorted(self.tail_first, row, "right") - 1, 0)
            ended = (self.tail_first[at] <= row) & (row < self.tail_end[at])
            out[todo[ended]] = self.tail_answer[at[ended]]
            todo, row = todo[~ended], row[~ended]
            row = self._left(row, np.searchsorted(self.run_first, row, "right") - 1)
        return out

    def _jump(self, row: np.ndarray, char: np.ndarray, text: np.ndarray, at: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest rows that ``char`` precedes, above or below, whichever shares more of the ``held``
        bytes of ``text`` matched from ``at`` on: their runs, rows, and the bytes shared (-1: no row has the character)."""
        below = np.searchsorted(self.key, char * (len(self.flat) + 1) + row)
        best, run, place = np.full(len(row), -1), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for side, rows, spots in ((below - 1, self.run_last, self.last_at), (below, self.run_first, self.first_at)):
            there = np.flatnonzero((side >= 0) & (side < len(self.by)))
            one = self.by[side[there]]
            fits = self.run_char[one] == char[there]
            there, one = there[fits], one[fits]
            shared = self._common(text, at[there], spots[one], held[there])
            more = shared > best[there]
            there, one = there[more], one[more]
            best[there], run[there], place[there] = shared[more], one, rows[one]
        return run, place, best

    def _common(self, text: np.ndarray, at: np.ndarray, spot: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes, up to ``most``, that ``text`` from ``at`` on shares with the indexed texts from ``spot`` on."""
        out, todo, done = most.copy(), np.arange(len(at)), 0
        for width in sorted({min(6, self.depth), self.depth}):
            reach = np.arange(done, width)
            same = text[at[todo, None] + reach] == self.flat[np.minimum(spot[todo, None] + reach, len(self.flat) - 1)]
            miss = np.where(same.all(axis=1), width, done + same.argmin(axis=1))
            out[todo] = np.minimum(miss, most[todo])
            todo, done = todo[(miss == width) & (most[todo] > width)], width
        return out

    def _parts(self, texts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the parts of texts all of whose eight-byte strings the index may have."""
        ends = np.cumsum(lengths)
        if self.depth < 8 or len(texts) < 8:
            return ends - lengths, ends
        there = np.append(self.has[words(texts) * _MIX >> self.shift], np.zeros(8, bool))  # the last: an end
        over = ends[:-1]
        for k in range(1, 8):
            there[over[over >= k] - k] = False  # these would cross into the next text
        edge = np.flatnonzero(np.append(there[0], there[1:] != there[:-1]))
        begins, ends = edge[::2], edge[1::2] + 7
        keep = ends - begins >= self.depth
        return begins[keep], ends[keep]

    def earliest_documents(self, texts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For every ``depth``-byte window, text by text: the earliest document that has it, or NONE.

        Matching statistics, up to ``depth``: texts are read backwards, all at once, a character a step. A
        text holds a row that matches its last bytes; if the next character precedes that row, both move
        on, else the match goes over to the nearest row that has the character and shares the most.
        A match that enters a chain inside it learns its answer at the end (``_walk``); one that goes on
        keeps its answer until another chain begins. Texts are cut where they have eight bytes that
        no indexed text has, and read no further once what matches and what is left make no window.
        """
        depth = self.depth
        flat = np.append(texts, np.zeros(depth, np.uint8))
        begins, ends = self._parts(texts, lengths)
        parts = ends - begins
        live = np.flatnonzero(parts >= depth)
        row, held, answer = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), np.full(len(parts), NONE)
        found = np.full(len(flat), NONE)
        open_rows, opened = [np.zeros(0, np.int64)], 0  # a negative answer -k stands for the k-th of these
        for step in range(int(parts.max(initial=0))):
            left = parts[live] - step
            live = live[(left > 0) & (held[live] + left >= depth)]
            if not len(live):
                break
            at = ends[live] - 1 - step
            char, now, size = flat[at].astype(np.int64), row[live], held[live]
            run = np.searchsorted(self.run_first, now, "right") - 1
            gone = self.run_char[run] != char
            other = np.flatnonzero(gone)
            if len(other):
                run[other], now[other], shared = self._jump(now[other], char[other], flat, at[other] + 1, np.minimum(size[other], depth - 1))
                size[other] = shared
            now = self._left(now, run)
            now[size < 0] = 0
            gone |= held[live] < depth
            size = np.minimum(size + 1, depth)
            full = np.flatnonzero(size == depth)
            if len(full):
                who, here = live[full], now[full]
                k = np.searchsorted(self.head_first, here, "right") - 1
                head = (k >= 0) & (here < self.head_end[k])
                answer[who[head]] = self.head_answer[k[head]]
                new = np.flatnonzero(~head & gone[full])
                if len(new):
                    open_rows.append(here[new])
                    answer[who[new]] = -(opened + 1 + np.arange(len(new)))
                    opened += len(new)
                found[at[full]] = answer[who]
            row[live], held[live] = now, size
        if opened:
            known = self._walk(np.concatenate(open_rows))
            late = np.flatnonzero(found < 0)
            found[late] = known[-found[late] - 1]
        return found[spread(np.cumsum(lengths) - lengths, np.maximum(lengths - depth + 1, 0))]
