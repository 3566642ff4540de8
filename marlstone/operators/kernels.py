"""Numeric kernels and ordered folds that built-in expressions cannot state; each works on one bounded group."""

from __future__ import annotations

import hashlib
import heapq
from bisect import insort
from collections import Counter, OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recency_rank(frame: pd.DataFrame, size: int = 64) -> list[int]:
    """Move-to-front places of values in order; -1 for one that is not among the last ``size``."""
    recent: list = []
    out = []
    for v in frame:
        k = recent.index(v) if v in recent else -1
        out.append(k)
        if k >= 0:
            recent.pop(k)
        recent.insert(0, v)
        del recent[size:]
    return out


def mtf_rank(rows: DataFrame, group: str, order: list[str], value: str, size: int = 64) -> DataFrame:
    """Recency rank of ``value`` within each group, in the given order."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order)
        return f[[group, *order]].assign(rank=np.array(recency_rank(f[value].tolist(), size), np.int64))

    kinds = dict(rows.dtypes)
    return rows.select(group, *order, value).groupBy(group).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (group, *order)) + ", rank long")


def prefix_code_lengths(counts: list[int], limit: int | None = None) -> list[int]:
    """Code lengths of an optimal prefix code, none above ``limit``; 0 for symbols that do not occur, and for one that is alone.

    Package-merge: coins of each symbol's count are paired ``limit`` times, and each of the 2 (n - 1) cheapest
    packages adds one to the lengths of the symbols in it.
    """
    used = [k for k, c in enumerate(counts) if c > 0]
    lengths = [0] * len(counts)
    if len(used) <= 1:
        return lengths
    limit = limit or len(used) - 1
    if 1 << limit < len(used):
        raise ValueError(f"{len(used)} symbols have no code of {limit} bits")
    coins = sorted((counts[k], (k,)) for k in used)
    row = coins
    for _ in range(limit - 1):
        pairs = [(row[i][0] + row[i + 1][0], row[i][1] + row[i + 1][1]) for i in range(0, len(row) - 1, 2)]
        row = sorted(coins + pairs, key=lambda x: x[0])
    for _, symbols in row[:2 * (len(used) - 1)]:
        for k in symbols:
            lengths[k] += 1
    return lengths


def prefix_code_bits(counts: list[int], limit: int | None = None) -> int:
    """Total bits of an optimal prefix code, with ``limit`` of one whose lengths are bounded; one symbol alone takes none."""
    if limit:
        return sum(c * n for c, n in zip(counts, prefix_code_lengths(counts, limit), strict=True))
    heap = [int(c) for c in counts if c > 0]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def huffman_bits(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Bits of an optimal prefix code of ``value`` per group, from its histogram, and of one of at most 11 bits (null: more symbols than that has codes)."""
    histogram = rows.groupBy(group, value).count()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({group: [f[group].iloc[0]], "n": [int(f["count"].sum())], "bits": [prefix_code_bits(f["count"].tolist())], "limited": pd.array([prefix_code_bits(f["count"].tolist(), 11) if len(f) <= 1 << 11 else None], dtype="Int64")})

    return histogram.groupBy(group).applyInPandas(run, f"{group} {dict(rows.dtypes)[group]}, n long, bits long, limited long")


RATIOS = np.linspace(0.70, 1.0, 16)


def bf16(x: float) -> np.float32:
    """A number with the eight significant bits of bfloat16, ties to even."""
    bits = np.float32(x).view(np.uint32)
    return ((bits + np.uint32(0x7FFF) + (bits >> np.uint32(16) & np.uint32(1))) & np.uint32(0xFFFF0000)).view(np.float32)


def fit_scale(x: np.ndarray, bits: int) -> tuple[float, np.ndarray]:
    """Scale, a bfloat16, and symmetric codes of a run with least squared error among 16 ratios of its largest magnitude."""
    top = (1 << (bits - 1)) - 1
    most = float(np.abs(x).max()) if len(x) else 0.0
    if most == 0:
        return 0.0, np.zeros(len(x), np.int64)
    best = None
    for r in RATIOS:
        scale = float(bf16(most * r / top))
        codes = np.clip(np.rint(x / scale), -top, top)
        error = float(((codes * scale - x) ** 2).sum())
        if best is None or error < best[0]:
            best = error, scale, codes.astype(np.int64)
    return best[1], best[2]


def quantise_runs(vectors: DataFrame, key: str, array: str, bits: int = 4, run_length: int = 32) -> DataFrame:
    """(key, run, scale, codes) of runs of each vector."""
    def run(frames):
        for f in frames:
            rows = []
            for k, v in zip(f[key], f[array], strict=True):
                x = np.asarray(v if v is not None else [], np.float64)
                for i in range(0, len(x), run_length):
                    scale, codes = fit_scale(x[i:i + run_length], bits)
                    rows.append((k, i // run_length, round(scale, 9), codes.tolist()))
            yield pd.DataFrame(rows, columns=[key, "run", "scale", "codes"])

    return vectors.select(key, array).mapInPandas(run, f"{key} {dict(vectors.dtypes)[key]}, run long, scale double, codes array<long>")


def lloyd_max(values: np.ndarray, weights: np.ndarray, levels: int = 8, passes: int = 25) -> np.ndarray:
    """Weighted one-dimensional k-means from uniform -1..1; an empty level stays."""
    book = np.linspace(-1.0, 1.0, levels)
    for _ in range(passes):
        at = np.searchsorted((book[1:] + book[:-1]) / 2, values)
        mass = np.bincount(at, weights=weights, minlength=levels)
        total = np.bincount(at, weights=weights * values, minlength=levels)
        book = np.where(mass > 0, total / np.where(mass > 0, mass, 1), book)
    return book


def codebooks(vectors: DataFrame, group: str, array: str, levels: int = 8) -> DataFrame:
    """A codebook per group from a histogram of its entries, scaled to -1..1 (2048 bins, a bounded group)."""
    flat = vectors.select(group, F.explode(array).alias("x")).where("x is not null and not isnan(x)")
    tops = flat.groupBy(group).agg(F.max(F.abs("x")).alias("top"))
    bins = flat.join(tops, group).select(group, "top", F.floor((F.col("x") / F.when(F.col("top") > 0, F.col("top")).otherwise(1) + 1) * 1023.5).alias("bin")).groupBy(group, "top", "bin").count()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        book = lloyd_max((f["bin"].to_numpy(float) + 0.5) / 1023.5 - 1, f["count"].to_numpy(float), levels) * f["top"].iloc[0]
        return pd.DataFrame({group: [f[group].iloc[0]] * levels, "level": np.arange(levels), "value": np.round(book, 6)})

    return bins.groupBy(group).applyInPandas(run, f"{group} {dict(vectors.dtypes)[group]}, level long, value double")


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of rows whose length is a power of two."""
    n = x.shape[-1]
    y, h = x.astype(np.float64).copy(), 1
    while h < n:
        y = y.reshape(len(x), -1, 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return y / np.sqrt(n)


def rotate(vectors: DataFrame, key: str, array: str, seed: int = 7) -> DataFrame:
    """Vectors with random signs, then rotated; null and other lengths than a power of two give null."""
    def run(frames):
        for f in frames:
            out = []
            for v in f[array]:
                n = 0 if v is None else len(v)
                if not n or n & (n - 1):
                    out.append(None)
                else:
                    sign = np.random.default_rng(seed).choice([-1.0, 1.0], n)
                    out.append(np.round(hadamard((np.asarray(v, float) * sign)[None])[0], 6).tolist())
            yield pd.DataFrame({key: f[key], "rotated": out})

    return vectors.select(key, array).mapInPandas(run, f"{key} {dict(vectors.dtypes)[key]}, rotated array<double>")


def greedy_budget(options: pd.DataFrame, budget: float) -> pd.DataFrame:
    """Upgrades (item, level, cost, gain) in order of gain per cost, each item a level at a time, while they fit."""
    steps = {i: g.sort_values("level")[["level", "cost", "gain"]].to_numpy() for i, g in options.groupby("item")}
    heap = [(-s[0][2] / s[0][1], i, 0) for i, s in steps.items() if len(s)]
    heapq.heapify(heap)
    level, spent = dict.fromkeys(steps, 0), 0.0
    while heap:
        _, i, k = heapq.heappop(heap)
        cost = steps[i][k][1]
        if spent + cost > budget:
            continue
        spent += cost
        level[i] = int(steps[i][k][0])
        if k + 1 < len(steps[i]):
            heapq.heappush(heap, (-steps[i][k + 1][2] / steps[i][k + 1][1], i, k + 1))
    return pd.DataFrame({"item": list(level), "level": list(level.values())})


def allocate(options: DataFrame, group: str, budget: float) -> DataFrame:
    """``greedy_budget`` for each group of options (group, item, level, cost, gain)."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        return greedy_budget(f, budget).assign(**{group: f[group].iloc[0]})[[group, "item", "level"]]

    return options.groupBy(group).applyInPandas(run, f"{group} {dict(options.dtypes)[group]}, item long, level long")


class Cache:
    """An LRU or LFU cache that a trace is fed to part by part. LFU drops the value used least in the whole trace so far (uses
    before an eviction count on), the longest untouched of several. ``seed`` fills the cache first, up to its size."""

    def __init__(self, size: int, policy: str, seed: list | None = None):
        self.size, self.policy, self.hits = size, policy, 0
        self.held: OrderedDict = OrderedDict.fromkeys((seed or [])[:size])
        self.uses: Counter = Counter()

    def feed(self, trace: list) -> None:
        held, uses, lru = self.held, self.uses, self.policy == "lru"
        for x in trace:
            if x in held:
                self.hits += 1
                held.move_to_end(x)
            else:
                if len(held) >= self.size:
                    held.pop(next(iter(held)) if lru else min(held, key=uses.__getitem__))
                held[x] = None
            if not lru:
                uses[x] += 1


def cache_hits(trace: list, size: int, policy: str, seed: list | None = None) -> int:
    """Hits of a cache over a trace."""
    cache = Cache(size, policy, seed)
    cache.feed(trace)
    return cache.hits


def _in_order(rows: DataFrame, group: str, order: list) -> DataFrame:
    """Each group's rows in one task, one after the other in ``order``; sorted by Spark, so that no task holds a group."""
    return rows.repartition(group).sortWithinPartitions(group, *order)


def _runs(batch, group: str):
    """(value of ``group``, its rows) for each run of equal values in a batch."""
    ends = pc.run_end_encode(batch.column(group))
    begin = 0
    for value, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
        yield value, batch.slice(begin, end - begin)
        begin = end


def replay_cache(rows: DataFrame, group: str, order: list[str], value: str, sizes=(4, 16), seeds: DataFrame | None = None) -> DataFrame:
    """(group, policy, size, n, hits) of a cache replay over each group's trace. A cache's state depends on all that came
    before, so a group's trace is one task's, as a stream: a task holds the caches, uses of each value and one batch. Rows that
    ``order`` leaves open go by their value. ``seeds`` (group, seed: list) start from a profile; their values come before the trace."""
    kinds = dict(rows.dtypes)
    schema = f"{group} {kinds[group]}, policy string, size long, n long, hits long"

    def run(batches):
        now, seed, n, caches = None, [], 0, []

        def done(kind):
            made = [[now] * len(caches), [c.policy for c in caches], [c.size for c in caches], [n] * len(caches), [c.hits for c in caches]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, (kind, pa.string(), pa.int64(), pa.int64(), pa.int64()))], [group, "policy", "size", "n", "hits"])

        for batch in batches:
            kind = batch.schema.field(group).type
            for key, part in _runs(batch, group):
                if key != now:
                    if caches:
                        yield done(kind)
                    now, seed, n, caches = key, [], 0, []
                values, first = part.column(value).to_pylist(), len(part) - part.column("_seed").null_count
                seed += values[:first]
                if first < len(values):
                    caches = caches or [Cache(s, p, seed) for p in ("lru", "lfu") for s in sizes]
                    trace = values[first:]
                    n += len(trace)
                    for cache in caches:
                        cache.feed(trace)
        if caches:
            yield done(kind)

    by = list(dict.fromkeys((*order, value)))
    trace = rows.select(group, *by, F.lit(None).cast("int").alias("_seed"))
    if seeds is not None:
        start = seeds.where(F.col(group).isNotNull()).select(group, F.posexplode("seed").alias("_seed", value))
        trace = trace.unionByName(start.select(group, "_seed", *[value if c == value else F.lit(None).cast(kinds[c]).alias(c) for c in by]))
    return _in_order(trace, group, [F.col("_seed").asc_nulls_last(), *by]).select(group, value, "_seed").mapInArrow(run, schema)


def chained_keys(words: list[str], page: int, most: int) -> list[bytes]:
    """Digests of the first ``most`` whole pages of a text, each over the one before."""
    keys, key = [], b""
    for i in range(0, min(len(words) - page + 1, most * page), page):
        key = hashlib.blake2b(key + "\0".join(words[i:i + page]).encode(), digest_size=16).digest()
        keys.append(key)
    return keys


class PrefixCache:
    """A prefix cache of chained keys that is fed one prompt after the other; the longest idle page goes first, ends before starts.

    After a prompt its first pages are the latest touched, so of one with more than ``capacity`` pages just the first
    ``capacity`` stay, and no more can be found: later pages of a prompt change nothing and need not be given.
    """

    def __init__(self, capacity: int):
        self.capacity, self.held = capacity, OrderedDict()

    def feed(self, keys: list[bytes]) -> int:
        held, found = self.held, 0
        while found < len(keys) and keys[found] in held:
            found += 1
        for k in reversed(keys):  # the chain's start is the last to go
            held[k] = True
            held.move_to_end(k)
        while len(held) > self.capacity:
            held.popitem(last=False)
        return found


def prefix_hits(prompts: list[list], page: int = 16, capacity: int = 64) -> list[int]:
    """Pages of each prompt found in a prefix cache."""
    cache = PrefixCache(capacity)
    return [cache.feed(chained_keys(words, page, capacity)) for words in prompts]


def prefix_cache(rows: DataFrame, group: str, order: str, text: str, page: int = 16, capacity: int = 64) -> DataFrame:
    """(group, order, pages found) of each text, in order, against the group's prefix cache. Keys are made where a text is read;
    only they go to the group's task, which holds one batch and the cache."""
    kinds = dict(rows.dtypes)
    head = f"{group} {kinds[group]}, {order} {kinds[order]}"

    def keyed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # words of so many texts at a time
                part = batch.slice(at, 512)
                keys = [b"".join(chained_keys((t.as_py() or "").split(), page, capacity)) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary())], [group, order, "keys"])

    def run(batches):
        now, cache = None, None
        for batch in batches:
            pages = []
            for key, part in _runs(batch, group):
                if cache is None or key != now:
                    now, cache = key, PrefixCache(capacity)
                pages += [cache.feed([k[i:i + 16] for i in range(0, len(k), 16)]) for k in part.column("keys").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(group), batch.column(order), pa.array(pages, pa.int64())], [group, order, "pages"])

    return _in_order(rows.select(group, order, text).mapInArrow(keyed, f"{head}, keys binary"), group, [order]).mapInArrow(run, f"{head}, pages long")


ADMISSION = {("new", "prepare"): "preparing", ("preparing", "commit"): "committing", ("committing", "done"): "ready", ("ready", "release"): "releasing",
             ("releasing", "drained"): "released", ("preparing", "abort"): "released", ("committing", "abort"): "released"}


def admission_states(verbs: list[str], times: list[int], deadline: int) -> list[str]:
    """States of a two-phase admission; a wrong step is refused, a late one releases."""
    state, since, out = "new", None, []
    for verb, at in zip(verbs, times, strict=True):
        if state in ("preparing", "committing") and since is not None and at - since > deadline:
            state = "released"
        following = ADMISSION.get((state, verb))
        if following is None:
            out.append("refused")
            continue
        state, since = following, at
        out.append(state)
        if state == "released":
            state, since = "new", None
    return out


def admissions(rows: DataFrame, group: str, order: list[str], verb: str, time: str, deadline: int) -> DataFrame:
    """State after each step of each group's admission."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order)
        return f[[group, *order]].assign(state=admission_states(f[verb].tolist(), f[time].tolist(), deadline))

    kinds = dict(rows.dtypes)
    return rows.groupBy(group).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (group, *order)) + ", state string")


def schedule(arrivals: list[tuple[int, int, int]], pages: int, chunk: int = 32) -> tuple[list[tuple[int, int, int, int]], int]:
    """Continuous batching over (id, prompt, new): each tick reaps, admits by free pages, prefills a chunk, decodes.

    A sequence that needs a page when none is free makes the newest give its pages back and wait anew.
    Returns rows (id, first tick, last tick, times preempted) and the number of ticks.
    """
    waiting, running, done, tick = list(arrivals), [], [], 0
    need = lambda tokens: -(-tokens // 16) + 1
    preempted: dict[int, int] = {}
    while waiting or running:
        tick += 1
        running, over = [r for r in running if r["made"] < r["new"]], [r for r in running if r["made"] >= r["new"]]
        done += [(r["id"], r["start"], tick, preempted.get(r["id"], 0)) for r in over]
        used = sum(need(r["read"] + r["made"]) for r in running)
        while waiting and used + need(waiting[0][1]) <= pages or waiting and not running:
            i, prompt, new = waiting.pop(0)
            running.append({"id": i, "prompt": prompt, "new": new, "read": 0, "made": 0, "start": tick})
            used += need(prompt)
        for r in running:
            if r["read"] < r["prompt"]:
                r["read"] = min(r["prompt"], r["read"] + chunk)
                break
        for r in running:
            if r["read"] == r["prompt"]:
                r["made"] += 1
        while len(running) > 1 and sum(need(r["read"] + r["made"]) for r in running) > pages:
            r = running.pop()
            preempted[r["id"]] = preempted.get(r["id"], 0) + 1
            waiting.insert(0, (r["id"], r["prompt"], r["new"]))
    return done, tick


def simulate_batches(rows: DataFrame, group: str, pages: int = 24) -> DataFrame:
    """``schedule`` for each group of requests (group, id, prompt, new), in order of id."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        done, _ = schedule(list(f.sort_values("id")[["id", "prompt", "new"]].itertuples(index=False, name=None)), pages)
        return pd.DataFrame(done, columns=["id", "start_tick", "end_tick", "preempted"]).assign(**{group: f[group].iloc[0]})[[group, "id", "start_tick", "end_tick", "preempted"]]

    return rows.groupBy(group).applyInPandas(run, f"{group} {dict(rows.dtypes)[group]}, id long, start_tick long, end_tick long, preempted long")


def assign_queue(items: list[tuple[int, int, int]], per_client: int, per_model: int, slots: int) -> list[tuple[int, bool]]:
    """Scan a queue (id, client, model) in order; start an item unless its client, its model or all slots are at their limit."""
    clients: dict[int, int] = {}
    models: dict[int, int] = {}
    out, started = [], 0
    for i, c, m in items:
        ok = started < slots and clients.get(c, 0) < per_client and models.get(m, 0) < per_model
        if ok:
            started += 1
            clients[c], models[m] = clients.get(c, 0) + 1, models.get(m, 0) + 1
        out.append((i, ok))
    return out


def assign_queues(rows: DataFrame, group: str, per_client: int = 2, per_model: int = 8, slots: int = 24) -> DataFrame:
    """``assign_queue`` for each group's queue (group, id, client, model)."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        got = assign_queue(list(f.sort_values("id")[["id", "client", "model"]].itertuples(index=False, name=None)), per_client, per_model, slots)
        return pd.DataFrame(got, columns=["id", "started"]).assign(**{group: f[group].iloc[0]})[[group, "id", "started"]]

    return rows.groupBy(group).applyInPandas(run, f"{group} {dict(rows.dtypes)[group]}, id long, started boolean")


def change_point(data: np.ndarray, segment: int = 64, margin: float = 0.02) -> int | None:
    """The cut between segments of bytes where two parts cost least together, if that saves ``margin``."""
    def cost(counts):
        n = counts.sum()
        c = counts[counts > 0]
        return float(n * np.log2(n) - (c * np.log2(c)).sum()) if n else 0.0

    parts = [np.bincount(data[i:i + segment], minlength=256) for i in range(0, len(data), segment)]
    if len(parts) < 2:
        return None
    low = np.cumsum(parts, axis=0)
    whole = cost(low[-1])
    costs = [cost(low[k]) + cost(low[-1] - low[k]) for k in range(len(parts) - 1)]
    k = int(np.argmin(costs))
    return (k + 1) * segment if costs[k] < (1 - margin) * whole else None


def change_points(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cut) of each text's bytes; null where no cut pays."""
    def run(frames):
        for f in frames:
            yield pd.DataFrame({key: f[key], "cut": pd.array([change_point(np.frombuffer((t or "").encode(), np.uint8)) if t else None for t in f[text]], dtype="Int64")})

    return rows.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, cut long")


def grid_fit(x: np.ndarray, y: np.ndarray, rounds: int = 6, steps: int = 21) -> tuple[float, float, float]:
    """a, b of y = a x^b with least squared log error, by a grid that narrows round its best point."""
    keep = (x > 0) & (y > 0)
    lx, ly = np.log(x[keep]), np.log(y[keep])
    if not len(lx):
        return 0.0, 0.0, 0.0
    centre, width = np.array([ly.mean(), 0.0]), np.array([10.0, 3.0])
    best = np.inf
    for _ in range(rounds):
        for axis in (0, 1, 0, 1):
            grid = np.linspace(centre[axis] - width[axis], centre[axis] + width[axis], steps)
            errors = [float(((ly - (g if axis == 0 else centre[0]) - (g if axis == 1 else centre[1]) * lx) ** 2).mean()) for g in grid]
            centre[axis], best = grid[int(np.argmin(errors))], min(errors)
        width = width / 4
    return float(np.exp(centre[0])), float(centre[1]), float(best)


def calibrate(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, n, a, b, error) of ``grid_fit`` on each group's averaged points (group, x, y)."""
    points = rows.groupBy(group, x).agg(F.avg(y).alias(y))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(x)
        a, b, e = grid_fit(f[x].to_numpy(float), f[y].to_numpy(float))
        return pd.DataFrame({group: [f[group].iloc[0]], "n": [len(f)], "a": [round(a, 6)], "b": [round(b, 6)], "error": [round(e, 6)]})

    return points.groupBy(group).applyInPandas(run, f"{group} {dict(rows.dtypes)[group]}, n long, a double, b double, error double")


def clopper_pearson(k: int, n: int, alpha: float) -> tuple[float, float]:
    """Exact binomial limits with ``alpha`` in each tail, by bisection on the binomial tail."""
    from math import exp, lgamma, log

    def tail(p: float, j: int) -> float:  # P(X >= j)
        if p <= 0:
            return float(j <= 0)
        if p >= 1:
            return 1.0
        return sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p)) for i in range(j, n + 1))

    def solve(f) -> float:
        a, b = 0.0, 1.0
        for _ in range(60):
            m = (a + b) / 2
            a, b = (m, b) if f(m) else (a, m)
        return (a + b) / 2

    low = 0.0 if k == 0 else solve(lambda p: tail(p, k) < alpha)
    high = 1.0 if k == n else solve(lambda p: 1 - tail(p, k + 1) > alpha)
    return low, high


def partitions(layers: np.ndarray, speeds: dict[int, float], room: dict[int, float], most: int = 3, keep: int | None = None) -> list[tuple[float, str]]:
    """Contiguous cuts of layers over up to ``most`` different nodes that fit, by bottleneck; the best ``keep``, or all.

    With ``keep`` a cut is given up as soon as its slowest part is slower than the worst of those kept.
    """
    total = np.append(0, np.cumsum(layers))
    n = len(layers)
    found: list[tuple[float, str]] = []

    def extend(at: int, used: tuple[int, ...], cuts: tuple[int, ...], worst: float) -> None:
        if keep and len(found) >= keep and round(worst, 6) > found[keep - 1][0]:
            return
        if at == n:
            insort(found, (round(worst, 6), ",".join(f"{u}:{c}" for u, c in zip(used, cuts, strict=True))))
            if keep:
                del found[keep:]
            return
        if len(used) == most:
            return
        for node in sorted(speeds):
            if node in used:
                continue
            for end in range(n if len(used) == most - 1 else at + 1, n + 1):
                size = total[end] - total[at]
                if size > room[node]:
                    break
                extend(end, (*used, node), (*cuts, end), max(worst, float(size / speeds[node])))

    extend(0, (), (), 0.0)
    return found
