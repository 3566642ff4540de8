import io
import json
import struct
import zipfile

import numpy as np
import pandas as pd
import pytest

from marlstone.operators import kernels as K
from marlstone.sources import files


def test_recency_rank():
    assert K.recency_rank(list("abcab"), 2) == [-1, -1, -1, -1, -1]
    assert K.recency_rank(list("aab"), 2) == [-1, 0, -1]


def test_prefix_code_bits():
    assert K.prefix_code_bits([]) == 0
    assert K.prefix_code_bits([5]) == 0
    assert K.prefix_code_bits([1, 1, 2, 4]) == 1 * 3 + 1 * 3 + 2 * 2 + 4


def test_length_limited_codes():
    from itertools import product

    draw = np.random.default_rng(4)
    for _ in range(40):
        counts = draw.integers(0, 40, draw.integers(1, 7)).tolist()
        used = [c for c in counts if c]
        assert K.prefix_code_bits(counts, 20) == K.prefix_code_bits(counts)
        for limit in (1, 2, 3):
            if 1 << limit < len(used):
                with pytest.raises(ValueError):
                    K.prefix_code_bits(counts, limit)
            elif len(used) > 1:
                best = min(sum(c * n for c, n in zip(used, lengths)) for lengths in product(range(1, limit + 1), repeat=len(used)) if sum(2.0 ** -n for n in lengths) <= 1)
                lengths = K.prefix_code_lengths(counts, limit)
                assert K.prefix_code_bits(counts, limit) == best and max(lengths) <= limit and sum(2.0 ** -n for n in lengths if n) <= 1


def test_fit_scale_is_never_worse_than_the_largest_magnitude():
    x = np.random.default_rng(1).normal(size=32)
    scale, codes = K.fit_scale(x, 4)
    plain = np.abs(x).max() / 7
    plain = float(K.bf16(plain))
    assert ((codes * scale - x) ** 2).sum() <= ((np.clip(np.rint(x / plain), -7, 7) * plain - x) ** 2).sum() + 1e-12 and float(K.bf16(scale)) == scale
    assert K.fit_scale(np.zeros(3), 4) == (0.0, pytest.approx([0, 0, 0]))


def test_hadamard_keeps_length():
    x = np.random.default_rng(2).normal(size=(3, 16))
    y = K.hadamard(x)
    assert np.allclose((y ** 2).sum(1), (x ** 2).sum(1))
    assert np.allclose(K.hadamard(y), x)


def test_greedy_budget_fits():
    options = pd.DataFrame([(i, lv, float(lv), 10.0 / (lv + i)) for i in (1, 2) for lv in (1, 2)], columns=["item", "level", "cost", "gain"])
    got = K.greedy_budget(options, 2.0).set_index("item")["level"]
    assert got.to_dict() == {1: 1, 2: 1}


def test_cache_hits():
    assert K.cache_hits([1, 2, 1, 3, 2], 2, "lru") == 1
    assert K.cache_hits([1, 1, 2, 3, 1], 2, "lfu") == 2
    # 1 was used three times before it was dropped; when it is back, those count and 2 goes first.
    trace = [1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 1, 4, 1]
    assert K.cache_hits(trace, 2, "lfu") == plain_lfu(trace, 2) == 9
    assert K.cache_hits([7, 8, 7], 2, "lru", [8, 7]) == 3 and K.cache_hits([7, 8, 9], 2, "lru", [8, 7, 9]) == 2
    draw = np.random.default_rng(6)
    for _ in range(50):
        trace = draw.integers(0, 8, 60).tolist()
        assert K.cache_hits(trace, 3, "lfu") == plain_lfu(trace, 3)


def plain_lfu(trace, size):
    """Each step by itself: uses and last touch of every held value counted from the trace."""
    held, hits = set(), 0
    touched = {}
    for t, x in enumerate(trace):
        if x in held:
            hits += 1
        else:
            if len(held) >= size:
                held.remove(min(held, key=lambda v: (trace[:t].count(v), touched[v])))
            held.add(x)
        touched[x] = t
    return hits


def test_partitions_keep_the_best():
    layers = np.random.default_rng(8).integers(1, 30, 12).astype(float)
    speeds, room = {1: 3.0, 2: 2.0, 3: 1.0}, {1: layers.sum() * 0.6, 2: layers.sum() * 0.5, 3: layers.sum() * 0.4}
    every = K.partitions(layers, speeds, room)
    assert every == sorted(every) and K.partitions(layers, speeds, room, keep=5) == every[:5]


def test_numbers_and_windows_over_ranges(spark):
    from marlstone.operators import ranks

    draw = np.random.default_rng(5)
    rows = [(int(draw.integers(0, 3)) if k % 7 else None, int(draw.integers(0, 5000)) * 1000 + k) for k in range(900)]
    df = spark.createDataFrame(rows, "g long, at long").repartition(5)
    got = ranks.numbered(df, ["at"], "k", ["g"]).collect()
    for g in {r[0] for r in rows}:
        assert [r.k for r in sorted((r for r in got if r.g == g), key=lambda r: r.at)] == list(range(1, 1 + sum(r[0] == g for r in rows)))
    assert sorted(r.k for r in ranks.numbered(df, ["at"], "k").collect()) == list(range(1, 901))
    assert ranks.numbered(df.limit(0), ["at"], "k", ["g"]).count() == 0
    near = {r.at: r.n for r in ranks.counted_within(df, "g", "at", 40_000, "n", 3).collect()}
    assert near == {t: sum(g == h and t - 40_000 <= u <= t for h, u in rows) for g, t in rows}


def test_admission_states():
    assert K.admission_states(["prepare", "commit", "done", "commit"], [0, 1, 2, 3], 10) == ["preparing", "committing", "ready", "refused"]
    assert K.admission_states(["prepare", "commit"], [0, 20], 10) == ["preparing", "refused"]


def test_schedule_finishes_everything():
    done, _ = K.schedule([(1, 40, 3), (2, 100, 9), (3, 8, 2)], 9)
    assert sorted(r[0] for r in done) == [1, 2, 3]


def test_clopper_pearson():
    low, high = K.clopper_pearson(0, 10, 0.025)
    assert low == 0 and high == pytest.approx(0.3085, abs=1e-4)


def test_change_point():
    assert K.change_point(np.array([97] * 256 + [98] * 256, np.uint8)) == 256
    assert K.change_point(np.array([97] * 512, np.uint8)) is None


def test_tensor_rows_checks_ranges():
    head = json.dumps({"a": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}}).encode()
    data = struct.pack("<Q", len(head)) + head + bytes(8)
    assert list(files.tensor_rows(data)) == [("a", "F32", [2], 0, 8)]
    with pytest.raises(ValueError):
        list(files.tensor_rows(data + b"x"))


def test_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hi")
    assert [(p, n) for p, n, _ in files.members(out.getvalue())] == [("/a.txt", 2)]
