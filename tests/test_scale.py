"""Steps whose time or memory once grew faster than the tables."""

import time

import numpy as np

from marlstone.operators import kernels as K
from marlstone.plans import similarity


def test_repeated_spans_of_long_texts(spark, tmp_path):
    draw = np.random.default_rng(3)
    long = [f"w{k}" for k in draw.integers(0, 1 << 40, 60_000)]
    texts = {1: long, 2: ["x"] * 40, 3: [*long[500:540], *long[:100], "y", *long[:100]], 4: ["x"] * 33, 5: long[::-1], 6: None, 7: long}
    spark.createDataFrame([(k, None if w is None else " ".join(w)) for k, w in texts.items()], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    got = {tuple(r) for r in similarity.repeated_spans(spark, str(tmp_path)).collect()}
    assert got == {(3, 9 + 69, 1), (4, 1, 2), (7, 60_000 - 31, 1)}
    assert time.monotonic() - began < 60


def plain_prefix_hits(prompts, page, capacity):
    """Every page of every prompt, in a plain list from the longest idle to the latest."""
    held, out = [], []
    for words in prompts:
        keys = [tuple(words[:k]) for k in range(page, len(words) + 1, page)]
        found = 0
        while found < len(keys) and keys[found] in held:
            found += 1
        out.append(found)
        for k in reversed(keys):
            held = [h for h in held if h != k] + [k]
        held = held[-capacity:]
    return out


def test_prefix_cache_holds_no_group(spark):
    draw = np.random.default_rng(4)
    stems = [[f"s{i}" for i in draw.integers(0, 3, 90)] for _ in range(4)]
    prompts = {k: stems[draw.integers(0, 4)][:draw.integers(0, 91)] + [f"t{i}" for i in draw.integers(0, 2, draw.integers(0, 30))] for k in range(200)}
    assert K.prefix_hits(list(prompts.values()), 2, 12) == plain_prefix_hits(prompts.values(), 2, 12)
    rows = spark.createDataFrame([(k % 3 or None, k, " ".join(w) if k else None) for k, w in prompts.items()], "g long, k long, t string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = K.prefix_cache(rows, "g", "k", "t", 2, 12)
        got = {(r.g, r.k): r.pages for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for g in range(3):
        ids = [k for k in prompts if k % 3 == g]
        want |= {(g or None, k): n for k, n in zip(ids, plain_prefix_hits([prompts[k] if k else [] for k in ids], 2, 12))}
    assert got == want
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString()


def test_replay_holds_no_group(spark):
    draw = np.random.default_rng(5)
    trace = [(int(k % 3) or None, k // 2, int(draw.integers(0, 40) ** 2 // 100)) for k in range(900)]
    rows = spark.createDataFrame(trace, "g long, at long, v long").repartition(5)
    seeds = spark.createDataFrame([(1, [3, 5, 0]), (7, [1])], "g long, seed array<long>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = K.replay_cache(rows, "g", ["at"], "v", (2, 5), seeds)
        got = {tuple(r) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    of = {g: [v for _, _, v in sorted((x for x in trace if x[0] == g), key=lambda x: x[1:])] for g in (None, 1, 2)}
    assert got == {(g, p, s, len(t), K.cache_hits(t, s, p, [3, 5, 0] if g == 1 else None)) for g, t in of.items() for p in ("lru", "lfu") for s in (2, 5)}
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString()


def test_events_of_one_file_are_dealt_out(spark):
    from marlstone.plans import records

    rows = records._events(spark, "/root/testdata/sf0.001", "props")
    assert "REPARTITION_BY_COL" in rows._jdf.queryExecution().executedPlan().toString()


def test_plain_numbers_keep_their_form():
    from marlstone.functions import records as R

    assert [R._plain_number(x) for x in (1e15, 1e16, 123456789012345680.0, 1e-4, 1.5e-5, 1e-7, -0.0, -2.0, 0.1, 1e21, -12.5)] == ["1000000000000000", "10000000000000000", "123456789012345680", "0.0001", "0.000015", "1e-7", "0", "-2", "0.1", "1e+21", "-12.5"]


def test_prints_are_made_once(spark):
    """One pass over the texts for the prints; their numbers as built-in functions make them."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, " a  b\tc d é f g h a b c d é"), (2, "x x x x x x"), (3, None), (4, "a b c d é f"), (5, "a b")], "doc_id long, text string")
    w = docs.select("doc_id", F.expr(similarity._WORDS).alias("w")).where("size(w) >= 5").selectExpr("doc_id", "w", "explode(sequence(1, size(w) - 4)) as i")
    want = w.selectExpr("doc_id", "i - 1 as pos", "cast(conv(substring(sha2(array_join(slice(w, i, 5), ' '), 256), 1, 15), 16, 10) as long) as h", "size(array_distinct(slice(w, i, 5))) > 1 as several")
    for every in (1, 4):
        assert {tuple(r) for r in similarity.placed_prints(docs, 5, every).collect()} == {tuple(r) for r in want.where(f"h % {every} = 0").collect()}
    assert similarity.scored(docs)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
