"""The pipeline's stages against plain Python on the smallest tables."""

import collections
import os
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from marlstone.llm import decontaminate, near_duplicates, packing, quality, secrets

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def passes(text):
    """The quality rules in plain Python."""
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    n = len(words)
    windows = [tuple(words[k:k + 3]) for k in range(n - 2)]
    often = collections.Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    if n < 50 or 100 * len(repeated) > 50 * n:
        return False
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    share = lambda k: k / len(lines) if lines else 0
    return (n <= 100_000 and 2 <= sum(map(len, words)) / n <= 20 and sum(c in "#*$%&|<>" for c in text) / n <= 0.1
            and sum(w.lower() in quality.STOP_WORDS for w in words) / n >= 0.02 and share(len(lines) - len(set(lines))) <= 0.5
            and share(sum(x.lstrip(" ")[:1] in tuple("-*•") for x in lines)) <= 0.9 and share(sum(x.rstrip(" ").endswith(("...", "…")) for x in lines)) <= 0.5)


def packed_rightly(rows, docs):
    """Every piece of every document is placed once, as the library gives its ids, without gaps; how many sequences."""
    library = packing.encoder("word_bpe_49k.json").library
    want = []
    for i, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(i, k // 4096, k, len(ids[k:k + 4096]), zlib.crc32(np.array(ids[k:k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        assert [a for a, _ in sorted(places)] == [0, *np.cumsum([n for _, n in sorted(places)])[:-1]] and sum(n for _, n in places) <= 4096
    return len(held)


def components(texts, percent):
    """Least index that each text reaches over links of full sets."""
    sets = [set(near_duplicates.shingles(t or "").tolist()) for t in texts]
    root = list(range(len(sets)))
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if near_duplicates.linked(len(a & b), len(a), len(b), percent):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_stages_on_awkward_rows(spark):
    """Null ids and texts, repeated rows, ties and very long texts, and columns with names that the stages use."""
    draw = random.Random(9)
    words = [f"word{k}" for k in range(900)] + ["the", "of", "and"] * 60
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    item = " ".join(f"item{k}" for k in range(30))
    base = [prose(200) for _ in range(6)]
    texts = [None, "", " \n ", *base, base[0], base[1] + " tail", base[2].replace("the", "a", 1), f"{base[3]} {item}", f"{prose(200)} password = hunter2hunter2", prose(60_000), "the of and " * 80, "# " * 60, base[5].upper()]
    # ids rise with the place, but two rows have none and one row is there twice
    rows = [(None if k in (3, 12) else k, t, "en", "s", str(len(t or "")), k, "x", 1.0, "y") for k, t in enumerate(texts)]
    rows.append(rows[4])
    schema = "doc_id long, text string, lang string, source string, n_chars string, _items int, `a.b` string, items double, gone string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    bench = spark.createDataFrame([(1, item), (2, None), (None, "x"), (3, " ")], "item_id long, text string")
    bench.write.parquet(f"{(folder := spark.conf.get('spark.checkpoint.dir', '/tmp/marlstone-checkpoints'))}/awkward-{os.getpid()}/benchmark.parquet", mode="overwrite")
    sf_dir = f"{folder}/awkward-{os.getpid()}"
    key = lambda r: (repr(r[0]), repr(r[1]), r[5])
    now = sorted(rows, key=key)
    for (name, stage), empty in zip(corpus_pipeline.STAGES[:-1], [docs.limit(0)] * 4, strict=True):
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_items", "a.b", "items", "gone"]
        assert stage(spark, empty, sf_dir).count() == 0
        if name == "quality rules":
            want = [r for r in now if passes(r[1])]
        elif name == "near duplicates":
            known = sorted({r[0]: r[1] for r in now if r[0] is not None}.items())
            root = components([t for _, t in known], 80)
            keep = {known[k][0] for k in set(root)}
            want = [r for r in now if r[0] is None or r[0] in keep]
        elif name == "benchmark decontamination":
            want = [r for r in now if item not in (r[1] or "")]
        else:
            want = [(*r[:1], secrets.redact(r[1]), *r[2:]) for r in now]
        got = sorted(map(tuple, docs.collect()), key=key)
        assert got == sorted(want, key=key), name
        now = want
    assert len(now) >= 6 and any(r[0] is None for r in now) and "[SECRET]" in " ".join(r[1] for r in now)
    packed = corpus_pipeline.packing_stage(spark, docs, sf_dir).collect()
    packed_rightly(packed, [(r[0], r[1]) for r in now])
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), sf_dir).count() == 0


def test_no_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from marlstone import session

    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    cluster = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(cluster(master))
    assert session.shared_dir(cluster("local[4]"))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(bench)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        assert set(now) <= set(rows)
        if name == "quality rules":
            assert set(now) == {i for i, t in rows.items() if passes(t)}
        if name == "near duplicates":
            known = sorted(rows.items())
            assert set(now) == {known[k][0] for k in components([t for _, t in known], 80)}
        if name == "benchmark decontamination":
            assert set(now) == {i for i, t in rows.items() if not matcher.find(t)}
        if name == "secret scans":
            assert now == {i: secrets.redact(t) for i, t in rows.items()}
        rows = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    sequences = packed_rightly(packed, list(rows.items()))
    assert sequences <= 1.1 * -(-sum(r.length for r in packed) // 4096) + 1


def test_near_duplicates_at_80(spark, monkeypatch):
    """The stage against brute force, over families whose lists are long and hold far members."""
    monkeypatch.setattr(near_duplicates, "LIST", 4)
    draw = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    common = [draw.choice(words) for _ in range(140)]
    texts = []
    for _ in range(12):  # families share 140 words; each adds 60 to 160, and its members edit up to 6 words
        own = common + [draw.choice(words) for _ in range(draw.randrange(60, 160))]
        for _ in range(6):
            copy = list(own)
            for _ in range(draw.randrange(7)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    sets = [set(near_duplicates.shingles(t).tolist()) for t in texts]
    root = list(range(len(sets)))
    between = 0
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if near_duplicates.linked(len(a & b), len(a), len(b), 80):
                between += not near_duplicates.linked(len(a & b), len(a), len(b), 85)
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    pivot = sets[0]
    assert between and any(len(s - pivot) > 0.34 * len(s) for s in sets)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_duplicates.near_duplicates(docs, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))
    kept = corpus_pipeline.dedup_stage(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == set(root)


def test_rounds_of_common_lines(spark, monkeypatch):
    """Texts dealt from a few common lines take few rounds, and only the first one reads the table for texts."""
    draw = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    lines = [" ".join(draw.choice(words) for _ in range(40)) for _ in range(10)]
    texts = ["\n".join(draw.sample(lines, 3)) for _ in range(400)]
    read, refine = [], near_duplicates._refine

    def seen(star, documents, *rest):
        read.append(documents.inputFiles())
        assert len(read) <= 4
        return refine(star, documents, *rest)

    monkeypatch.setattr(near_duplicates, "_refine", seen)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_duplicates.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(components(texts, 85)))
    assert len(read) >= 2 and all("/star-1-texts/" in f for files in read[1:] for f in files) and all(read[1:])


def test_bounds_follow_percent():
    assert near_duplicates.bounds(85) == (27 / 48, 0.45, 0.30, 0.43, 0.25)
    for percent in range(near_duplicates.LEAST, 101):
        b, p = near_duplicates.bounds(percent), percent / 100
        assert b.near - b.far >= 1 - p - 1e-9 and (b.near_new - (1 - p)) / p >= b.far_new
        assert int(b.share * near_duplicates.K) == round(b.share * near_duplicates.K)
