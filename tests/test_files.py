"""Readers of file structure over files in a folder, read through Spark."""

import gzip
import io
import json
import pickle
import struct
import tarfile
import zipfile
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from marlstone.operators import training
from marlstone.sources import files


def tensors(**shapes):
    head, at = {"__metadata__": {"format": "pt"}}, 0
    for name, shape in shapes.items():
        n = 4 * int(np.prod(shape))
        head[name] = {"dtype": "F32", "shape": list(shape), "data_offsets": [at, at + n]}
        at += n
    raw = json.dumps(head).encode()
    return struct.pack("<Q", len(raw)) + raw + bytes(at)


def test_parquet(spark, tmp_path):
    table = pa.table({"a": list(range(5000)), "b": [f"x{k % 7}" for k in range(5000)], "c": [None, 1.5] * 2500})
    pq.write_table(table, tmp_path / "t.parquet", row_group_size=2000, compression="zstd", data_page_size=4096)
    want = duckdb.sql(f"select row_group_id, path_in_schema, num_values, total_compressed_size, total_uncompressed_size from parquet_metadata('{tmp_path}/t.parquet')").fetchall()
    got = files.parquet_chunks(spark, str(tmp_path)).collect()
    assert sorted((r.row_group, r.path, r.n_values, r.compressed, r.uncompressed) for r in got) == sorted(want) and {r.codec for r in got} == {"ZSTD"}
    pages = files.parquet_pages(spark, str(tmp_path)).collect()
    for chunk in got:
        own = [p for p in pages if (p.row_group, p.path) == (chunk.row_group, chunk.path)]
        assert sum(p.n_values for p in own if p.kind.startswith("data")) == chunk.n_values and [p.page for p in own] == list(range(len(own)))


def test_checkpoint(spark, tmp_path):
    (tmp_path / "a.safetensors").write_bytes(tensors(x=(2, 3), y=(4,)))
    (tmp_path / "b.safetensors").write_bytes(tensors(z=(5,), extra=(1,)))
    (tmp_path / "model.safetensors.index.json").write_text(json.dumps({"metadata": {"total_size": 60}, "weight_map": {"x": "a.safetensors", "y": "b.safetensors", "z": "b.safetensors", "lost": "b.safetensors"}}))
    got = {r.name: (r.file, r.problem) for r in files.checkpoint(spark, str(tmp_path)).collect()}
    assert got == {"x": ("a.safetensors", None), "y": ("a.safetensors", "misplaced"), "z": ("b.safetensors", None), "lost": ("b.safetensors", "missing"), "extra": ("b.safetensors", "unlisted")}
    (tmp_path / "c.safetensors").write_bytes(struct.pack("<Q", 1 << 40) + b"{}")
    with pytest.raises(Exception, match="c.safetensors: no tensor header"):
        files.tensor_headers(spark, str(tmp_path / "c.safetensors")).collect()


def test_gguf(spark, tmp_path):
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    data = b"GGUF" + struct.pack("<IQQ", 3, 1, 2) + text("a") + struct.pack("<I", 8) + text("v") + text("b") + struct.pack("<IIQ", 9, 4, 2) + struct.pack("<II", 1, 2)
    (tmp_path / "m.gguf").write_bytes(data + text("blk.0") + struct.pack("<IQQIQ", 2, 32, 4, 8, 64))
    assert [tuple(r) for r in files.gguf_headers(spark, str(tmp_path)).collect()] == [("m.gguf", "blk.0", [32, 4], 8, 64)]
    (tmp_path / "m.gguf").write_bytes(b"GGUF" + struct.pack("<IQQ", 9, 0, 0))
    with pytest.raises(Exception, match="unknown version"):
        files.gguf_headers(spark, str(tmp_path)).collect()


def test_containers(spark, tmp_path):
    import zstandard

    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        info = tarfile.TarInfo("in/t.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("b.tar.gz", gzip.compress(tar.getvalue()))
    (tmp_path / "x.zst").write_bytes(zstandard.compress(inner.getvalue()))
    (tmp_path / "z.bin").write_bytes(zlib.compress(b"plain"))
    (tmp_path / "y.bin").write_bytes(b"\x78\x01 not a stream")
    got = {(r.file, r.member): (r.size, r.crc32) for r in files.container_members(spark, str(tmp_path)).collect()}
    assert got == {("x.zst", "!zst/a.txt"): (5, zlib.crc32(b"hello")), ("x.zst", "!zst/b.tar.gz!gz/in/t.txt"): (3, zlib.crc32(b"abc")), ("z.bin", "!zlib"): (5, zlib.crc32(b"plain")), ("y.bin", ""): (15, zlib.crc32(b"\x78\x01 not a stream"))}


def test_tensor_storages(spark, tmp_path):
    # What a saved module holds, with stand-ins of the classes' names.
    call = lambda module, name: b"c" + module.encode() + b"\n" + name.encode() + b"\n"
    storage = lambda key, n: b"(" + b"X\x07\x00\x00\x00storage" + call("torch", "FloatStorage") + pickle.dumps(key, 2)[2:-1] + b"X\x03\x00\x00\x00cpu" + b"K" + bytes([n]) + b"tQ"
    tensor = lambda key, n, offset, shape: call("torch._utils", "_rebuild_tensor_v2") + b"(" + storage(key, n) + b"K" + bytes([offset]) + b"(" + b"".join(b"K" + bytes([s]) for s in shape) + b"t" + b"(t\x89" + b"}tR"
    body = b"\x80\x02}(X\x01\x00\x00\x00w" + tensor("0", 6, 0, (2, 3)) + b"X\x01\x00\x00\x00b" + tensor("1", 4, 1, (3,)) + b"u."
    with zipfile.ZipFile(tmp_path / "m.pt", "w") as z:
        z.writestr("m/data.pkl", body)
        z.writestr("m/data/0", b"A" * 24)
        z.writestr("m/data/1", b"B" * 16, zipfile.ZIP_DEFLATED)
    raw = (tmp_path / "m.pt").read_bytes()
    got = {r.name: r for r in files.tensor_storages(spark, str(tmp_path)).collect()}
    assert (got["w"].shape, got["w"].kind, got["w"].bytes) == ([2, 3], "float", 24) and raw[got["w"].begin:got["w"].begin + 24] == b"A" * 24
    assert (got["b"].shape, got["b"].offset, got["b"].bytes, got["b"].begin) == ([3], 1, 16, None)
    with zipfile.ZipFile(tmp_path / "m.pt", "w") as z:
        z.writestr("m/data.pkl", b"cos\nsystem\n(X\x02\x00\x00\x00ls\x85R.")
    with pytest.raises(Exception, match="os.system is no part of a tensor file"):
        files.tensor_storages(spark, str(tmp_path)).collect()


def test_merges(spark):
    pieces = ["a", "b", "c", "ab", "bc", "abc", "abcab"]
    frame = lambda scores: spark.createDataFrame(list(zip(range(len(pieces)), pieces, scores)), "id long, piece string, score double")
    got = [(r.left, r.right) for r in training.merges_from_scores(frame([0.0, 0.0, 0.0, 5.0, 4.0, 9.0, 9.0])).orderBy("rank").collect()]
    assert got == [("abc", "ab"), ("ab", "c"), ("a", "bc"), ("a", "b"), ("b", "c")]
    got = [(r.left, r.right) for r in training.merges_from_scores(frame([0.0] * 7)).orderBy("rank").collect()]
    assert got == [("a", "b"), ("b", "c"), ("a", "bc"), ("ab", "c"), ("abc", "ab")]


def test_cover_takes_what_is_frequent():
    draw = np.random.default_rng(1)
    noise = lambda n: bytes(draw.integers(0, 256, n, dtype=np.uint8))
    one, two = noise(64), noise(64)
    got = training.cover([noise(300) + one + noise(200), one + noise(400) + two, noise(100) + two + two + noise(300)], 128)
    assert len(got) == 128 and sum(part in one + two + two for part in (got[k:k + 20] for k in range(0, 128, 4))) > 10
    assert training.cover([b"short"], 128) == b"" and training.cover([one], 10) == b""


def test_feedback_rounding_loses_less():
    draw = np.random.default_rng(2)
    mixed = draw.normal(size=(400, 4)) @ draw.normal(size=(4, 16)) + 0.1 * draw.normal(size=(400, 16))
    h, w = mixed.T @ mixed / 400, draw.normal(size=(16, 32))
    loss = lambda q: float(np.einsum("ij,ik,kj->", w - q, h, w - q))
    plain = training.feedback_rounding(w, np.eye(16), 3)
    assert loss(training.feedback_rounding(w, h, 3)) < 0.7 * loss(plain)
