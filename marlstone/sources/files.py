"""Readers of file structure: Parquet footers and pages, tensor headers, containers.

Files are read through Spark (``binaryFile``), so any path that Spark can open will do; only headers
are kept. A damaged file gives an error that names it.
"""

from __future__ import annotations

import gzip
import io
import json
import pickle
import struct
import tarfile
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _each(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for f in frames:
            out = []
            for p, c in zip(f["path"], f["content"], strict=True):
                try:
                    out += [(p.rsplit("/", 1)[-1], *r) for r in rows(c)]
                except (ValueError, KeyError, IndexError, struct.error, OSError, EOFError, zipfile.BadZipFile, pickle.UnpicklingError) as e:
                    raise ValueError(f"{p}: {e}") from e
            yield pd.DataFrame(out, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def parquet_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Row groups x column chunks: codec, values, sizes and the writer's string."""
    def rows(data: bytes):
        import pyarrow.parquet as pq

        meta = pq.ParquetFile(io.BytesIO(data)).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                x = meta.row_group(g).column(c)
                yield g, x.path_in_schema, x.physical_type, x.compression, x.num_values, x.total_compressed_size, x.total_uncompressed_size, meta.created_by

    return _each(spark, path, rows, "file string, row_group long, path string, kind string, codec string, n_values long, compressed long, uncompressed long, writer string")


class _Compact:
    """Just enough of Thrift's compact protocol to read page headers."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return n >> 1 ^ -(n & 1)

    def value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            self.at += 1
            return self.data[self.at - 1]
        if kind in (4, 5, 6):
            return self.zigzag()
        if kind == 7:
            self.at += 8
            return struct.unpack("<d", self.data[self.at - 8:self.at])[0]
        if kind == 8:
            n = self.varint()
            self.at += n
            return self.data[self.at - n:self.at]
        if kind in (9, 10):
            head = self.data[self.at]
            self.at += 1
            n = head >> 4 if head >> 4 != 15 else self.varint()
            return [self.value(head & 15) for _ in range(n)]
        if kind == 12:
            return self.struct()
        raise ValueError(f"unknown type {kind}")

    def struct(self) -> dict:
        out, field = {}, 0
        while head := self.data[self.at]:
            self.at += 1
            field = field + (head >> 4) if head >> 4 else self.zigzag()
            out[field] = self.value(head & 15)
        self.at += 1
        return out


PAGES = {0: "data", 1: "index", 2: "dictionary", 3: "data_v2"}


def parquet_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page headers of each column chunk: kind, encoding, values and sizes."""
    def rows(data: bytes):
        import pyarrow.parquet as pq

        meta = pq.ParquetFile(io.BytesIO(data)).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                x = meta.row_group(g).column(c)
                at = x.dictionary_page_offset if x.dictionary_page_offset else x.data_page_offset
                end, k = at + x.total_compressed_size, 0
                while at < end:
                    reader = _Compact(data, at)
                    head = reader.struct()
                    own = head.get(5) or head.get(7) or head.get(8) or {}
                    yield g, x.path_in_schema, k, PAGES.get(head[1], "other"), own.get(2 if head[1] != 3 else 4), own.get(1), head[3], head[2]
                    at, k = reader.at + head[3], k + 1

    return _each(spark, path, rows, "file string, row_group long, path string, page long, kind string, encoding long, n_values long, compressed long, uncompressed long")


WIDTHS = {"BOOL": 1, "U8": 1, "I8": 1, "F8_E4M3": 1, "F8_E5M2": 1, "I16": 2, "U16": 2, "F16": 2, "BF16": 2, "I32": 4, "U32": 4, "F32": 4, "I64": 8, "U64": 8, "F64": 8}


def tensor_rows(data: bytes):
    """(name, dtype, shape, begin, end); ranges must agree with shapes and tile the data."""
    n = struct.unpack("<Q", data[:8])[0]
    if n > min(len(data) - 8, 100_000_000) or data[8:9] != b"{":
        raise ValueError("no tensor header")
    header = json.loads(data[8:8 + n])
    found = sorted((v["data_offsets"][0], v["data_offsets"][1], k, v["dtype"], v["shape"]) for k, v in header.items() if k != "__metadata__")
    at = 0
    for begin, end, name, dtype, shape in found:
        size = WIDTHS[dtype]
        for s in shape:
            size *= s
        if begin != at or end - begin != size:
            raise ValueError(f"{name}: range {begin}-{end} does not fit")
        at = end
        yield name, dtype, shape, begin, end
    if 8 + n + at != len(data):
        raise ValueError("data left over")


def checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    """Tensors of a checkpoint of several files: (name, file, dtype, shape, begin, end, problem).

    The index (model.safetensors.index.json) says which file holds each tensor. A tensor that its file lacks is
    "missing", one in another file "misplaced", one that the index does not name "unlisted"; else null.
    """
    index = spark.read.text(f"{folder}/model.safetensors.index.json", wholetext=True)
    named = index.select(F.explode(F.from_json(F.get_json_object("value", "$.weight_map"), "map<string, string>")).alias("name", "listed"))
    found = tensor_headers(spark, f"{folder}/*.safetensors")
    both = named.join(found, "name", "full")
    problem = F.when(F.col("file").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("file") != F.col("listed"), "misplaced")
    return both.select("name", F.coalesce("file", "listed").alias("file"), "dtype", "shape", "begin", "end", problem.alias("problem"))


class _Storages(pickle.Unpickler):
    """Reads tensors of a saved module as (storage key, element type, offset, shape), and calls nothing that it names."""

    def persistent_load(self, pid):
        kind = pid[1]
        return pid[2], kind if isinstance(kind, str) else getattr(kind, "name", "?"), pid[4]

    def find_class(self, module, name):
        if module == "torch._utils" and name.startswith("_rebuild_tensor"):
            return lambda storage, offset, shape, *_: ("tensor", storage, offset, tuple(shape))
        if module == "torch._utils" and name == "_rebuild_parameter":
            return lambda tensor, *_: tensor
        if (module, name) == ("collections", "OrderedDict"):
            return dict
        if module == "torch" and name.endswith("Storage"):
            return type(name, (), {"name": name})
        raise ValueError(f"{module}.{name} is no part of a tensor file")


def storage_rows(data: bytes):
    """(name, storage, element type, offset, shape, bytes, begin) of the tensors of a zip of storages; ``begin``
    is where the storage's bytes stand in the file, null if they are compressed."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = {i.filename: i for i in z.infolist()}
        top = next((n for n in infos if n.endswith("/data.pkl")), None)
        if top is None:
            raise ValueError("no data.pkl")
        tensors = _Storages(io.BytesIO(z.read(top))).load()
        todo = [("", tensors)]
        while todo:
            name, value = todo.pop()
            if isinstance(value, dict):
                todo += [(f"{name}.{k}" if name else str(k), v) for k, v in reversed(value.items())]
            elif isinstance(value, tuple) and value[:1] == ("tensor",):
                key, kind, _ = value[1]
                info = infos[f"{top.removesuffix('data.pkl')}data/{key}"]
                head = info.header_offset
                begin = head + 30 + sum(struct.unpack_from("<HH", data, head + 26)) if info.compress_type == zipfile.ZIP_STORED else None
                yield name, key, kind.removesuffix("Storage").lower(), value[2], list(value[3]), info.file_size, begin


def tensor_storages(spark: SparkSession, path: str) -> DataFrame:
    """Tensors of zips of storages."""
    return _each(spark, path, storage_rows, "file string, name string, storage string, kind string, offset long, shape array<long>, bytes long, begin long")


def tensor_headers(spark: SparkSession, path: str) -> DataFrame:
    """Tensors of files that open with a JSON header; several files are several shards."""
    return _each(spark, path, tensor_rows, "file string, name string, dtype string, shape array<long>, begin long, end long")


_SCALARS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}


def gguf_rows(data: bytes):
    """(name, dimensions, type, offset) of the tensors of a GGUF file."""
    if data[:4] != b"GGUF":
        raise ValueError("no GGUF file")
    at = 4

    def take(form: str):
        nonlocal at
        out = struct.unpack_from(form, data, at)[0]
        at += struct.calcsize(form)
        return out

    def text() -> str:
        nonlocal at
        n = take("<Q")
        at += n
        return data[at - n:at].decode()

    def value(kind: int):
        if kind == 8:
            return text()
        if kind == 9:
            inner, n = take("<I"), take("<Q")
            return [value(inner) for _ in range(n)]
        return take(_SCALARS[kind])

    if take("<I") not in (1, 2, 3):
        raise ValueError("unknown version")
    tensors, pairs = take("<Q"), take("<Q")
    for _ in range(pairs):
        text()
        value(take("<I"))
    for _ in range(tensors):
        name = text()
        shape = [take("<Q") for _ in range(take("<I"))]
        yield name, shape, take("<I"), take("<Q")


def gguf_headers(spark: SparkSession, path: str) -> DataFrame:
    """Tensor tables of GGUF files."""
    return _each(spark, path, gguf_rows, "file string, name string, shape array<long>, kind long, offset long")


def _inflate(data: bytes) -> bytes | None:
    """A zlib stream's content; None if the bytes only look like one."""
    try:
        return zlib.decompress(data)
    except zlib.error:
        return None


def members(data: bytes, depth: int = 4, prefix: str = ""):
    """(path, size, crc32) of what gzip, zlib, zstd, zip and tar containers hold, up to four deep."""
    if depth and data[:2] == b"\x1f\x8b":
        yield from members(gzip.decompress(data), depth - 1, prefix + "!gz")
    elif depth and data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        yield from members(zstandard.ZstdDecompressor().decompressobj().decompress(data), depth - 1, prefix + "!zst")
    elif depth and data[:1] == b"\x78" and int.from_bytes(data[:2], "big") % 31 == 0 and (plain := _inflate(data)) is not None:
        yield from members(plain, depth - 1, prefix + "!zlib")
    elif depth and data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in z.namelist():
                yield from members(z.read(name), depth - 1, f"{prefix}/{name}")
    elif depth and data[257:262] == b"ustar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t.getmembers():
                if m.isfile():
                    yield from members(t.extractfile(m).read(), depth - 1, f"{prefix}/{m.name}")
    else:
        yield prefix, len(data), zlib.crc32(data)


def container_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of container files."""
    return _each(spark, path, members, "file string, member string, size long, crc32 long")
