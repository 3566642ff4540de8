"""WARC records, and a Merkle audit that locates where two replicas of an archive differ."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Pages in one volume, bits of an offset that a leaf covers, and bits by which each level widens.
VOLUME, LEAF_BITS, LEVEL_BITS, LEVELS = 1024, 16, 8, 2
#: The upper 8 bits of an entry's hash deal the records of one page id into parts.
PART_SHIFT = 56


def render(pages: DataFrame) -> DataFrame:
    """Pages as WARC/1.0 resource records: (volume, page_id, entry, slot, record).

    A volume holds VOLUME consecutive page ids; pages with null ids are spread over volumes of
    negative number by content. ``entry`` identifies the content, ``slot`` is the space that the
    archive's index gives to the record. Null url or html are written as empty; an empty table gives
    no records.
    """
    d = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
                    F.lit(">\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    record = F.encode(F.concat(head, F.col("html"), F.lit("\r\n\r\n")), "utf-8")
    entry = F.xxhash64("url", "html")
    volume = F.coalesce(F.floor(F.col("page_id") / VOLUME), -1 - F.pmod(entry, F.lit(1 << 20)))
    return d.select(volume.alias("volume"), "page_id", entry.alias("entry"), F.octet_length(record).cast("long").alias("slot"), record.alias("record"))


def damaged(records: DataFrame) -> DataFrame:
    """A replica with known damage, by page id: one byte changed in 1 of 97 records, the second half
    lost of 1 in 211, and 1 in 307 lost altogether."""
    hit = lambda n, k: F.coalesce(F.pmod("page_id", F.lit(n)) == k, F.lit(False))
    front = F.expr("substring(record, 1, cast(slot / 2 as int))")
    flipped = F.concat(front, F.lit(b"\x00"), F.expr("substring(record, cast(slot / 2 as int) + 2, cast(slot as int))"))
    record = F.when(hit(97, 13), flipped).when(hit(211, 7), front).when(hit(307, 11), F.lit(None).cast("binary")).otherwise(F.col("record"))
    return records.withColumn("record", record)


def digests(records: DataFrame) -> DataFrame:
    """What a replica holds: (volume, page_id, offset, length, sha256), equal records once.

    Offsets are the index's: running sums of slots inside a volume, by page_id and entry. Bytes are
    hashed where they are read; only digests and lengths are exchanged. A record that is null is lost
    and gets no row.
    """
    d = records.select("volume", "page_id", "entry", "slot", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256")).distinct()
    # Sums in two steps: of the parts of each page id by hash, then inside each part, so that no task
    # holds all records of one page id.
    d = d.withColumn("part", F.shiftright("entry", PART_SHIFT))
    parts = d.groupBy("volume", "page_id", "part").agg(F.sum("slot").alias("bytes"))
    ahead = Window.partitionBy("volume").orderBy("page_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("volume", "page_id", "part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("volume", "page_id", "part").orderBy("entry", "slot").rowsBetween(Window.unboundedPreceding, -1)
    same = (F.col("d.volume") == F.col("p.volume")) & F.col("d.page_id").eqNullSafe(F.col("p.page_id")) & (F.col("d.part") == F.col("p.part"))
    d = d.withColumn("within", F.coalesce(F.sum("slot").over(inside), F.lit(0)))
    placed = d.alias("d").join(parts.alias("p"), same).select("d.*", (F.col("p.begin") + F.col("d.within")).alias("offset"))
    return placed.where("sha256 is not null").select("volume", "page_id", "offset", "length", "sha256")


def tree(leaves: DataFrame, work: common.Workspace, name: str) -> list[DataFrame]:
    """Levels (volume, node, hash) of a Merkle tree over the records' offset ranges, leaves first, roots last.

    A leaf is a range of 2^LEAF_BITS bytes of a volume and hashes the (offset, length, digest) of the
    records that start in it; a node hashes its up to 2^LEVEL_BITS children in order. The root's node
    covers the whole volume. A missing record changes its own range only. What a node gathers is
    bounded by its range of bytes.
    """
    entry = F.struct("offset", "length", "sha256", F.coalesce(F.col("page_id").cast("string"), F.lit("none")).alias("id"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat_ws(":", e["offset"].cast("string"), e["length"].cast("string"), e["sha256"], e["id"])), "\n")
    levels = [work.save(leaves.groupBy("volume", F.shiftright("offset", LEAF_BITS).alias("node")).agg(F.sha2(text, 256).alias("hash")), f"{name}-0")]
    for k in range(LEVELS):
        up = F.shiftright("node", LEVEL_BITS) if k < LEVELS - 1 else F.lit(0).cast("long")
        child = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda e: F.concat_ws(":", e["node"].cast("string"), e["hash"])), "\n")
        levels.append(work.save(levels[-1].groupBy("volume", up.alias("node")).agg(F.sha2(child, 256).alias("hash")), f"{name}-{k + 1}"))
    return levels


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Compare two replicas' digests; rows (page_id, volume, offset, length, status, sha256, replica_sha256).

    Each level of both trees is written once. Roots are compared first; each further level is joined only to the children of nodes that differ,
    so records are compared only inside differing leaves. Status: corrupt (same place, other
    bytes), missing (only in the primary), extra (only in the replica). Equal replicas and empty ones give no rows; records with a null page id are compared by place.
    """
    work = common.Workspace(primary.sparkSession, "audit")
    a, b = tree(primary, work, "primary"), tree(replica, work, "replica")
    differ = None
    for k in range(LEVELS, -1, -1):
        left, right = a[k], b[k].withColumnRenamed("hash", "other")
        if differ is not None:
            up = F.shiftright("node", LEVEL_BITS) if k < LEVELS - 1 else F.lit(0).cast("long")
            parents = differ.withColumnRenamed("node", "parent")
            left = left.withColumn("parent", up).join(parents, ["volume", "parent"], "left_semi").drop("parent")
            right = right.withColumn("parent", up).join(parents, ["volume", "parent"], "left_semi").drop("parent")
        differ = left.join(right, ["volume", "node"], "full").where("not (hash <=> other)").select("volume", "node")
    inside = lambda d: d.withColumn("node", F.shiftright("offset", LEAF_BITS)).join(differ, ["volume", "node"], "left_semi").drop("node")
    key = lambda d: d.withColumn("id", F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    left = key(inside(primary))
    right = key(inside(replica)).select("volume", "offset", "id", F.col("page_id").alias("page_id_b"), F.col("length").alias("length_b"), F.col("sha256").alias("replica_sha256"))
    both = left.join(right, ["volume", "offset", "id"], "full").where("not (sha256 <=> replica_sha256) or not (length <=> length_b)")
    status = F.when(F.col("replica_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "extra").otherwise("corrupt")
    return both.select(F.coalesce("page_id", "page_id_b").alias("page_id"), "volume", "offset", F.coalesce("length", "length_b").alias("length"), status.alias("status"), "sha256", "replica_sha256")


def inflate(data: bytes) -> bytes:
    """The gzip members of ``data``, one after the other; of a damaged member what precedes the damage, then
    on from the next member's magic."""
    out, at = [], 0
    while 0 <= at < len(data):
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data[at:]))
        except zlib.error:
            piece = zlib.decompressobj(31)
            for k in range(at, len(data)):  # byte by byte, up to the damage
                try:
                    out.append(piece.decompress(data[k:k + 1]))
                except zlib.error:
                    break
            at = data.find(b"\x1f\x8b\x08", at + 1)
            continue
        if not member.eof:
            break
        at = len(data) - len(member.unused_data) if member.unused_data else -1
    return b"".join(out)


def parse(data: bytes) -> list[tuple[int, int, dict[str, str], bytes]]:
    """Records (offset, length, headers, block) of a plain or per-record gzipped WARC file.

    Offsets are in the uncompressed bytes. A truncated last record is returned with what there is. Where a
    record does not begin with WARC/, or has no whole Content-Length, reading goes on at the next line
    that begins with WARC/; such a record is left out.
    """
    if data[:2] == b"\x1f\x8b":
        data = inflate(data)
    found, at = [], 0
    while 0 <= at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            break
        headers = {}
        if data.startswith(b"WARC/", at):
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        if not re.fullmatch("[0-9]{1,18}", headers.get("content-length", "")):
            at = data.find(b"\r\nWARC/", at)
            at = at + 2 if at >= 0 else at
            continue
        n = int(headers["content-length"])
        stop = min(len(data), end + 4 + n + 4)
        found.append((at, stop - at, headers, data[end + 4:end + 4 + n]))
        at = stop
    return found


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (file, offset, length, type, target, block) of the WARC files under ``path``, plain or gzipped.

    Files of up to 2 GB, the most that Spark reads as one value; each is read by one task. Headers
    that are absent are null. Damage loses the records that it hits (``parse``, ``inflate``), not the
    job; an empty file has no records.
    """
    import pandas as pd

    def run(frames):
        for frame in frames:
            for p, c in zip(frame["path"], frame["content"], strict=True):
                rows = [(p, a, n, h.get("warc-type"), h.get("warc-target-uri"), b) for a, n, h, b in parse(bytes(c))]
                yield pd.DataFrame(rows, columns=["file", "offset", "length", "type", "target", "block"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, offset long, length long, type string, target string, block binary")
