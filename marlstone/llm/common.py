"""Shared helpers: written intermediate tables, batch iteration, connected components."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Ids that are broadcast at most, 8 bytes each; more of them are joined by shuffle.
FEW_IDS = 1 << 22
#: Bytes of text for which a shuffle has one partition, and its most partitions.
TASK_BYTES, MOST_PARTITIONS = 128 << 20, 100_000
#: Bytes of text that one step inside a Python worker holds in decoded form.
STEP_BYTES = 4 << 20


class Workspace:
    """Written tables of one run, in the shared folder: they cut lineage and survive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back with its schema (no inference job)."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no lazy result reads any more (a table that is not there is passed over)."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Internal column names that clash with none of ``columns``, in any case."""
    taken, made = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        made.append(name)
    return made


def quoted(name: str) -> str:
    """A column name in backticks, so that dots and blanks in it are part of it."""
    return "`" + name.replace("`", "``") + "`"


def plain(documents: DataFrame, *read: str) -> DataFrame:
    """The same columns in the same order, all but ``read`` under plain names: rows can't pass through Arrow with
    names that hold a dot. ``toDF`` with the old names brings them back."""
    names = fresh([*read], *(f"c{k}" for k in range(len(documents.columns))))
    return documents.toDF(*(c if c in read else n for c, n in zip(documents.columns, names, strict=True)))


def only(documents: DataFrame, ids: DataFrame, count: int, key: str = "doc_id") -> DataFrame:
    """Rows of ``documents`` whose ``key`` is among ``ids`` (distinct, one column of that name): up to
    FEW_IDS ids are broadcast, so that no other row is exchanged, more are joined by shuffle."""
    return documents.join(F.broadcast(ids) if count <= FEW_IDS else ids.hint("merge"), key, "left_semi")


def partitions(spark: SparkSession, size: int, most: int) -> int:
    """Partitions for ``size`` bytes of text dealt into ``most`` parts: the session's number at least (or two a core), then
    one for each TASK_BYTES, up to MOST_PARTITIONS."""
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return max(1, min(most, max(least, min(size // TASK_BYTES, MOST_PARTITIONS))))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes are dealt by their ranges, so that order by hash is order by bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.append(0, np.flatnonzero(values[1:] != values[:-1]) + 1)
    return begin, np.append(begin[1:], len(values))


def steps(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose ``column`` holds at most ``most`` bytes (a longer value stands alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        array = batch.column(batch.schema.get_field_index(column))
        lengths = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i in range(n):
            if i > begin and held + lengths[i] > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += lengths[i]
        yield batch.slice(begin, n - begin)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's values as str; null becomes the empty string."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def components(edges: DataFrame, work: Workspace, name: str = "components", rounds: int | None = None) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long) as rows (node, component = least node).

    Alternating large-star and small-star steps: every node's neighbours are re-hung on the least
    of them. A node's neighbours are never gathered; each step is a combinable ``min`` and a join on
    the node, whose skew adaptive execution splits. Each round is a written table, so a lost executor
    costs one round at most; the old one is deleted. Rounds go with the logarithm of the longest path;
    ``rounds`` bounds them only where the caller asks for it. Edges with a null end and loops are ignored; an
    empty input gives no rows.
    """
    clean = edges.where("a is not null and b is not null and a != b")
    now = work.save(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before = None
    for turn in itertools.count(1):
        if rounds is not None and turn > rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small_in = large.where("a != b")
        low = small_in.groupBy("a").agg(F.min("b").alias("m"))
        joined = small_in.join(low, "a")
        small = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        new = work.save(small.where("a != b").distinct(), f"{name}-{turn}")
        state = new.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
        work.drop(f"{name}-{turn - 1}")
        now = new
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
