"""Row numbers and windows that no single task holds: rows are dealt by ranges of their order, not by group."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import shared_dir


def numbered(df: DataFrame, order: list[str], name: str, group: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``: the row's number, from 1, in ``order`` within its ``group`` (without one: of all rows).

    Rows are dealt by ranges of (group, order) and written once, so that a group of any size is spread over
    tasks; each range is numbered by itself, and the rows of the same group in earlier ranges are added. Only a
    count for each (range, group) is summed up further. ``order`` should be unique, or ties are numbered at will.
    """
    group = group or []
    keys = [*group, *order]
    path = f"{shared_dir(df.sparkSession)}/marlstone/ranks-{uuid.uuid4().hex}"
    df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = df.sparkSession.read.parquet(path)
    counts = dealt.groupBy("_range", *group).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1) if group else Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_range", *group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_range", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order])))
    same = F.lit(True)
    for c in ("_range", *group):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = inside.alias("a").join(before.alias("b"), same)
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._k") + F.col("b._before")).cast("long").alias(name))


def counted_within(df: DataFrame, group: str, at: str, reach: int, name: str, blocks: int = 30) -> DataFrame:
    """``df`` with ``name``: rows of the same ``group`` whose ``at`` lies up to ``reach`` before the row's own, itself included.

    Time is cut into blocks of ``blocks`` times ``reach``. A row goes to its own block, and a copy of it to the next one if
    that still reaches back to it, so a group is spread over as many tasks as it has blocks.
    """
    width = reach * blocks
    block = F.floor(F.col(at) / width)
    here = df.withColumn("_block", F.array(block) if reach == 0 else F.when(F.col(at) - block * width >= width - reach, F.array(block, block + 1)).otherwise(F.array(block)))
    spread = here.withColumn("_own", block).withColumn("_block", F.explode("_block"))
    window = Window.partitionBy(group, "_block").orderBy(at).rangeBetween(-reach, 0)
    return spread.withColumn(name, F.count("*").over(window)).where(F.col("_block") == F.col("_own")).drop("_block", "_own")


def nearest_rank(df: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """(group, n, then each of ``ranks``): the value at a rank from 1 (an expression of n) in ascending order; null where the rank is.

    Equal values are counted together before they are exchanged, and ranks are found on running sums
    of the counts: no group's values are gathered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    running = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("_upto", F.sum("_c").over(running)).join(counts.groupBy(group).agg(F.sum("_c").alias("n")), group)
    found = [F.min(F.when(F.col("_upto") >= rank, F.col(value))).alias(name) for name, rank in ranks.items()]
    return c.groupBy(group, "n").agg(*found)
