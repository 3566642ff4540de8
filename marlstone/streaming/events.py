"""Structured Streaming forms of the stateful operators, over a folder or file of events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.session import shared_dir


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def histogram(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Cumulative bucket counts by window and type, late rows dropped behind the watermark."""
    le = lambda x: F.sum((F.col("value") <= x).cast("long"))
    return (events.where("value is not null").withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
            .agg(F.count("*").alias("n"), le(1).alias("le_1"), le(10).alias("le_10"), le(100).alias("le_100"))
            .select("event_type", F.expr("unix_micros(w.start) div 3600000000").alias("hour"), "n", "le_1", "le_10", "le_100"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions by user."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def first_uses(events: DataFrame, key: list[str], late: str = "40 days") -> DataFrame:
    """Each key once: replays inside the watermark are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def newest(events: DataFrame, ttl_ms: int = 86_400_000) -> DataFrame:
    """The newest event of each user as state that expires by event time; an event older than what is held is ignored."""
    schema = "user_id long, event_id long, us long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        for f in frames:
            us = f["ts"].astype("int64") // 1000 if str(f["ts"].dtype).startswith("datetime64[ns") else f["ts"].astype("datetime64[us, UTC]").astype("int64")
            top = max(zip(us.tolist(), f["event_id"].tolist(), strict=True))
            best = top if best is None else max(tuple(best), top)
        state.update((int(best[0]), int(best[1])))
        state.setTimeoutTimestamp(max(int(best[0]) // 1000 + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "event_id": [int(best[1])], "us": [int(best[0])]})

    timed = events.withWatermark("ts", "1 day")
    return timed.groupBy("user_id").applyInPandasWithState(step, schema, "us long, event_id long", "update", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all that is there, into Parquet under the shared folder; read the result."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/marlstone/stream-{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/state").foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out/*")
