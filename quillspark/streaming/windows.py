"""Structured Streaming: rate windows, event-time counts and running transcripts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Event files as they arrive, with ``at`` as event time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def rate_windows(events: DataFrame, seconds: int = 3600, limit: int = 5, late: str = "1 hour") -> DataFrame:
    """(user_id, start, n, over): requests of each user per aligned window, and whether they pass the limit."""
    if events.isStreaming:
        events = events.withWatermark("at", late)
    w = F.window("at", f"{seconds} seconds")
    return events.groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.col("window.start").alias("start"), "n", (F.col("n") > limit).alias("over"))


def first_hit_windows(events: DataFrame, seconds: int = 3600, limit: int = 5) -> DataFrame:
    """``events`` (user_id, event_id, ts, bytes) with start, n, used and allowed.

    A user's window begins at the first event after the last window's end; n and
    used count its events and bytes so far, and the first ``limit`` are allowed.
    A user's events run, in order, as a stream past one counter; none is held.
    Rows of a null user are one user, and null bytes are none.
    """
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) == 1
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("user_id", "event_id", at.alias("at"), F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("bytes"), first.alias("first"))
    span = seconds * 1_000_000

    def each(batches):
        start = n = used = 0
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            at, size, new = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            for i in range(batch.num_rows):
                if new[i] or at[i] >= start + span:
                    start, n, used = int(at[i]), 0, 0
                n, used = n + 1, used + int(size[i])
                out[:, i] = start, n, used
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out), pa.array(out[1] <= limit)], names=["user_id", "event_id", "start", "n", "used", "allowed"])

    kinds = dict(events.dtypes)
    got = rows.mapInArrow(each, f"user_id {kinds['user_id']}, event_id {kinds['event_id']}, start long, n long, used long, allowed boolean")
    return got.withColumn("start", F.timestamp_micros("start"))


def run_once(df: DataFrame, out: str, checkpoint: str) -> None:
    """Everything that is there, then stop; a restart goes on from the checkpoint."""
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()
