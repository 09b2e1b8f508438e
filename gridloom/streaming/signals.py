"""Signal operators as Structured Streaming (an extension; batch results are the check)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.store import folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, late: str = "1 hour") -> DataFrame:
    """The events table as a stream, with a watermark on ts."""
    s = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sliding(stream: DataFrame, size: str = "1 day", slide: str = "12 hours") -> DataFrame:
    """Framing by time: overlapping windows of each user's values."""
    w = stream.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value")).cast("long").alias("total"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "6 hours") -> DataFrame:
    """op A15 by time: runs of a user's events that a silence of `gap` parts."""
    s = stream.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("start"), "user_id", "n")


def distinct_events(stream: DataFrame) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark(["event_id"])


def pre_emphasis(stream: DataFrame, a: float = 0.95) -> DataFrame:
    """op A1: each user's last value is carried from batch to batch. Within a batch rows go by time and id."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        before = rows.value.shift(1, fill_value=last)
        state.update((float(rows.value.iloc[-1]),))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows.event_id, "y": rows.value - a * before})

    return stream.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, y double", "last double", "append", "NoTimeout")


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives for all that there is now, as a table in the folder that the cluster shares: each micro-batch is
    written there, in place of the one before in mode complete, beside it in mode append. A batch that is tried again
    takes its own place, so none counts twice."""
    spark = stream.sparkSession
    path = folder(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", folder(spark, "stream-state")).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(path).select(stream.columns)
