"""Streams over the task log: hourly counts with late data, an activity feed without repeats, and a stateful pacer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumora.operators import tables

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of events as a stream; time without a zone is UTC."""
    raw = spark.readStream.schema(EVENTS.replace("ts timestamp", "ts timestamp_ntz")).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by hour and kind; rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def feed(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, whatever its redeliveries within `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _pace(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pace = state.get[0] if state.exists else 1.0
    for rows in batches:
        for bad in (rows.sort_values(["ts", "event_id"]).event_type == "error").tolist():
            pace = min(30.0, pace * 2) if bad else max(1.0, pace * 0.85)
    state.update((pace,))
    yield pd.DataFrame({"user_id": [key[0]], "pace": [pace]})


def pacer(events: DataFrame) -> DataFrame:
    """Pace of each worker after each micro-batch: doubled by errors, eased by success; kept in state."""
    return events.groupBy("user_id").applyInPandasWithState(_pace, "user_id long, pace double", "pace double", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, **options: Any) -> DataFrame:
    """Process what is there into a table in memory, for tests and small results."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.options(**options).start().awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", **options: Any) -> DataFrame:
    """Process what is there into a new table of the folder that spark.checkpoint.dir names, and read it.

    The stream's own checkpoint is beside it. In complete and update mode each batch replaces the table.
    """
    spark = stream.sparkSession
    folder = tables.shared_folder(spark, f"stream-{name}")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).options(**options)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/table")
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/table"))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")
