"""Streaming forms of idempotent ingest, windows and the document lifecycle. The functions take any streaming DataFrame with an event
time; extensions of the queue-driven reference, with the same semantics of replay, heartbeat and timeout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE_OUT = "document_id long, status string, steps long, stuck boolean"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream; its zone-less times become timestamps, which watermarks need."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """Replayed rows pass once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def lifecycle(events: DataFrame, timeout_ms: int = 30 * 60 * 1000, late: str = "10 minutes") -> DataFrame:
    """Last status and number of steps of each document; a document that is silent for too long (in event time) is told as
    stuck once."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, steps = state.get
            state.remove()
            yield pd.DataFrame({"document_id": [key[0]], "status": [status], "steps": [steps], "stuck": [True]})
            return
        status, steps = state.get if state.exists else ("", 0)
        last = state.getCurrentWatermarkMs()
        for pdf in frames:
            if len(pdf):
                pdf = pdf.sort_values("ts")
                status, steps = str(pdf["event_type"].iloc[-1]), steps + len(pdf)
                last = max(last, int(pdf["ts"].iloc[-1].timestamp() * 1000))
        state.update((status, steps))
        state.setTimeoutTimestamp(last + timeout_ms)
        yield pd.DataFrame({"document_id": [key[0]], "status": [status], "steps": [steps], "stuck": [False]})

    rows = events.withWatermark("ts", late).select(F.col("user_id").alias("document_id"), "event_type", "ts")
    return rows.groupBy("document_id").applyInPandasWithState(step, STATE_OUT, "status string, steps long", "update", GroupStateTimeout.EventTimeTimeout)


def run_to_memory(rows: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there and returns the sink's table (tests and small reports)."""
    query = rows.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.table(name)
