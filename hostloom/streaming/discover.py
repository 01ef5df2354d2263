"""Streams: incremental discovery, windowed counts of events and handling of messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import discovery as D


def events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The events table in a folder as a stream of files, with its time as a time stamp."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of values by window and type; rows later than the watermark are dropped."""
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def new_hosts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows of hosts that weren't seen within the watermark."""
    return D.picked(stream).withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["hostname"])


def handle(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each batch of messages goes to handler, which is called again with the same number after a failure."""
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
