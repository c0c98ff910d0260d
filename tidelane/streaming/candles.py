"""Candles from an event stream, closed by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def candles(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Hourly candles by event type; with a stream, an hour is final once events are ``lateness`` past its end. State is one row an open hour and type."""
    e = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "user_id")
    hour = e.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("symbol"))
    first = F.min_by("value", "ts")
    out = hour.agg(first.alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.sum("value").alias("volume"), F.count("*").alias("trades"))
    return out.select("symbol", (F.unix_timestamp("window.start") / 3600).cast("long").alias("h"), "open", "high", "low", "close", "volume", "trades")


def replay(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    """Run the stream over the files of a folder to their end and return its candles."""
    schema = spark.read.parquet(f"{folder}/{files}").schema
    name = f"candles_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    query = candles(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
