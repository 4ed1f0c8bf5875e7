"""Structured Streaming forms of the incremental operators over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    return stream.parquet(f"{sf_dir}/event*.parquet").withColumn("at", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Counts and sums per window and type; rows later than ``lateness`` are dropped by the watermark."""
    once = events.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drain the available input into an in-memory table: for tests and small demonstrations."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
