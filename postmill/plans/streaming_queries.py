"""The batch forms of the streaming operators: the same functions over a static table."""

from __future__ import annotations

from pyspark.sql import functions as F


def register(add) -> None:
    def windows(s, d):
        e = s.read.parquet(f"{d}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
        return e.dropDuplicates(["event_id"]).groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n", "total")

    add("I12_stream_windows", windows, "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
