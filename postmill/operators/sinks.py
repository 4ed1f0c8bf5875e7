"""Sinks by Spark's committed writer: messages as files, and tables written once and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share; without one, a local master's own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="postmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spill(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors, gives exact sizes."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all shuffle partitions: for few rows that a join is about to make many, which adaptive execution would leave to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def write_messages(messages: DataFrame, path: str) -> None:
    """One file for each message (to, subject, message_id, content): headers, a rule, the content."""
    text = F.concat(F.lit("To: "), "to", F.lit("\nSubject: "), "subject", F.lit("\nMessage-Id: "), "message_id", F.lit("\n---\n"), "content")
    messages.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    part = lambda k: F.regexp_extract("value", r"(?s)^To: (.*?)\nSubject: (.*?)\nMessage-Id: (.*?)\n---\n(.*?)\n?$", k)
    return whole.select(part(1).alias("to"), part(2).alias("subject"), part(3).alias("message_id"), part(4).alias("content"))
