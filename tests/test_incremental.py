"""Incremental merge against a full one, after each batch and through a stream."""

import random

from pyspark.sql import functions as F

from postmill.operators import dedup
from postmill.operators.sinks import scratch_path
from postmill.streaming.incremental import IncrementalMerge

SCHEMA = "key string, seq long, hash string, source string, url string, title string, skills array<string>"


def merge(df):
    return dedup.merge_clusters(df, F.col("key"), ["key", "source", "url"], ["title"], ["skills"])


def rows(seed, n, first):
    d = random.Random(seed)
    return [(d.choice([None, *(f"k{j}" for j in range(25))]), first + k, d.choice([None, "a", "b", "c"]), "s", f"u{k}", d.choice([None, f"t{k}"]), [d.choice("xyz")]) for k in range(n)]


def full(spark, batches):
    every = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    return sorted(map(str, merge(every.groupBy("key", "hash").agg(F.min_by(F.struct("seq", "source", "url", "title", "skills"), "seq").alias("r")).select("key", "hash", "r.*").select(*every.columns)).collect()))


def test_equals_full_recompute_after_each_batch(spark):
    schema = spark.createDataFrame([], SCHEMA).schema
    state = IncrementalMerge(spark, scratch_path(spark, "incremental"), schema, "key", "hash", merge, buckets=8)
    batches = [rows(1, 30, 0), rows(2, 12, 100), rows(1, 30, 200), [], rows(3, 9, 300)]
    for k, batch in enumerate(batches):
        state.apply(spark.createDataFrame(batch, SCHEMA), k)
        assert sorted(map(str, state.current().collect())) == full(spark, batches[: k + 1])
    # the third batch repeats the first under other numbers: nothing is merged again
    assert state.changed(2).count() == 0
    before = {r["key"]: r for r in state.current().collect()}
    some = [("k1", 900, "new", "s", "u", "t", ["q"])]
    state.apply(spark.createDataFrame(some, SCHEMA), 5)
    assert [r["key"] for r in state.changed(5).collect()] == ["k1"]
    assert {k: r for k, r in before.items() if k != "k1"} == {r["key"]: r for r in state.current().collect() if r["key"] != "k1"}
    state.apply(spark.createDataFrame(some, SCHEMA), 5)  # a batch that is run again
    assert sorted(map(str, state.current().collect())) == full(spark, [*batches, some])


def test_as_a_stream(spark):
    path, batches = scratch_path(spark, "arriving"), [rows(4, 20, 0), rows(5, 20, 50), rows(6, 20, 90)]
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    state = IncrementalMerge(spark, scratch_path(spark, "incremental"), spark.createDataFrame([], SCHEMA).schema, "key", "hash", merge, buckets=4)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    query = stream.writeStream.foreachBatch(state.apply).option("checkpointLocation", scratch_path(spark, "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(str, state.current().collect())) == full(spark, batches)
