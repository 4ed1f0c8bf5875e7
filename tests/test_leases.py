"""The lease queue as a stream against a loop over its commands."""

import datetime
import random

from pyspark.sql import functions as F

from postmill.operators.sinks import scratch_path
from postmill.streaming import leases

T0 = datetime.datetime(2024, 1, 1)
LEASE, RETRY, MOST = 700, 60, 5


def loop(commands, end):
    items = {}
    for seq, i, at, kind, digest in sorted(commands, key=lambda c: (c[2], c[0])):
        s = items.get(i)
        if s and s["status"] == "PROCESSING" and s["lease_until"] < at:
            s.update(status="PENDING", lease_until=None)
        if kind == "ENQUEUE" and (s is None or s["hash"] != digest):
            items[i] = {"status": "PENDING", "attempts": 0, "lease_until": None, "next_retry": None, "hash": digest}
        elif s and kind == "CLAIM" and s["attempts"] < MOST and (s["status"] == "PENDING" or (s["status"] == "FAILED" and s["next_retry"] <= at)):
            s.update(status="PROCESSING", attempts=s["attempts"] + 1, lease_until=at + datetime.timedelta(seconds=LEASE))
        elif s and kind == "FAIL" and s["status"] == "PROCESSING":
            n = s["attempts"] + 1
            s.update(status="FAILED", attempts=n, lease_until=None, next_retry=at + datetime.timedelta(seconds=RETRY * 2 ** min(n, 6)))
        elif s and kind == "SUCCEED" and s["status"] == "PROCESSING":
            s.update(status="SUCCEEDED", lease_until=None)
    for s in items.values():
        if s["status"] == "PROCESSING" and s["lease_until"] < end:
            s.update(status="PENDING", lease_until=None)
    return {i: (s["status"], s["attempts"], s["lease_until"], s["next_retry"]) for i, s in items.items()}


def test_stream_equals_loop_over_micro_batches(spark):
    d = random.Random(4)
    commands = [(k, d.randrange(12), T0 + datetime.timedelta(seconds=90 * k + d.randrange(80)), d.choice(["ENQUEUE", "CLAIM", "CLAIM", "CLAIM", "FAIL", "SUCCEED", None]), d.randrange(2)) for k in range(240)]
    path = scratch_path(spark, "commands")
    for k in range(4):  # a file per micro-batch, in order of time
        part = spark.createDataFrame(commands[60 * k : 60 * k + 60], "seq long, id long, at timestamp, kind string, hash int")
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("seq long, id long, at timestamp, kind string, hash int").option("maxFilesPerTrigger", 1).parquet(path)
    out = scratch_path(spark, "leases")
    moved = leases.drain(leases.lease_transitions(stream, LEASE, RETRY, MOST), out)
    end = max(c[2] for c in commands)
    rows = leases.latest(moved, F.lit(end)).collect()
    assert {r["id"]: (r["status"], r["attempts"], r["lease_until"], r["next_retry"]) for r in rows} == loop(commands, end)
    # a lease that ended without a further command was released by its timer
    released = moved.filter("status = 'PENDING' AND version > 1").count()
    assert released > 0
    assert moved.groupBy("id", "version").count().filter("count > 1").count() == 0
