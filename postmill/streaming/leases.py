"""The work queue as a stream: leases that expire and retries that come due, by keyed state and event-time timers.

Commands (id, at, kind, hash) are ENQUEUE, CLAIM, FAIL and SUCCEED. State per item is one value: status, attempts, lease, retry, hash; its times are
microseconds. A claim sets a timer for its
lease; when the watermark passes it, the item is PENDING again without any command. What a command does is the same as in the snapshot transforms of
:mod:`postmill.operators.state`; here each item moves as its commands arrive, and only items with commands or timers are touched.

Defined results: commands of one item within a micro-batch apply in order of ``at``, then ``seq``; a command that its state doesn't allow changes nothing and emits nothing;
null kinds are ignored. Commands must arrive in order of time across micro-batches, up to the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = T.StructType(
    [T.StructField("status", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("lease_until", T.LongType()),
     T.StructField("next_retry", T.LongType()), T.StructField("hash", T.IntegerType()), T.StructField("version", T.LongType())]
)
OUT = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.LongType()), *STATE.fields])
#: The state store that timers and state variables need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_MAX_SHIFT = 6


def _ms(at: int) -> int:
    """The first millisecond that is not before ``at``."""
    return -(-at // 1000)


class LeaseQueue(StatefulProcessor):
    def __init__(self, lease_seconds: int, retry_seconds: int, max_attempts: int):
        self.lease, self.retry, self.most = lease_seconds * 1_000_000, retry_seconds * 1_000_000, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", STATE)

    def _get(self) -> dict:
        if self.item.exists():
            return dict(zip(STATE.fieldNames(), self.item.get(), strict=True))
        return {"status": None, "attempts": 0, "lease_until": None, "next_retry": None, "hash": None, "version": 0}

    def _released(self, s: dict) -> dict:
        return s | {"status": "PENDING", "lease_until": None, "version": s["version"] + 1}

    def _step(self, s: dict, kind: str, at: int, digest: int | None) -> dict | None:
        """The state after a command, or none if it changes nothing."""
        n = s["version"] + 1
        if kind == "ENQUEUE" and (s["status"] is None or s["hash"] != digest):
            return {"status": "PENDING", "attempts": 0, "lease_until": None, "next_retry": None, "hash": digest, "version": n}
        due = s["status"] == "PENDING" or (s["status"] == "FAILED" and s["next_retry"] <= at)
        if kind == "CLAIM" and due and s["attempts"] < self.most:
            return s | {"status": "PROCESSING", "attempts": s["attempts"] + 1, "lease_until": at + self.lease, "version": n}
        if kind == "FAIL" and s["status"] == "PROCESSING":
            tries = s["attempts"] + 1
            return s | {"status": "FAILED", "attempts": tries, "lease_until": None, "next_retry": at + self.retry * 2 ** min(tries, _MAX_SHIFT), "version": n}
        if kind == "SUCCEED" and s["status"] == "PROCESSING":
            return s | {"status": "SUCCEEDED", "lease_until": None, "version": n}
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = self._get()
        before = s["lease_until"]
        for row in sorted(rows, key=lambda r: (r["us"], r["seq"])):
            if s["status"] == "PROCESSING" and s["lease_until"] < row["us"]:  # the watermark has not reached its timer yet
                expired = s["lease_until"]
                s = self._released(s)
                yield Row(id=key[0], at=expired, **s)
            after = self._step(s, row["kind"], row["us"], row["hash"])
            if after is not None:
                s = after
                yield Row(id=key[0], at=row["us"], **s)
        if s["status"] is not None:
            self.item.update(tuple(s[f] for f in STATE.fieldNames()))
        if s["lease_until"] != before:
            if before is not None:
                self.handle.deleteTimer(_ms(before))
            if s["lease_until"] is not None:
                self.handle.registerTimer(_ms(s["lease_until"]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = self._get()
        if s["status"] == "PROCESSING" and _ms(s["lease_until"]) <= expiredTimerInfo.getExpiryTimeInMs():
            expired = s["lease_until"]
            s = self._released(s)
            self.item.update(tuple(s[f] for f in STATE.fieldNames()))
            yield Row(id=key[0], at=expired, **s)


def lease_transitions(commands: DataFrame, lease_seconds: int = 700, retry_seconds: int = 60, max_attempts: int = 5, lateness: str = "0 seconds") -> DataFrame:
    """A row (id, at, status, attempts, lease_until, next_retry, hash, version) for each transition of an item."""
    timed = commands.withColumn("us", F.unix_micros("at")).withWatermark("at", lateness)
    moved = timed.groupBy("id").transformWithState(LeaseQueue(lease_seconds, retry_seconds, max_attempts), OUT, "append", "eventTime")
    return moved.withColumns({c: F.timestamp_micros(c) for c in ("at", "lease_until", "next_retry")})


def latest(transitions: DataFrame, now: Column) -> DataFrame:
    """The queue at ``now``: each item's last transition, with leases that ended before ``now`` released."""
    last = transitions.groupBy("id").agg(F.max_by(F.struct(*[c for c in transitions.columns if c != "id"]), "version").alias("s")).select("id", "s.*")
    late = (F.col("status") == "PROCESSING") & (F.col("lease_until") < now)
    return last.select("id", F.when(late, "PENDING").otherwise(F.col("status")).alias("status"), "attempts", F.when(~late, F.col("lease_until")).alias("lease_until"), "next_retry")


def drain(transitions: DataFrame, path: str) -> DataFrame:
    """Run the stream over what is there, into Parquet files under ``path``, and read them."""
    spark = transitions.sparkSession
    spark.conf.set(*STORE)
    query = transitions.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(transitions.schema).parquet(f"{path}/rows")
