"""Incremental merge: arriving rows change only the clusters they add something to.

Members are a log of Parquet files by batch and bucket of the cluster key; merged clusters are a log by batch. A batch reads the buckets that its keys fall in, drops
rows whose (key, hash) is known, and merges the clusters that are left, from their members alone. The latest entry of a cluster is its state. A batch that is run again
overwrites its own files, so a restarted stream ends in the same state.

Defined results: a null key is a cluster of its own; a null hash is a value like any other; rows repeated within a batch count once, the first by ``seq``;
an empty batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class IncrementalMerge:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, digest: str, merge: Callable[[DataFrame], DataFrame], seq: str = "seq", buckets: int = 256):
        self.spark, self.path, self.schema, self.key, self.digest, self.merge, self.seq, self.buckets = spark, path, schema, key, digest, merge, seq, buckets
        #: Rows of merged clusters as ``merge`` gives them, with the key under ``__key``.
        self.merged_schema = merge(spark.createDataFrame([], schema)).schema
        if self.key not in self.merged_schema.fieldNames():
            raise ValueError("merge must keep the key column")

    def _members(self) -> DataFrame:
        log = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(log).option("basePath", f"{self.path}/members").parquet(f"{self.path}/members")

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Take in one batch: the function of ``foreachBatch``."""
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        others = [c for c in self.schema.fieldNames() if c not in (self.key, self.digest)]
        first = batch.groupBy(self.key, self.digest).agg(F.min_by(F.struct(*others), F.col(self.seq)).alias("r")).select(self.key, self.digest, "r.*").withColumn("bucket", bucket)
        first = first.select(*self.schema.fieldNames(), "bucket").persist()
        try:
            touched = [r[0] for r in first.select("bucket").distinct().collect()]  # the buckets, not the keys
            if not touched:
                return
            known = self._members().filter(F.col("bucket").isin(touched) & (F.col("batch") < batch_id)) if self._there("members") else None
            if known is not None:
                k = known.select(F.col(self.key).alias("k"), F.col(self.digest).alias("h"))
                first = first.join(k, F.col(self.key).eqNullSafe(F.col("k")) & F.col(self.digest).eqNullSafe(F.col("h")), "left_anti")
            first.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/members/batch={batch_id}")
            new = self._members().filter(F.col("batch") == batch_id)
            members = new if known is None else known.unionByName(new)
            changed = new.select(F.col(self.key).alias("k")).distinct()
            again = members.join(changed, F.col(self.key).eqNullSafe(F.col("k")), "left_semi").select(*self.schema.fieldNames())
            self.merge(again).write.mode("overwrite").parquet(f"{self.path}/merged/batch={batch_id}")
        finally:
            first.unpersist()

    def current(self) -> DataFrame:
        """The merged clusters: of each key the row of the last batch that changed it."""
        if not self._there("merged"):
            return self.spark.createDataFrame([], self.merged_schema)
        log = self.spark.read.schema(T.StructType([*self.merged_schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{self.path}/merged").parquet(f"{self.path}/merged")
        row = F.struct(*[c for c in self.merged_schema.fieldNames() if c != self.key])
        return log.groupBy(self.key).agg(F.max_by(row, F.col("batch")).alias("r")).select(self.key, "r.*").select(*self.merged_schema.fieldNames())

    def changed(self, batch_id: int) -> DataFrame:
        """The clusters that a batch merged again."""
        return self.spark.read.schema(self.merged_schema).parquet(f"{self.path}/merged/batch={batch_id}")
