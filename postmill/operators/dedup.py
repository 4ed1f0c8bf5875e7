"""Order-aware deduplication: clusters merge in first-seen order.

``seq`` is the total order of the input. Every merge is one aggregation with map-side partial
results; nothing depends on partition order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_clusters(
    df: DataFrame, key: Column, head: Sequence[str], scalars: Sequence[str], lists: Sequence[str], seq: str = "seq"
) -> DataFrame:
    """One row per key: ``head`` columns of the first row, first non-null ``scalars``, ordered distinct union of ``lists``.

    Adds ``n_merged``. References (source, url) are gathered as a list in first-seen order.
    """
    keyed = df.withColumn("__key", key)
    first = F.min_by(F.struct(*head), F.col(seq))
    aggs = [F.min(seq).alias(seq), first.alias("__head"), F.count("*").alias("n_merged")]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in scalars]
    aggs += [F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(c).alias("v")))).alias(c) for c in lists]
    aggs.append(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), "source", "url"))).alias("refs"))
    out = keyed.groupBy("__key").agg(*aggs)
    union = lambda c: F.array_distinct(F.flatten(F.filter(F.transform(c, lambda x: x["v"]), lambda v: v.isNotNull())))
    refs = F.array_distinct(F.transform("refs", lambda x: F.struct(x["source"].alias("source"), x["url"].alias("url"))))
    return out.select(
        seq, *[F.col(f"__head.{c}").alias(c) for c in head], *scalars, *[union(c).alias(c) for c in lists], refs.alias("source_refs"), "n_merged"
    )


def keep_first(df: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The first row of each key, whole (first wins)."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(seq)).alias("__r")).select(*keys, "__r.*")


def keep_latest(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(by)).alias("__r")).select(*keys, "__r.*")


def merge_candidates(targeted: DataFrame, exploration: DataFrame, limit: int | None = None) -> DataFrame:
    """Union by ``id`` with provenance TARGETED, EXPLORATION or BOTH; last modification from exploration."""
    t = targeted.select("id", F.col("seq").alias("t_seq"))
    e = exploration.select("id", F.col("seq").alias("e_seq"), "lastmod")
    joined = t.join(e, "id", "full_outer").select(
        "id",
        F.when(F.col("t_seq").isNull(), "EXPLORATION").when(F.col("e_seq").isNull(), "TARGETED").otherwise("BOTH").alias("provenance"),
        "lastmod",
        F.coalesce("t_seq", F.lit(1 << 40) + F.col("e_seq")).alias("seq"),
    )
    return joined if limit is None else joined.orderBy("seq").limit(limit)
