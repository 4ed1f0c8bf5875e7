"""Mixing sources to target weights by hash-threshold histograms.

Each document has a position in hash space. Tokens are summed by source and hash bucket, running
sums over the buckets find the one in which a source's budget ends, and only that boundary bucket
is summed again by finer buckets, down to single hash values. The result is one threshold per
source: a document is in the mix if its hash lies below. Nothing is sorted but the histogram, which
has at most ``2 ** BITS`` rows per source and level; a hot source is pre-aggregated map-side.
A threshold for a larger budget includes every document of a smaller one, so mixes are nested.

Defined results: a null text has size 0; null is a source of its own, last in order; rows with
equal ids share a hash and are taken together; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import spill, split_words

#: Bits of hash space that each histogram level resolves; together 60.
LEVELS = (12, 16, 16, 16)
SPACE_BITS = sum(LEVELS)
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2


def position(id_col: Column, seed: str = "mix") -> Column:
    """A document's place in hash space: the first 60 bits of an MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, SPACE_BITS // 4), 16, 10).cast("long")


def source_targets(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """(source, source_size, target): one row per source, ranked in one task as all sources share one budget.

    Targets are the water level ``min(cap, level * weight)`` with ``cap = max_repeats * size`` whose
    sum is ``share`` of all sizes: the fixed point of handing excess on by weight. Sources in order
    of cap / weight reach their cap first, so the level is found with running sums over sources.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone, by_source = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_source) - 1) % len(weights)) + 1)
    ranked = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        F.lit(share) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ) / F.sum("weight").over(onward)
    levelled = ranked.withColumn("level", level)
    levelled = levelled.withColumn(
        "level",
        F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everyone)["level"],
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return levelled.select("source", "source_size", target.cast("double").alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): positions below ``threshold`` hold ``budget`` tokens, give or take half a document.

    ``sized`` has (source, size, position); ``budgets`` has (source, budget), with budget no
    larger than the source.
    """
    state = budgets.select("source", F.col("budget").cast("double").alias("left"), F.lit(0).cast("long").alias("prefix"))
    rows, done = sized.filter("size > 0").select("source", "size", "position"), 0
    for bits in LEVELS:
        old_shift, done = SPACE_BITS - done, done + bits
        shift = SPACE_BITS - done
        bucket = F.shiftright("position", shift)
        if old_shift == SPACE_BITS:
            inside = rows.select("source", bucket.alias("bucket"), "size")
        else:
            s = state.select(F.col("source").alias("s"), "prefix")
            inside = rows.join(
                s, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("position", old_shift) == F.col("prefix"))
            ).select("source", bucket.alias("bucket"), "size")
        hist = inside.groupBy("source", "bucket").agg(F.sum("size").alias("tokens"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("reached", F.sum("tokens").over(running)).withColumnRenamed("source", "h")
        state = (
            hist.join(state.drop("prefix"), F.col("h").eqNullSafe(F.col("source")))
            .filter((F.col("reached") >= F.col("left")) & (F.col("reached") - F.col("tokens") < F.col("left")))
            .select(
                "source",
                (F.col("left") - (F.col("reached") - F.col("tokens"))).alias("left"),
                F.col("bucket").alias("prefix"),
                "tokens",
            )
        )
        state = spill(state, "mix-level") if shift else state
        if shift:
            state = state.drop("tokens")
    take_last = (2 * F.col("left") >= F.col("tokens")).cast("long")
    return state.select("source", (F.col("prefix") + take_last).alias("threshold"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``row`` (struct of ``keep``), size, source_size, target, copies and taken, per document."""
    places = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.col(f"`{source_col}`").alias("source"),
        F.size(split_words(F.col(f"`{text_col}`"))).cast("long").alias("size"),
        position(F.col(f"`{id_col}`")).alias("position"),
    )
    if text_col in keep:
        # texts aren't written a second time; their sizes are, and are worked out again only if they are asked for
        narrow = spill(places.select("source", "size", "position"), "mix-sizes")
    else:
        places = narrow = spill(places, "mix-sizes")
    targets = spill(source_targets(narrow, weights, share, max_repeats), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = targets.select("source", whole.cast("long").alias("whole"), "target", "source_size").withColumn(
        "budget", F.col("target") - F.col("whole") * F.col("source_size")
    )
    cuts = thresholds(narrow, budgets.filter("budget > 0").select("source", "budget"))
    cuts = cuts.withColumnRenamed("source", "c")
    plan = budgets.join(cuts, F.col("source").eqNullSafe(F.col("c")), "left").select(
        F.col("source").alias("p"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold")
    )
    plan = spill(plan, "mix-plan")
    copies = F.col("whole") + (F.col("position") < F.col("threshold")).cast("long")
    return (
        places.join(plan, F.col("source").eqNullSafe(F.col("p")), "left")
        .withColumn("copies", F.least(copies, F.lit(max_repeats).cast("long")))
        .select("row", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def op9(docs: DataFrame) -> DataFrame:
    """Contract digest."""
    return mix(docs.select("doc_id", "text", "source")).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken"
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS position
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
c AS (SELECT *, 2 * source_size AS cap, 2 * source_size / weight AS ratio FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
     - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
     / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM c),
t AS (
  SELECT source, source_size,
         least(cap::DOUBLE, (SELECT lv FROM l WHERE lv <= ratio ORDER BY ratio, lv LIMIT 1) * weight) AS target
  FROM l),
w AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
p AS (
  SELECT d.doc_id, d.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.position) AS reached,
         sum(d.size) OVER (PARTITION BY d.source, d.position) AS tied
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN reached - tied < budget AND 2 * (budget - (reached - tied)) >= tied THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
