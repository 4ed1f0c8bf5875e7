"""Quota- and diversity-constrained selection as windows; no row is visited imperatively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def default_order() -> list[Column]:
    return [
        F.col("adjusted").desc(),
        F.col("deadline").asc_nulls_last(),
        F.col("first_seen").desc_nulls_last(),
        F.col("id").asc_nulls_last(),
    ]


def prune_for_top(df: DataFrame, user: str = "user_id", company: str = "company", k: int = 7, cap: int = 2) -> DataFrame:
    """The rows that :func:`select_top` can take at all: of each user's company the first ``cap``, the first ``cap`` new ones and the first urgent one.

    Two windows over (user, company), so a user's whole pool is never in one sort.
    """
    co = F.lower(F.col(company))
    place = lambda *more: F.row_number().over(Window.partitionBy(user, co, *more).orderBy(*default_order()))
    near = df.withColumn("__n", place()).withColumn("__new", place("is_new")).withColumn("__urgent", place("is_urgent"))
    kept = (F.col("__n") <= cap + 1) | (F.col("is_new") & (F.col("__new") <= cap + 1)) | (F.col("is_urgent") & (F.col("__urgent") <= 1))
    return near.filter(kept).drop("__n", "__new", "__urgent")


def select_top(df: DataFrame, user: str = "user_id", company: str = "company", k: int = 7, min_new: int = 2, cap: int = 2) -> DataFrame:
    """Per user: one urgent row, then new rows, then the best of the rest, at most ``cap`` per company.

    Within a company rows are taken in rank order, so the number taken before a row's turn is
    what earlier phases took plus its number within the phase. Adds ``rank``, in phase order.
    """
    df = df.withColumn("__co", F.lower(F.col(company)))
    per_user = Window.partitionBy(user)
    ranked = df.withColumn("__r", F.row_number().over(per_user.orderBy(*default_order())))
    urgent = F.min(F.when(F.col("is_urgent"), F.col("__r"))).over(per_user)
    one = ranked.withColumn("__p1", F.coalesce(F.col("__r") == urgent, F.lit(False)))

    def phase(frame: DataFrame, name: str, eligible: Column, taken: Column, need: Column) -> DataFrame:
        """Marks in ``name`` the first ``need`` eligible rows that the company cap accepts."""
        before = F.sum(taken.cast("int")).over(Window.partitionBy(user, "__co"))
        nth = F.sum(eligible.cast("int")).over(Window.partitionBy(user, "__co").orderBy("__r"))
        out = frame.withColumn("__ok", eligible & (before + nth <= cap)).withColumn("__need", need)
        order = F.sum(F.col("__ok").cast("int")).over(per_user.orderBy("__r"))
        return out.withColumn(name, F.col("__ok") & (order <= F.col("__need"))).drop("__ok", "__need")

    p1 = F.col("__p1")
    need_new = F.lit(min_new) - F.max((p1 & F.col("is_new")).cast("int")).over(per_user)
    two = phase(one, "__p2", F.col("is_new") & ~p1, p1, need_new)
    p2 = F.col("__p2")
    taken = F.sum((p1 | p2).cast("int")).over(per_user)
    three = phase(two, "__p3", ~p1 & ~p2, p1 | p2, F.lit(k) - taken)
    part = F.when(p1, 1).when(p2, 2).when(F.col("__p3"), 3)
    picked = three.withColumn("__phase", part).filter("__phase IS NOT NULL")
    return picked.withColumn("rank", F.row_number().over(per_user.orderBy("__phase", "__r"))).drop(
        "__co", "__r", "__p1", "__p2", "__p3", "__phase"
    )


def interleave(df: DataFrame, group: str = "source", seq: str = "seq") -> DataFrame:
    """Round-robin position ``turn`` over groups in first-seen order."""
    within = F.row_number().over(Window.partitionBy(group).orderBy(seq))
    first = F.min(seq).over(Window.partitionBy(group))
    return df.withColumn("round", within).withColumn("group_first", first)


def first_of_pools(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows of each pool with their ``pool_order``: all that a budget of ``limit`` can take, so pools are never sorted whole."""
    kept = [df.filter(F.col("pool") == pool).orderBy(*order).limit(limit) for pool in ("TARGETED", "EXPLORATION")]
    return kept[0].unionByName(kept[1]).withColumn("pool_order", F.row_number().over(Window.partitionBy("pool").orderBy(*order)))


def fetch_budget(df: DataFrame, limit: int, ratio: float = 0.8) -> DataFrame:
    """Split a budget between the TARGETED and EXPLORATION pools; unused room goes to exploration first.

    Rows need ``pool`` and ``pool_order`` (1 is first). The pools' sizes are one aggregate row.
    """
    sizes = df.agg(F.count_if(F.col("pool") == "TARGETED").alias("t"), F.count_if(F.col("pool") == "EXPLORATION").alias("e"))
    pt = int(limit * ratio)
    t0, e0 = F.least(F.lit(pt), "t"), F.least(F.lit(limit - pt), "e")
    room = F.lit(limit) - t0 - e0
    e_n = e0 + F.least(room, F.col("e") - e0)
    t_n = t0 + F.least(F.lit(limit) - t0 - e_n, F.col("t") - t0)
    cut = sizes.select(t_n.alias("t_n"), e_n.alias("e_n"))
    joined = df.join(F.broadcast(cut))
    return joined.filter(F.col("pool_order") <= F.when(F.col("pool") == "TARGETED", F.col("t_n")).otherwise(F.col("e_n"))).drop("t_n", "e_n")


def top_by(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """A plain budget: TakeOrderedAndProject, so no full sort."""
    return df.orderBy(*order).limit(limit)


def split_batches(df: DataFrame, size: int, order: Column, within: str) -> DataFrame:
    """Number batches of ``size`` rows per ``within``."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(within).orderBy(order)) - 1) / size))


def explore_select(df: DataFrame, limit: int) -> DataFrame:
    """Relevance slots by (score, date), then exploration slots by date among the rest."""
    explore = min(max(1, int(limit * 0.2)), limit // 2)
    best = df.orderBy(F.col("score").desc(), F.col("published").desc_nulls_last(), "seq").limit(limit - explore)
    rest = df.join(best.select("id"), "id", "left_anti").orderBy(F.col("published").desc_nulls_last(), "seq").limit(explore)
    return best.withColumn("slot", F.lit("relevance")).unionByName(rest.withColumn("slot", F.lit("exploration")))
