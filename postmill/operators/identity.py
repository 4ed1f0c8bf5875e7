"""Entity resolution of an ordered batch by several keys, and the merge that follows.

A row belongs to the posting that holds its record key, else to the first posting of its fingerprint, else to the first of
its address, else it creates one. Rows that come earlier in the batch count: what they create or attach is there for later rows.

Row by row that is a loop. Here it is rounds over sets: only the first row of each record key can create; such a row creates when
no undecided row before it could create a posting that it would find, and is settled when one has. Each round takes minima of the order by key, so
a key that most rows share costs one row per task. Rows that agree in all keys are one candidate from the start. Batches in random order settle in a
logarithmic number of rounds; the longest chain of rows that wait for one another is the worst case.

Defined results: null keys match nothing, so a row without any key creates; an empty batch changes nothing; ``seq`` must be unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.operators.sinks import spill
from postmill.operators.state import is_blank

#: Rows of one record key that a window holds at once.
SCAN = 65_536


def _first_by(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{name}_key")).agg(F.min(value).alias(name))


def _look(df: DataFrame, table: DataFrame, key: str, name: str) -> DataFrame:
    return df.join(table, F.col(key) == F.col(f"{name}_key"), "left").drop(f"{name}_key")


def creators(heads: DataFrame) -> tuple[DataFrame, int]:
    """Rows (seq, fingerprint, stored, url) that create a posting, and the number of rounds it took to tell."""
    # of rows alike in all they look for and all they would leave, the first decides
    alike = F.col("url").isNotNull() | F.col("fingerprint").eqNullSafe(F.col("stored"))
    some = heads.filter(alike & (F.col("url").isNotNull() | F.col("fingerprint").isNotNull()))
    firsts = some.groupBy("fingerprint", "stored", "url").agg(F.min("seq").alias("seq"))
    rest = heads.filter(~(alike & (F.col("url").isNotNull() | F.col("fingerprint").isNotNull())))
    undecided = spill(firsts.unionByName(rest.select(*firsts.columns)), "undecided")
    found, rounds = undecided.limit(0), 0
    while not undecided.isEmpty():
        rounds += 1
        earlier = lambda df, name: (_first_by(df, "stored", "seq", f"{name}_fp"), _first_by(df, "url", "seq", f"{name}_url"))
        before = lambda name: F.coalesce(F.least(f"{name}_fp", f"{name}_url") < F.col("seq"), F.lit(False))
        fp, url = earlier(undecided, "any")
        told = spill(_look(_look(undecided, fp, "fingerprint", "any_fp"), url, "url", "any_url").withColumn("waits", before("any")).drop("any_fp", "any_url"), "round")
        won = told.filter("NOT waits").drop("waits")
        fp, url = earlier(won, "won")
        waiting = _look(_look(told.filter("waits").drop("waits"), fp, "fingerprint", "won_fp"), url, "url", "won_url")
        undecided = spill(waiting.filter(~before("won")).drop("won_fp", "won_url"), "undecided")
        found = found.unionByName(won)
    return found, rounds


def resolve(incoming: DataFrame, postings: DataFrame, sources: DataFrame) -> DataFrame:
    """``incoming`` with ``posting_id`` (of a known posting), ``creator`` (seq of the row that creates the posting) and ``via``.

    ``incoming`` has seq, record_key, fingerprint, url and ``stored``, the fingerprint a posting made from the row is found by.
    ``postings`` has id, fingerprint, url; ``sources`` record_key, posting_id. ``via`` is KEY, FINGERPRINT, URL or NEW.
    """
    rows = spill(_look(incoming, _first_by(sources, "record_key", "posting_id", "by_key"), "record_key", "by_key"), "keyed")
    first = _first_by(rows.filter("by_key IS NULL"), "record_key", "seq", "head")
    open_rows = _look(rows.filter("by_key IS NULL"), first, "record_key", "head").withColumn("head", F.coalesce("head", "seq"))
    heads = open_rows.filter("head = seq").select("seq", "fingerprint", "stored", "url")
    heads = _look(_look(heads, _first_by(postings, "fingerprint", "id", "old_fp"), "fingerprint", "old_fp"), _first_by(postings, "url", "id", "old_url"), "url", "old_url")
    heads = spill(heads, "heads")
    new, _ = creators(heads.filter("old_fp IS NULL AND old_url IS NULL").drop("old_fp", "old_url"))
    new = spill(new, "creators")
    heads = _look(_look(heads, _first_by(new, "stored", "seq", "new_fp"), "fingerprint", "new_fp"), _first_by(new, "url", "seq", "new_url"), "url", "new_url")
    # what is created later is not there yet
    heads = heads.withColumns({c: F.when(F.col(c) < F.col("seq"), F.col(c)) for c in ("new_fp", "new_url")})
    by_fp = F.col("old_fp").isNotNull() | F.col("new_fp").isNotNull()
    by_url = F.col("old_url").isNotNull() | F.col("new_url").isNotNull()
    placed = heads.select(
        F.col("seq").alias("head"),
        F.when(by_fp, F.col("old_fp")).otherwise(F.col("old_url")).alias("posting_id"),
        F.when(by_fp, F.when(F.col("old_fp").isNull(), F.col("new_fp"))).when(by_url, F.when(F.col("old_url").isNull(), F.col("new_url"))).otherwise(F.col("seq")).alias("creator"),
        F.when(by_fp, "FINGERPRINT").when(by_url, "URL").otherwise("NEW").alias("via"),
    )
    later = open_rows.join(placed, "head").withColumn("via", F.when(F.col("head") == F.col("seq"), F.col("via")).otherwise("KEY")).drop("head", "by_key")
    known = rows.filter("by_key IS NOT NULL").withColumnRenamed("by_key", "posting_id").withColumns({"creator": F.lit(None).cast(rows.schema["seq"].dataType), "via": F.lit("KEY")})
    return later.unionByName(known.select(*later.columns))


def changed_hashes(resolved: DataFrame, sources: DataFrame) -> DataFrame:
    """``resolved`` with ``overwrites``: the row's key is known and its content hash differs from the last one known for that key.

    A running last value per key in two steps, so that one key's rows are spread over windows of ``SCAN`` rows.
    """
    known = sources.filter("content_hash IS NOT NULL").groupBy("record_key").agg(F.max("content_hash").alias("known_hash"))
    block = F.floor(F.col("seq") / SCAN)
    keyed = resolved.filter("record_key IS NOT NULL").withColumn("block", block)
    last = keyed.groupBy("record_key", "block").agg(F.max_by("content_hash", F.when(F.col("content_hash").isNotNull(), F.col("seq"))).alias("block_hash"))
    before = Window.partitionBy("record_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("block_hash", True).over(before)).drop("block_hash")
    inside = Window.partitionBy("record_key", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    told = keyed.withColumn("own", F.last("content_hash", True).over(inside)).join(carried, ["record_key", "block"]).join(known, "record_key", "left")
    prior = F.coalesce("own", "carried", "known_hash")
    differs = (F.col("via") == "KEY") & prior.isNotNull() & ~prior.eqNullSafe(F.col("content_hash"))
    out = told.withColumn("overwrites", differs).select(*resolved.columns, "overwrites")
    return out.unionByName(resolved.filter("record_key IS NULL").withColumn("overwrites", F.lit(False)))


def merge_postings(resolved: DataFrame, postings: DataFrame, replace: Sequence[str], enrich: Sequence[str]) -> DataFrame:
    """Postings after the batch: (posting_id, creator, n_rows, ``replace`` and ``enrich`` columns), as row-by-row updates leave them.

    ``resolved`` has ``overwrites``. Columns of ``replace`` take every value that is not blank. Those of ``enrich`` do so from an overwriting row;
    other rows fill them only while they are blank or an empty list.
    """
    columns = [*replace, *enrich]
    base = postings.select(F.col("id").alias("posting_id"), F.lit(None).cast("long").alias("creator"), F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("overwrites"), F.lit(True).alias("start"), F.lit(0).alias("row"), *columns)
    first = F.coalesce(F.col("creator") == F.col("seq"), F.lit(False))
    steps = resolved.select("posting_id", F.col("creator").cast("long").alias("creator"), F.col("seq").cast("long").alias("seq"), (F.col("overwrites") | first).alias("overwrites"), first.alias("start"), F.lit(1).alias("row"), *columns)
    steps = spill(base.unionByName(steps).withColumn("key", F.coalesce(-F.col("posting_id") - 1, F.col("creator"))), "steps")
    given = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    set_at = {c: F.when(F.col("start") | (F.col("overwrites") & given(c)), F.col("seq")) for c in enrich}
    whole = steps.groupBy("key").agg(
        F.max("posting_id").alias("posting_id"), F.max("creator").alias("creator"), F.sum("row").alias("n_rows"),
        *[F.max_by(c, F.when(given(c), F.col("seq"))).alias(c) for c in replace],
        *[F.max_by(c, set_at[c]).alias(f"set_{c}") for c in enrich], *[F.max(set_at[c]).alias(f"at_{c}") for c in enrich],
    )
    # what comes after the last overwrite and is no overwrite itself
    later = steps.filter("NOT overwrites").select("key", "seq", *enrich).join(whole.select("key", *[f"at_{c}" for c in enrich]), "key")
    after = {c: given(c) & (F.col("seq") > F.coalesce(f"at_{c}", F.lit(-2))) for c in enrich}
    fills = later.groupBy("key").agg(
        *[F.min_by(c, F.when(after[c] & ~is_blank(F.col(c)), F.col("seq"))).alias(f"fill_{c}") for c in enrich],
        *[F.min_by(c, F.when(after[c], F.col("seq"))).alias(f"empty_{c}") for c in enrich],
    )
    value = lambda c: F.when(~is_blank(F.col(f"set_{c}")), F.col(f"set_{c}")).otherwise(F.coalesce(f"fill_{c}", f"empty_{c}", f"set_{c}"))
    return whole.join(fills, "key", "left").select("posting_id", "creator", "n_rows", *replace, *[value(c).alias(c) for c in enrich])


def analysis_actions(postings: DataFrame, analyses: DataFrame, version: str) -> DataFrame:
    """(id, action): INSERT_PENDING without an analysis, RESET_PENDING where input hash or classifier version differ, else TOUCH.

    ``postings`` has id and input_hash; ``analyses`` posting_id, input_hash, version. A batch counts as one step.
    """
    known = analyses.select(F.col("posting_id").alias("id"), F.col("input_hash").alias("old_hash"), F.col("version").alias("old_version"), F.lit(True).alias("known"))
    differs = ~F.col("input_hash").eqNullSafe(F.col("old_hash")) | ~F.col("old_version").eqNullSafe(F.lit(version))
    return postings.join(known, "id", "left").select("id", F.when(F.col("known").isNull(), "INSERT_PENDING").when(differs, "RESET_PENDING").otherwise("TOUCH").alias("action"))

