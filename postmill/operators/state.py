"""Upserts and queues as snapshot transforms: a new state is a query over the old one.

A transform gives the rows a sequence of updates would leave, not mutual exclusion; writers swap
snapshots atomically.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")).isin("", "[]")


def fold_batch(incoming: DataFrame, key: str, seq: str, last: Sequence[str], first: Sequence[str]) -> DataFrame:
    """One row per key: last non-null of ``last``, first non-blank of ``first``: what row-by-row upserts leave."""
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in last]
    aggs += [F.min_by(c, F.when(~is_blank(F.col(c)), F.col(seq))).alias(c) for c in first]
    return incoming.groupBy(key).agg(*aggs, F.count("*").alias("n_in"))


def upsert(old: DataFrame, new: DataFrame, key: str, overwrite: Sequence[str], preserve: Sequence[str], changed_by: str) -> DataFrame:
    """Merge by full outer join with an ``action``: INSERT, UPDATE (``changed_by`` differs), TOUCH or KEEP.

    ``overwrite`` takes the new value unless it is blank. ``preserve`` does so only for an UPDATE from the
    same record; otherwise the old value stays unless it is blank.
    """
    o = old.select(key, *[F.col(c).alias(f"o_{c}") for c in dict.fromkeys([*overwrite, *preserve])], F.lit(True).alias("o_row"))
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in dict.fromkeys([*overwrite, *preserve])], F.lit(True).alias("n_row"))
    j = o.join(n, key, "full_outer")
    changed = ~F.col(f"o_{changed_by}").eqNullSafe(F.col(f"n_{changed_by}"))
    action = F.when(F.col("o_row").isNull(), "INSERT").when(F.col("n_row").isNull(), "KEEP").when(changed, "UPDATE").otherwise("TOUCH")
    newer = lambda c: F.when(~is_blank(F.col(f"n_{c}")), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
    older = lambda c: F.when(is_blank(F.col(f"o_{c}")), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
    j = j.withColumn("action", action)
    values = [newer(c).alias(c) for c in overwrite]
    values += [F.when(F.col("action") == "UPDATE", newer(c)).otherwise(older(c)).alias(c) for c in preserve if c not in overwrite]
    return j.select(key, "action", *values)


def claim(queue: DataFrame, now: Column, lease_seconds: int, max_attempts: int, limit: int) -> DataFrame:
    """Lease the oldest due rows (PENDING, or FAILED whose retry is due)."""
    due = (F.col("status") == "PENDING") | ((F.col("status") == "FAILED") & (F.col("next_retry") <= now))
    picked = queue.filter(due & (F.col("attempts") < max_attempts)).orderBy("created", "id").limit(limit).select("id", F.lit(True).alias("picked"))
    j = queue.join(picked, "id", "left")
    got = F.coalesce("picked", F.lit(False))
    return j.select(
        "id",
        F.when(got, "PROCESSING").otherwise(F.col("status")).alias("status"),
        (F.col("attempts") + got.cast("int")).alias("attempts"),
        F.when(got, now + F.make_dt_interval(secs=F.lit(lease_seconds))).otherwise(F.col("lease_until")).alias("lease_until"),
    )


def release_expired(queue: DataFrame, now: Column) -> DataFrame:
    late = (F.col("status") == "PROCESSING") & (F.col("lease_until") < now)
    return queue.withColumns(
        {"status": F.when(late, "PENDING").otherwise(F.col("status")), "lease_until": F.when(~late, F.col("lease_until"))}
    )


def mark_failed(queue: DataFrame, now: Column, base_seconds: int = 60, max_shift: int = 6) -> DataFrame:
    """Another attempt and an exponential retry time, ``base * 2 ** min(attempt, 6)`` seconds on."""
    n = F.col("attempts") + 1
    wait = F.lit(base_seconds) * F.pow(F.lit(2), F.least(n, F.lit(max_shift))).cast("int")
    return queue.withColumn("next_retry", now + F.make_dt_interval(secs=wait)).withColumn("attempts", n).withColumn("status", F.lit("FAILED"))


def apply_results(queue: DataFrame, results: DataFrame) -> DataFrame:
    """Store results by (id, token): a stale token is ignored, another input hash is a CONFLICT without values."""
    r = results.select("id", F.col("token").alias("r_token"), F.col("hash").alias("r_hash"), "value")
    j = queue.join(r, "id", "left")
    mine = F.coalesce(F.col("r_token") == F.col("token"), F.lit(False))
    same = F.col("r_hash").eqNullSafe(F.col("hash"))
    return j.select(
        "id",
        F.when(mine & same, "SUCCEEDED").when(mine, "CONFLICT").otherwise(F.col("status")).alias("status"),
        F.when(mine & same, F.col("value")).alias("value"),
    )


def compare_and_set(df: DataFrame, column: str, expected: Sequence[str], to: str, guard: Column | None = None) -> DataFrame:
    ok = F.col(column).isin(*expected) & (F.lit(True) if guard is None else guard)
    return df.withColumn("claimed", F.coalesce(ok, F.lit(False))).withColumn(column, F.when(F.col("claimed"), to).otherwise(F.col(column)))


def insert_missing(old: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Idempotent insert: candidates whose key is new, appended."""
    return old.unionByName(candidates.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def patch_map(old: Column, patch: Column) -> Column:
    """Shallow map merge; the patch wins."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(patch), k)), patch)


def touch_sources(old: DataFrame, seen: DataFrame, keys: Sequence[str], now: Column, day: Column) -> DataFrame:
    """Provenance rows after a run: new ones are inserted, known ones touched; a hash is replaced by a known one only.

    ``old`` has the keys, content_hash, first_seen, last_seen, last_collected, active; ``seen`` the keys and content_hash.
    """
    new = seen.groupBy(*keys).agg(F.max("content_hash").alias("new_hash"), F.lit(True).alias("seen"))
    joined = old.withColumn("known", F.lit(True)).join(new, list(keys), "full_outer")
    seen_now = F.coalesce("seen", F.lit(False))
    return joined.select(
        *keys,
        F.coalesce("new_hash", "content_hash").alias("content_hash"),
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(seen_now, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(seen_now, day).otherwise(F.col("last_collected")).alias("last_collected"),
        F.coalesce("active", F.lit(True)).alias("active"),
    )


#: Rows a backfill may take at once, and the states that count as done.
BACKFILL_LIMIT, DONE = 1000, ("SUCCEEDED", "FALLBACK")


def backfill(postings: DataFrame, analyses: DataFrame, version: str, limit: int = 0, after_id: int | None = None, force: bool = False) -> DataFrame:
    """The next candidates by id after the cursor, each with ``reason`` and ``enqueued``: what a dry run reports and a real one applies.

    ``postings`` has id and input_hash; ``analyses`` posting_id, status, input_hash, version. The largest id of the result is the next cursor. A limit below one means the
    most allowed; one above is an error.
    """
    if limit > BACKFILL_LIMIT:
        raise ValueError(f"a backfill takes at most {BACKFILL_LIMIT} rows, not {limit}")
    rest = postings if after_id is None else postings.filter(F.col("id") > after_id)
    picked = rest.select("id", "input_hash").orderBy("id").limit(limit if limit > 0 else BACKFILL_LIMIT)
    known = analyses.select(F.col("posting_id").alias("id"), "status", F.col("input_hash").alias("old_hash"), F.col("version").alias("old_version"))
    done = F.col("status").isin(*DONE)
    same = F.col("old_hash").eqNullSafe(F.col("input_hash")) & F.col("old_version").eqNullSafe(F.lit(version))
    reason = (
        F.when(F.col("status").isNull(), "NO_ANALYSIS_ROW")
        .when(done & F.lit(force), "FORCE_RECLASSIFY")
        .when(done & same, "ALREADY_COMPLETED_SAME_VERSION")
        .when(done, "VERSION_OR_INPUT_CHANGED")
        .otherwise("ALREADY_PENDING_OR_PROCESSING")
    )
    enqueued = F.col("reason").isin("NO_ANALYSIS_ROW", "FORCE_RECLASSIFY", "VERSION_OR_INPUT_CHANGED")
    return picked.join(known, "id", "left").withColumn("reason", reason).withColumn("enqueued", enqueued).select("id", "input_hash", "reason", "enqueued")


def apply_backfill(analyses: DataFrame, chosen: DataFrame, version: str) -> DataFrame:
    """The analyses after a backfill that is no dry run: enqueued rows are PENDING with the new hash and version and no attempts."""
    new = chosen.filter("enqueued").select(F.col("id").alias("posting_id"), F.col("input_hash").alias("new_hash"), F.lit(True).alias("chosen"))
    joined = analyses.join(new, "posting_id", "full_outer")
    take = F.coalesce("chosen", F.lit(False))
    return joined.select(
        "posting_id",
        F.when(take, "PENDING").otherwise(F.col("status")).alias("status"),
        F.when(take, F.col("new_hash")).otherwise(F.col("input_hash")).alias("input_hash"),
        F.when(take, version).otherwise(F.col("version")).alias("version"),
    )


#: Columns of a company source that a request may set, and those whose change voids a verification.
SOURCE_FIELDS, CORE_FIELDS = ("source_type", "url", "adapter", "status", "config"), ("source_type", "url", "adapter", "config")


def _same_config(a: Column, b: Column) -> Column:
    """Equal as JSON objects: the order of keys doesn't count."""
    entries = lambda c: F.array_sort(F.map_entries(F.from_json(F.coalesce(c, F.lit("{}")), "map<string,string>")))
    return entries(a).eqNullSafe(entries(b))


def update_sources(old: DataFrame, requests: DataFrame) -> DataFrame:
    """Company sources after update requests, with ``outcome``: KEPT, UPDATED, RESET (a core field changed, so it must be verified again) or DUPLICATE (rejected).

    ``old`` has id, company_id, the fields, verification and verified_at; ``requests`` id and the fields, null where they stay. Types, adapters and states are upper-cased.
    A request that would make a source equal to another of its company in type and address is rejected.
    """
    norm = lambda name, c: F.upper(F.trim(c)) if name in ("source_type", "adapter", "status") else c
    r = requests.select("id", *[norm(c, F.col(c)).alias(f"r_{c}") for c in SOURCE_FIELDS], F.lit(True).alias("asked"))
    new = old.join(r, "id", "left").withColumns({f"n_{c}": F.coalesce(f"r_{c}", c) for c in SOURCE_FIELDS})
    others = old.select(F.col("id").alias("o_id"), F.col("company_id").alias("o_company"), F.col("source_type").alias("o_type"), F.col("url").alias("o_url"))
    clash = (F.col("company_id") == F.col("o_company")) & (F.col("n_source_type") == F.col("o_type")) & (F.col("n_url") == F.col("o_url")) & (F.col("id") != F.col("o_id"))
    taken = new.filter("asked").join(others, clash, "left_semi").select("id", F.lit(True).alias("taken"))
    changed = ~F.col("n_source_type").eqNullSafe(F.col("source_type")) | ~F.col("n_url").eqNullSafe(F.col("url")) | ~F.col("n_adapter").eqNullSafe(F.col("adapter")) | ~_same_config(F.col("n_config"), F.col("config"))
    told = new.join(taken, "id", "left").withColumn("outcome", F.when(F.col("asked").isNull(), "KEPT").when(F.col("taken"), "DUPLICATE").when(changed, "RESET").otherwise("UPDATED"))
    applies, reset = F.col("outcome").isin("UPDATED", "RESET"), F.col("outcome") == "RESET"
    values = {c: F.when(applies, F.col(f"n_{c}")).otherwise(F.col(c)) for c in SOURCE_FIELDS}
    values["status"] = F.when(reset, "PENDING").otherwise(values["status"])
    return told.select(
        "id", "company_id", "outcome", *[v.alias(k) for k, v in values.items()],
        F.when(reset, "UNVERIFIED").otherwise(F.col("verification")).alias("verification"), F.when(~reset, F.col("verified_at")).alias("verified_at"),
    )
