"""Null-tolerant filters that name the reason of a rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESCUE_DAYS = 14


def is_expired(deadline: Column, ref: Column) -> Column:
    return F.coalesce(deadline < ref, F.lit(False))


def is_stale(posted: Column, deadline: Column, ref: Column, lookback: int, rescue: int = RESCUE_DAYS) -> Column:
    """Posted before the lookback, unless a known deadline is near; unknown dates never make it stale."""
    rescued = F.coalesce(deadline <= F.date_add(ref, rescue), F.lit(False)) if rescue else F.lit(False)
    return F.coalesce(posted < F.date_sub(ref, lookback), F.lit(False)) & ~rescued


def removal_reason(df: DataFrame, ref: Column, lookback: int = 7, rescue: int = RESCUE_DAYS) -> DataFrame:
    """Adds ``removed``: 'expired', 'stale' or null; expired is tested first."""
    return df.withColumn(
        "removed",
        F.when(is_expired(F.col("deadline"), ref), "expired").when(
            is_stale(F.col("published"), F.col("deadline"), ref, lookback, rescue), "stale"
        ),
    )


def is_new(published: Column, collected: Column, ref: Column, days: int = 3) -> Column:
    return F.coalesce(F.coalesce(published, collected) >= F.date_sub(ref, days), F.lit(False))


def is_urgent(deadline: Column, ref: Column, days: int = 7) -> Column:
    return F.coalesce(F.datediff(deadline, ref).between(0, days), F.lit(False))


def missing_required(*columns: Column) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | (F.coalesce(F.trim(c), F.lit("")) == "")
    return out


def recommendation_reason(
    missing: Column, expired: Column, role_verdict: Column, experience_verdict: Column, employment_mismatch: Column
) -> Column:
    """The first failing rule, or null."""
    return (
        F.when(missing, "MISSING_REQUIRED_FIELDS")
        .when(expired, "EXPIRED")
        .when(role_verdict == "MISMATCH", "ROLE_MISMATCH")
        .when(experience_verdict == "EXCLUDE", "EXPERIENCE_EXCLUDED")
        .when(employment_mismatch, "EMPLOYMENT_TYPE_MISMATCH")
    )


def classified_reason(keyword_reason: Column, missing: Column, expired: Column, match: Column, employment_mismatch: Column) -> Column:
    """As above with role and experience by ``match`` (deferred, eligible, non_it, role, experience)."""
    return (
        F.when(missing, "MISSING_REQUIRED_FIELDS")
        .when(expired, "EXPIRED")
        .when(match["deferred"], "ANALYSIS_DEFERRED")
        .when(match["non_it"], "ANALYSIS_NON_IT")
        .when(match["role"] == "MISMATCH", "ANALYSIS_ROLE_MISMATCH")
        .when(~match["eligible"], "EXPERIENCE_EXCLUDED")
        .when(employment_mismatch, "EMPLOYMENT_TYPE_MISMATCH")
    )
