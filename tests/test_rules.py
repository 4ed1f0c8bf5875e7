"""Recommendation rules on hand-made cases, and the ways the plan takes a short cut."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postmill.functions import policy
from postmill.operators import filters, ranking, scoring
from postmill.plans import recommend
from postmill.sources.fixtures import analyses, postings, users
from tests.oracle import SF, rows_of

TRACK = "struct<no:int,groups:array<string>,accepts:boolean,min_years:int,requirement:string,recruitment:string,unknown:boolean>"
BACKEND, DATA, GENERAL = ["BACKEND"], ["DATA"], ["GENERAL_IT"]
OPEN = (None, None, "NONE")
SENIOR = (False, 3, "REQUIRED")


def track(no, groups, facts, unknown=False):
    accepts, years, requirement = facts
    return (no, groups, accepts, years, requirement, None, unknown)


# name: (status, domain, scope, groups, (accepts, years, requirement), tracks, acceptable, new grad) -> (reason, role, experience)
CASES = {
    "no analysis": ((None, None, None, None, OPEN, None, BACKEND, True), ("ANALYSIS_DEFERRED", None, None)),
    "pending": (("PENDING", "IT", None, BACKEND, OPEN, None, BACKEND, True), ("ANALYSIS_DEFERRED", None, None)),
    "no groups known": (("SUCCEEDED", "IT", None, [], OPEN, None, BACKEND, True), ("ANALYSIS_DEFERRED", None, None)),
    "other domain": (("SUCCEEDED", "NON_IT", None, BACKEND, OPEN, None, BACKEND, True), ("ANALYSIS_NON_IT", "MISMATCH", "UNKNOWN")),
    "direct": (("FALLBACK", "IT", None, BACKEND, OPEN, None, BACKEND, True), (None, "DIRECT_MATCH", "FULL")),
    "other role": (("SUCCEEDED", "IT", None, DATA, OPEN, None, BACKEND, True), ("ANALYSIS_ROLE_MISMATCH", "MISMATCH", "UNKNOWN")),
    "broad": (("SUCCEEDED", "IT", None, GENERAL, OPEN, None, BACKEND, True), (None, "BROAD_IT_MATCH", "FULL")),
    "senior for a new graduate": (("SUCCEEDED", "IT", None, BACKEND, SENIOR, None, BACKEND, True), ("EXPERIENCE_EXCLUDED", "DIRECT_MATCH", "EXCLUDED")),
    "senior for others": (("SUCCEEDED", "IT", None, BACKEND, SENIOR, None, BACKEND, False), (None, "DIRECT_MATCH", "FULL")),
    "no preference": (("SUCCEEDED", "IT", None, DATA, OPEN, None, [], True), (None, "DIRECT_MATCH", "FULL")),
    "role and experience of different tracks": (
        ("SUCCEEDED", "IT", "MULTI_ROLE", BACKEND, OPEN, [track(0, BACKEND, SENIOR), track(1, DATA, OPEN)], BACKEND, True), ("EXPERIENCE_EXCLUDED", "DIRECT_MATCH", "EXCLUDED"),
    ),
    "the second track fits": (
        ("SUCCEEDED", "IT", "OPEN_RECRUITMENT", DATA, SENIOR, [track(0, BACKEND, SENIOR), track(1, BACKEND, OPEN)], BACKEND, True), (None, "DIRECT_MATCH", "FULL"),
    ),
    "unknown tracks don't count": (
        ("SUCCEEDED", "IT", None, BACKEND, OPEN, [track(0, BACKEND, OPEN, True), track(1, DATA, OPEN)], BACKEND, True), ("ANALYSIS_ROLE_MISMATCH", "MISMATCH", "UNKNOWN"),
    ),
    "one role has no tracks": (("SUCCEEDED", "IT", "ROLE_SPECIFIC", BACKEND, OPEN, [track(0, DATA, OPEN)], BACKEND, True), (None, "DIRECT_MATCH", "FULL")),
    "a general track, experience excluded": (
        ("SUCCEEDED", "IT", "MULTI_ROLE", DATA, OPEN, [track(0, GENERAL, SENIOR)], BACKEND, True), ("EXPERIENCE_EXCLUDED", "BROAD_IT_MATCH", "EXCLUDED"),
    ),
    "no preference, other tracks": (
        ("SUCCEEDED", "IT", "MULTI_ROLE", DATA, OPEN, [track(0, ["NON_DEV"], OPEN)], [], True), ("EXPERIENCE_EXCLUDED", "DIRECT_MATCH", "EXCLUDED"),
    ),
}


def test_classification_rules(spark):
    rows = [(name, s, d, sc, g, a, y, r, t, ok, new) for name, ((s, d, sc, g, (a, y, r), t, ok, new), _) in CASES.items()]
    df = spark.createDataFrame(
        rows, f"name string, status string, domain string, scope string, groups array<string>, accepts boolean, years int, need string, tracks array<{TRACK}>, acceptable array<string>, new_grad boolean"
    )
    col = F.col
    exp = policy.experience_match(col("accepts"), col("years"), col("need"), F.lit(None).cast("string"), col("new_grad"))
    single = scoring.single_role_match(col("groups"), col("acceptable"), exp)
    multi = scoring.multi_role_match(col("tracks"), col("acceptable"), col("new_grad"), policy.experience_match, scoring.IT_GROUPS)
    df = df.withColumn("m", scoring.classification_match(single, multi, col("status"), col("domain"), col("scope"), col("tracks")))
    no = F.lit(False)
    for r in df.select("name", "m", filters.classified_reason(F.lit(None), no, no, col("m"), no).alias("reason")).collect():
        reason, role, experience = CASES[r["name"]][1]
        assert r["reason"] == reason, r
        assert r["m"]["deferred"] or (r["m"]["role"], r["m"]["experience"]) == (role, experience), r


def test_pruning_never_changes_the_selection(spark):
    rng = random.Random(8)
    rows = [
        (u, k, rng.choice("ABCDE"), dt.date(2001, 8, rng.randint(1, 28)) if rng.random() < 0.8 else None, dt.date(2001, 7, rng.randint(1, 28)), rng.randint(0, 6) * 5, rng.random() < 0.2, rng.random() < 0.15)
        for u in range(60) for k in range(rng.randint(1, 40))
    ]
    df = spark.createDataFrame(rows, "user_id int, id int, company string, deadline date, first_seen date, adjusted int, is_new boolean, is_urgent boolean")
    whole, pruned = (ranking.select_top(x).select("user_id", "rank", "id") for x in (df, ranking.prune_for_top(df)))
    assert rows_of(whole) == rows_of(pruned)


@pytest.mark.parametrize("mode", list(recommend.MODES))
def test_group_join_loses_no_pair(spark, mode):
    reason, _ = recommend.MODES[mode]
    fact, user = recommend.facts(postings(spark, SF), analyses(spark, SF)), users(spark, SF)
    every = recommend.verdicts(fact.join(recommend.profiles(user))).filter(F.col(reason).isNull()).select("user_id", "id")
    joined = recommend.verdicts(recommend.candidate_pairs(fact, user, mode)).filter(F.col(reason).isNull()).select("user_id", "id")
    assert rows_of(every) == rows_of(joined)


def test_facets_give_what_pairs_give(spark):
    """Verdicts looked up by facet equal those worked out for each pair."""
    fact, user = recommend.facts(postings(spark, SF), analyses(spark, SF)), recommend.profiles(users(spark, SF))
    shown = ("id", "match", "keyword_reason", "class_reason", "keyword_score", "class_score", "parts")
    direct = recommend.verdicts(fact.join(user.filter("user_id % 4 = 0"))).select("user_id", *shown)
    f, u = recommend.with_facets(fact, 0), recommend.with_facets(user.filter("user_id % 4 = 0"), 1)
    looked_up = recommend.facet_verdicts(f.crossJoin(u), recommend.facet_values(f, u)).select("user_id", *shown)
    assert rows_of(direct) == rows_of(looked_up)


def test_backfill_limits_and_cursor(spark):
    from postmill.operators import state

    posts = spark.createDataFrame([(k, "h") for k in range(1, 31)], "id long, input_hash string")
    known = spark.createDataFrame([(3, "SUCCEEDED", "h", "1"), (4, "FAILED", "x", "0"), (5, "FALLBACK", "old", "1"), (99, "PENDING", "h", "1")], "posting_id long, status string, input_hash string, version string")
    with pytest.raises(ValueError):
        state.backfill(posts, known, "1", limit=1001)
    seen, cursor = [], None
    while True:
        rows = sorted(state.backfill(posts, known, "1", limit=7, after_id=cursor).collect())
        if not rows:
            break
        seen += [(r["id"], r["reason"]) for r in rows]
        cursor = rows[-1]["id"]
    assert [i for i, _ in seen] == list(range(1, 31))
    assert dict(seen[2:5]) == {3: "ALREADY_COMPLETED_SAME_VERSION", 4: "ALREADY_PENDING_OR_PROCESSING", 5: "VERSION_OR_INPUT_CHANGED"}
    after = {r["posting_id"]: (r["status"], r["input_hash"]) for r in state.apply_backfill(known, state.backfill(posts, known, "1", limit=5), "1").collect()}
    assert after[1] == ("PENDING", "h") and after[3] == ("SUCCEEDED", "h") and after[5] == ("PENDING", "h") and after[99] == ("PENDING", "h") and after[4] == ("FAILED", "x")
