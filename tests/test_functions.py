"""Behavioural examples of functions, policies and operators."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from postmill.functions import dates, policy, text
from postmill.operators import dedup, filters, ranking, state, validation
from postmill.sources import parsers


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("name", ["네이버(주)", " 네이버 ", "네이버  주식회사", "네이버"])
def test_company_names(spark, name):
    assert value(spark, text.normalize_company(F.lit(name))) == "네이버"


@pytest.mark.parametrize(
    ("url", "canonical"),
    [
        ("HTTPS://Example.COM/jobs/1/", "https://example.com/jobs/1"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com:80/a?q=1#x", "https://example.com:80/a"),
    ],
)
def test_canonical_url(spark, url, canonical):
    assert value(spark, text.canonical_url(F.lit(url))) == canonical


def test_canonical_url_keeps_query_on_request(spark):
    assert value(spark, text.canonical_url(F.lit("https://E.org/a?job=1#x"), keep_query=True)) == "https://e.org/a?job=1"


@pytest.mark.parametrize(
    ("raw", "category"),
    [("3년 이상", "EXPERIENCED"), ("1년 이상", "JUNIOR"), ("0~1년", "ENTRY"), ("신입/경력 모집", "MIXED"), ("5년 이하", "UNKNOWN"),
     ("신입 가능", "NEW_GRAD"), ("2~4년", "JUNIOR"), (None, "UNKNOWN"), ("경력(3년)", "EXPERIENCED"), ("senior", "EXPERIENCED")],
)
def test_parse_experience(spark, raw, category):
    assert value(spark, policy.parse_experience(F.lit(raw).cast("string")))["category"] == category


@pytest.mark.parametrize(("days", "points"), [(-2, 30), (1, 30), (3, 25), (6, 10), (7, 0), (None, 0)])
def test_exposure_penalty(spark, days, points):
    assert value(spark, dates.exposure_penalty(F.lit(days).cast("int"))) == points


def test_last_korean_date(spark):
    assert value(spark, dates.last_korean_date(F.lit("2024년 1월 2일 ~ 2024년 3월 4일"))) == dt.date(2024, 3, 4)
    assert value(spark, dates.last_korean_date(F.lit("2024년 13월 2일"))) is None
    assert value(spark, dates.last_korean_date(F.lit("none"))) is None


def test_dates_never_fail(spark):
    for f in (dates.iso_day, dates.dotted_time, dates.range_end, dates.english_date, dates.feed_time):
        assert value(spark, f(F.lit("not a date"))) is None


def test_filter_boundaries(spark):
    ref = F.lit("2024-01-10").cast("date")
    day = lambda x: F.lit(x).cast("date")
    assert not value(spark, filters.is_expired(day("2024-01-10"), ref))
    assert not value(spark, filters.is_expired(day(None), ref))
    assert value(spark, filters.is_stale(day("2024-01-01"), day(None), ref, 7))
    assert not value(spark, filters.is_stale(day("2024-01-01"), day("2024-01-20"), ref, 7))
    assert not value(spark, filters.is_stale(day(None), day(None), ref, 7))


def greedy(rows, k=7, min_new=2, cap=2):
    """The selection told as a loop."""
    far = dt.date(9999, 1, 1)
    order = sorted(rows, key=lambda r: (-r["adjusted"], r["deadline"] or far, -(r["first_seen"] or dt.date(1, 1, 1)).toordinal(), r["id"]))
    picked, per = [], {}

    def take(r):
        co = r["company"].lower()
        if r in picked or per.get(co, 0) >= cap:
            return False
        per[co] = per.get(co, 0) + 1
        picked.append(r)
        return True

    for r in order:
        if r["is_urgent"] and take(r):
            break
    for r in order:
        if sum(p["is_new"] for p in picked) >= min_new:
            break
        if r["is_new"]:
            take(r)
    for r in order:
        if len(picked) >= k:
            break
        take(r)
    return [r["id"] for r in picked]


def test_selector_against_loop(spark):
    import random

    rng = random.Random(5)
    rows = []
    for user in range(60):
        for k in range(rng.randint(0, 25)):
            rows.append({"user_id": user, "id": user * 100 + k, "company": rng.choice(["a", "A", "b", "c", "d"]), "adjusted": rng.randint(0, 5),
                         "deadline": rng.choice([None, dt.date(2024, 1, rng.randint(1, 28))]), "first_seen": rng.choice([None, dt.date(2024, 1, rng.randint(1, 5))]),
                         "is_new": rng.random() < 0.3, "is_urgent": rng.random() < 0.15})
    df = spark.createDataFrame(rows, "user_id int, id int, company string, adjusted int, deadline date, first_seen date, is_new boolean, is_urgent boolean")
    found = {}
    for r in ranking.select_top(df).orderBy("user_id", "rank").collect():
        found.setdefault(r["user_id"], []).append(r["id"])
    for user in range(60):
        own = [r for r in rows if r["user_id"] == user]
        assert found.get(user, []) == greedy(own)


def test_merge_clusters_takes_first_non_null(spark):
    df = spark.createDataFrame(
        [(1, "k", "s1", "u1", None, ["a"]), (2, "k", "s2", "u2", "x", ["b", "a"]), (3, "z", "s1", "u3", None, None)],
        "seq int, key string, source string, url string, d string, l array<string>",
    )
    rows = {r["seq"]: r for r in dedup.merge_clusters(df, F.col("key"), ["source", "url"], ["d"], ["l"]).collect()}
    assert (rows[1]["source"], rows[1]["d"], rows[1]["l"], rows[1]["n_merged"]) == ("s1", "x", ["a", "b"], 2)
    assert rows[3]["l"] == [] and rows[3]["d"] is None


def test_upsert_policies(spark):
    schema = "id int, hash string, place string"
    old = spark.createDataFrame([(1, "a", "P"), (2, "a", None), (3, "a", "P")], schema)
    new = spark.createDataFrame([(1, "b", "Q"), (2, "a", "Q"), (4, "c", "R")], schema)
    rows = {r["id"]: (r["action"], r["place"]) for r in state.upsert(old, new, "id", ["hash"], ["place"], "hash").collect()}
    assert rows == {1: ("UPDATE", "Q"), 2: ("TOUCH", "Q"), 3: ("KEEP", "P"), 4: ("INSERT", "R")}


def test_injection(spark):
    assert value(spark, text.injection_match(F.lit("please IGNORE previous instructions"))) == "IGNORE previous instructions"
    assert value(spark, text.injection_match(F.lit("nothing"))) == ""


def test_parser_key(spark):
    for config, expected in ((None, (None, None)), ("{", (None, "invalid_json")), ("{}", (None, "missing_key")), ('{"parser_key":""}', (None, "empty_key")), ('{"parser_key":" x "}', ("X", None))):
        assert tuple(value(spark, parsers.parser_key(F.lit(config).cast("string")))) == expected


def test_streaming_equals_batch(spark, tmp_path):
    from postmill.streaming import events
    from tests.oracle import SF

    stream = events.windowed_counts(events.read_events(spark, SF), lateness="60 days")
    got = events.run_to_table(stream, "windows_t", str(tmp_path))
    rows = {(r["w"]["start"].date(), r["event_type"]): (r["n"], round(r["total"], 2)) for r in got.collect()}
    from postmill import registry

    batch = {(r["day"], r["event_type"]): (r["n"], round(r["total"], 2)) for r in registry.QUERIES["I12_stream_windows"](spark, SF).collect()}
    assert rows == batch


def planned_uses(spark, name, *columns):
    """How often a function stands in the optimized plan of ``columns`` over a text ``t``."""
    rows = spark.range(1).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("t")).repartition(2)
    with_all = {"spark.sql.debug.maxToStringFields": "100000"}
    before = {k: spark.conf.get(k) for k in with_all}
    try:
        for k, v in with_all.items():
            spark.conf.set(k, v)
        return rows.select(*[c.alias(f"c{k}") for k, c in enumerate(columns)])._jdf.queryExecution().optimizedPlan().toString().count(name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_duty_plan_reads_a_role_once_a_column(spark):
    assert planned_uses(spark, "regexp_replace(", *policy.duty_plan(F.split("t", ";"))) == 2


@pytest.mark.parametrize(
    ("roles", "groups", "ids"),
    [
        (None, [], []), ([], [], []), ([None, " ", "정원사"], [], []), (["SRE", None, "보안 엔지니어", "sre"], ["DEVOPS_INFRA", "SECURITY"], [164, 166]),
        (["sw engineer", "  Spring\t  BOOT "], ["BACKEND", "GENERAL_SOFTWARE"], [165, 170, 176]), (["서버 개발 및 인프라"] * 40, ["BACKEND"], [176]),
    ],
)
def test_duty_plan_of_odd_roles(spark, roles, groups, ids):
    given = F.lit(None).cast("array<string>") if roles is None else F.array(*map(F.lit, roles)).cast("array<string>")
    assert [value(spark, c) for c in policy.duty_plan(given)] == [groups, ids]


def test_item_codes_parse_an_item_once(spark):
    assert planned_uses(spark, "parseJson(", validation.item_codes(F.col("t"), F.lit(1))) == 1


def test_item_codes_of_all_tracks(spark):
    sound = {"jobDomain": "IT", "roleGroups": ["DATA"]}
    tracks = [sound] * 9 + [{"jobDomain": "BOTH", "roleGroups": ["CHEF", "DATA"], "minRequiredYears": 3, "maxRequiredYears": 2}]
    codes = lambda tracks: value(spark, validation.item_codes(F.lit(json.dumps({"jobPostingId": 1, "postingScope": "MULTI_ROLE", "tracks": tracks})), F.lit(1)))
    assert codes(tracks) == ["TRACK_INVALID_JOB_DOMAIN:BOTH", "TRACK_INVALID_ROLE_GROUPS:CHEF", "TRACK_YEAR_RANGE_INVALID:3-2"]
    assert codes(tracks[:9]) == []
    assert codes([]) == ["TRACKS_EMPTY_FOR_SCOPE:MULTI_ROLE"]


@pytest.mark.parametrize(
    ("item", "codes"),
    [
        (None, ["INVALID_JSON"]), ("{", ["INVALID_JSON"]), ("[]", ["ID_MISMATCH:got=None,expected=1"]), ('{"jobPostingId":1,"tracks":[null,3,"x",{}],"roleGroups":[null]}', []),
        ('{"jobPostingId":1,"acceptsNewGrad":"no","minRequiredYears":1.5,"maxRequiredYears":-1}', ["INVALID_ACCEPTS_NEW_GRAD_TYPE:string", "INVALID_MIN_YEARS:1.5", "INVALID_MAX_YEARS:-1"]),
    ],
)
def test_item_codes_of_odd_items(spark, item, codes):
    assert value(spark, validation.item_codes(F.lit(item).cast("string"), F.lit(1))) == codes
