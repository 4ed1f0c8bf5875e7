"""Evidence and reasons by example, and paged discovery against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import evidence
from postmill.sources import boards

PREFS = {"roles": ["백엔드", "Data"], "companies": ["naver", "kakao"], "skills": ["Java", "Spring", "SQL", "Go", "C", "Rust"], "industries": ["FIN", "IT"], "locations": ["서울", "판교"],
         "experience_levels": ["신입"], "employment_types": ["정규직"], "company_sizes": ["LARGE"]}
POST = {"role": "MATCH", "primary": "백엔드 개발자 backend", "company": "Naver Cloud", "title": "백엔드 개발자", "skills": '["Java","Spring","SQL","Go","C","Rust"]', "exp": "PASS_FULL", "level": "신입",
        "industries": ["it", "fin"], "location": "서울 강남", "employment": "정규직", "size": "large", "urgent": False, "days": 5}


def run(spark, post=None, prefs=None):
    p, u = POST | (post or {}), PREFS | (prefs or {})
    lit = lambda v: F.lit(v).cast("string") if v is None or isinstance(v, str) else F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)
    c, pref = {k: lit(v) for k, v in p.items()}, {k: lit(v) for k, v in u.items()}
    found = evidence.match_evidence(pref, c["role"], c["primary"], c["company"], c["skills"], c["exp"], c["level"], c["industries"], c["location"], c["employment"], c["size"])
    skills = F.from_json(c["skills"], "array<string>")
    df = spark.range(1).select(found.alias("e")).withColumn("why", evidence.why(F.col("e"), pref, c["company"], c["title"], skills, c["location"], c["level"], c["urgent"], c["days"]))
    row = df.first()
    return row["e"].asDict(), row["why"]


def test_every_kind(spark):
    found, why = run(spark)
    assert found == {"roles": ["백엔드"], "companies": ["Naver Cloud"], "skills": ["Java", "Spring", "SQL", "Go", "C"], "industries": ["FIN"], "locations": ["서울"], "experience_levels": ["신입"], "employment_types": ["정규직"], "company_sizes": ["large"]}
    assert why == "관심 기업 Naver Cloud · 백엔드 역할 일치 · Java, Spring, SQL 스킬 매칭 · 서울 근무 · 신입 경력 조건 부합 · 정규직"


NOTHING = {"role": "AMBIGUOUS", "primary": "", "company": "X", "skills": None, "exp": "PASS_PARTIAL", "industries": [], "location": "부산", "employment": None, "size": None}


@pytest.mark.parametrize(
    ("post", "prefs", "want"),
    [
        ({"urgent": True, "days": 3}, {}, " · 마감 3일 전 — 긴급"), ({"urgent": True, "days": 4}, {}, " · 마감 4일 이내"), ({"urgent": True, "days": 8}, {}, "정규직"),
        (NOTHING | {"title": "T", "level": None}, {}, "X T"), (NOTHING | {"title": None, "company": None, "level": None}, {}, "관심 조건에 기반한 추천"),
        (NOTHING | {"title": "data 백엔드"}, {"roles": ["Data", "백엔드"]}, "Data 역할 일치 · 신입 경력 조건 부합"),
        (NOTHING | {"title": "T", "company": "kakao", "level": "x"}, {"companies": ["zzz", "kakao"]}, "관심 기업 kakao"),
        (NOTHING | {"title": "T", "level": "x", "urgent": True, "days": 0}, {}, "마감 0일 전 — 긴급"),
    ],
)
def test_reasons(spark, post, prefs, want):
    assert run(spark, post, prefs)[1].endswith(want)


def test_preferences_speak_only_without_evidence(spark):
    assert run(spark, NOTHING | {"company": "kakao", "title": "T", "level": "x"})[1] == "관심 기업 kakao"
    assert run(spark, NOTHING | {"title": "백엔드", "employment": "정규직"})[1] == "정규직"


def discovered_by_loop(pages, limit):
    out = []
    for listing in sorted({p[0] for p in pages}):
        held, seen, found, k = {p[1]: p[2] for p in pages if p[0] == listing}, set(), [], 1
        while len(found) < limit and held.get(k):
            new = 0
            for pos, item in enumerate(held[k]):
                if item not in seen:
                    seen.add(item)
                    found.append((listing, k, pos, item, len(found) + 1))
                    new += 1
                if len(found) >= limit:
                    break
            if not new:
                break
            k += 1
        out += found
    return sorted(out)


@pytest.mark.parametrize("limit", [1, 5, 12, 1000])
def test_discovery_stops_where_a_reader_would(spark, limit):
    d = random.Random(limit)
    pages = [(f"l{j}", k, [d.randrange(6 + 3 * j) for _ in range(d.choice([0, 3, 4, 4, 4]))]) for j in range(9) for k in range(1, 9) if d.random() > 0.06]
    pages += [("once", 1, [1, 1, 1]), ("gap", 2, [1]), ("known", 1, [1, 2]), ("known", 2, [2, 1]), ("known", 3, [9])]
    df = spark.createDataFrame(pages, "listing string, page int, items array<int>")
    assert sorted(map(tuple, boards.discovered(df, limit).collect())) == discovered_by_loop(pages, limit)
