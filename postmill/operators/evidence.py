"""What speaks for a recommendation: the matched values behind each part of a score, and the reasons they make.

Built for winners only: scores need no lists, so the lists are made after the selection, by joining it back with its postings and users.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.operators.scoring import WEIGHTS, prefix_match

KINDS = ("roles", "companies", "skills", "industries", "locations", "experience_levels", "employment_types", "company_sizes")
#: How many values of a kind a reason names, and its words around them.
REASONS = (
    ("companies", 2, "관심 기업 ", ""), ("roles", 2, "", " 역할 일치"), ("skills", 3, "", " 스킬 매칭"), ("locations", 2, "", " 근무"),
    ("experience_levels", 1, "", " 경력 조건 부합"), ("employment_types", 1, "", ""),
)
#: Words of the last resort and of the deadline.
NO_REASON, JOINT = "관심 조건에 기반한 추천", " · "
_LIST = "array<string>"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _first(values: Column, hit) -> Column:
    return F.slice(F.filter(values, hit), 1, 1)


def _of(condition: Column, value: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(value)).otherwise(F.array().cast(_LIST))


def match_evidence(
    prefs: dict[str, Column], role: Column, primary_text: Column, company: Column, skills_text: Column, experience: Column, experience_level: Column, industries: Column,
    location: Column, employment: Column, company_size: Column,
) -> Column:
    """Struct of lists by kind. ``role`` and ``experience`` are verdicts; ``prefs`` has a list per kind."""
    most_skills = WEIGHTS["skills_max"] // WEIGHTS["skill"]
    place = _text(location)
    same = lambda values, x: F.exists(values, lambda v: F.lower(v) == F.lower(x))
    skills = F.filter(prefs["skills"], lambda s: F.contains(F.lower(_text(skills_text)), F.lower(s)))
    found = {
        "roles": F.when(role == "MATCH", F.filter(prefs["roles"], lambda r: F.contains(primary_text, F.lower(r)))).otherwise(F.array().cast(_LIST)),
        "companies": _of(F.exists(prefs["companies"], lambda c: prefix_match(F.lower(company), F.lower(c))), company),
        "skills": F.slice(skills, 1, most_skills),
        "industries": _first(prefs["industries"], lambda i: F.exists(industries, lambda c: F.lower(c) == F.lower(i))),
        "locations": _first(prefs["locations"], lambda p: F.contains(place, p) | F.contains(p, place)),
        "experience_levels": _of((experience == "PASS_FULL") & (F.trim(_text(experience_level)) != ""), experience_level),
        "employment_types": _of(same(prefs["employment_types"], _text(employment)), employment),
        "company_sizes": _of(same(prefs["company_sizes"], company_size), company_size),
    }
    return F.struct(*[found[k].alias(k) for k in KINDS])


def why(evidence: Column, prefs: dict[str, Column], company: Column, title: Column, skills: Column, location: Column, experience_level: Column, urgent: Column, days_left: Column) -> Column:
    """The reasons of an article: from the evidence, else from preferences that equal the posting's values, then the deadline; at last the posting's name."""
    empty = F.array().cast(_LIST)
    said = lambda values, most, before, after: F.when(F.size(values) > 0, F.concat(F.lit(before), F.array_join(F.slice(values, 1, most), ", "), F.lit(after)))
    from_evidence = F.array_compact(F.array(*[said(evidence[k], n, before, after) for k, n, before, after in REASONS]))
    low = F.transform(F.coalesce(skills, empty), lambda s: F.lower(s))
    fallback = {
        "companies": _first(prefs["companies"], lambda c: c == company),
        "roles": _first(prefs["roles"], lambda r: F.contains(F.lower(_text(title)), F.lower(r))),
        "skills": F.filter(prefs["skills"], lambda s: F.array_contains(low, F.lower(s))),
        "locations": _first(prefs["locations"], lambda p: F.contains(_text(location), p)),
        "experience_levels": _first(prefs["experience_levels"], lambda x: x == experience_level),
    }
    from_prefs = F.array_compact(F.array(*[said(fallback[k], n, before, after) for k, n, before, after in REASONS if k in fallback]))
    reasons = F.when(F.size(from_evidence) > 0, from_evidence).otherwise(from_prefs)
    days = F.when(F.coalesce(urgent, F.lit(False)), days_left)
    deadline = F.when(days.between(0, 3), F.concat(F.lit("마감 "), days.cast("string"), F.lit("일 전 — 긴급"))).when(days.between(1, 7), F.concat(F.lit("마감 "), days.cast("string"), F.lit("일 이내")))
    every = F.concat(reasons, F.when(deadline.isNull(), empty).otherwise(F.array(deadline)))
    name = F.trim(F.concat(_text(company), F.lit(" "), _text(title)))
    return F.when(F.size(every) > 0, F.array_join(every, JOINT)).when(name != "", name).otherwise(NO_REASON)
