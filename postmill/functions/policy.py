"""Role, experience and classification policies as decision columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Role groups and the words that signal them.
ROLE_GROUPS = {
    "BACKEND": ("백엔드", "backend", "back-end", "server engineer", "서버 개발", "java developer", "spring developer",
                "api developer", "platform backend", "플랫폼 서버", "서버 엔지니어"),
    "FRONTEND": ("프론트엔드", "frontend", "front-end", "react developer", "web frontend", "웹 프론트", "ui 개발"),
    "FULLSTACK": ("풀스택", "fullstack", "full-stack", "full stack"),
    "DATA": ("데이터 엔지니어", "data engineer", "analytics engineer", "데이터 분석", "data analyst", "데이터 사이언티스트",
             "data scientist"),
    "AI_ML": ("ai engineer", "ai 엔지니어", "ml engineer", "machine learning", "머신러닝", "인공지능", "인공지능 엔지니어",
              "deep learning", "딥러닝", "nlp engineer"),
    "MOBILE": ("android", "ios", "mobile developer", "모바일 개발", "모바일 엔지니어"),
    "DEVOPS_INFRA": ("devops", "sre", "infrastructure engineer", "cloud engineer", "인프라 엔지니어", "platform engineer",
                     "reliability engineer"),
    "NON_DEV": ("마케팅", "marketing", "영업 담당", "영업 사원", "영업직", "영업직무", "세일즈", "영업 대표", "고객 상담",
                "상담사", "고객 서비스", "고객센터", "콜센터", "customer service", "customer support", "customer success",
                "인사 담당", "인사팀", "hr manager", "human resource", "재무 담당", "재무팀", "finance manager", "회계 담당",
                "회계사", "accounting", "product manager", "서비스 기획", "콘텐츠 에디터", "content writer",
                "content editor", "법무 담당", "법무팀", "legal counsel", "graphic designer", "ui designer", "ux designer"),
}
COMPATIBLE = {
    "BACKEND": ("BACKEND", "FULLSTACK"), "FRONTEND": ("FRONTEND", "FULLSTACK"),
    "FULLSTACK": ("FULLSTACK", "BACKEND", "FRONTEND"),
}
NEW_GRAD_LEVELS = ("신입", "신입사원", "인턴", "new grad")
MIXED = ("신입/경력", "신입·경력", "경력/신입", "신입및경력", "신입,경력")
ANY_LEVEL = ("경력무관", "무관", "경력불문", "경력무방")
AGGREGATORS = ("jasoseol", "saramin", "fixture")


def _word_pattern(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def role_groups(text: Column) -> Column:
    """All groups a lower-case text signals."""
    return F.array_compact(F.array(*[F.when(text.rlike(_word_pattern(w)), F.lit(g)) for g, w in ROLE_GROUPS.items()]))


def acceptable_groups(roles: Column) -> Column:
    """Groups compatible with any preferred role; the non-development group never is."""
    found = F.flatten(F.transform(roles, lambda r: role_groups(F.lower(r))))
    table = F.create_map(
        *[x for g in ROLE_GROUPS if g != "NON_DEV" for x in (F.lit(g), F.array(*map(F.lit, COMPATIBLE.get(g, (g,)))))]
    )
    groups = F.filter(F.array_distinct(found), lambda g: g != "NON_DEV")
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: table[g])))


def role_verdict(acceptable: Column, posting_groups: Column) -> Column:
    return (
        F.when(F.size(acceptable) == 0, "AMBIGUOUS")
        .when(F.arrays_overlap(acceptable, posting_groups), "MATCH")
        .when(F.size(posting_groups) == 0, "AMBIGUOUS")
        .otherwise("MISMATCH")
    )


def _experience(category: str, low: Column | int, high: Column | int, strict: bool, confidence: float) -> Column:
    as_int = lambda x: x.cast("int") if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(category).alias("category"),
        as_int(low).alias("min_years"),
        as_int(high).alias("max_years"),
        F.lit(strict).alias("strict"),
        F.lit(confidence).alias("confidence"),
    )


def parse_experience(raw: Column) -> Column:
    """Struct (category, min_years, max_years, strict, confidence); -1 stands for no bound known."""
    low = F.lower(raw)
    s = F.replace(F.lower(F.trim(raw)), F.lit(" "), F.lit(""))
    between, least = r"(\d+)[~\-](\d+)\s*년", r"(\d+)\s*년\s*이상"
    number = lambda pattern, k: F.try_to_number(F.nullif(F.regexp_extract(low, pattern, k), F.lit("")), F.lit("999999999")).cast("int")
    a, b, m = number(between, 1), number(between, 2), number(least, 1)
    mixed = F.lit(False)
    for word in MIXED:
        mixed = mixed | F.contains(s, F.lit(word))
    unknown = _experience("UNKNOWN", -1, -1, False, 0.0)
    return (
        F.when(F.coalesce(F.trim(raw), F.lit("")) == "", unknown)
        .when(mixed, _experience("MIXED", 0, -1, False, 1.0))
        .when(s.isin("신입", "신입사원", "졸업예정자", "인턴"), _experience("NEW_GRAD", 0, 0, False, 1.0))
        .when(F.startswith(s, F.lit("신입")), _experience("NEW_GRAD", 0, 0, False, 0.9))
        .when(s.isin(*ANY_LEVEL), _experience("ENTRY", 0, -1, False, 1.0))
        .when(s.isin("0~1년", "0-1년", "0년이상"), _experience("ENTRY", 0, 1, False, 1.0))
        .when(low.rlike(between) & (a == 0), _experience("ENTRY", 0, b, False, 1.0))
        .when(low.rlike(between) & (a >= 3), _experience("EXPERIENCED", a, b, False, 1.0))
        .when(low.rlike(between), _experience("JUNIOR", a, b, False, 1.0))
        .when(low.rlike(least) & (m >= 3), _experience("EXPERIENCED", m, -1, True, 1.0))
        .when(low.rlike(least), _experience("JUNIOR", m, -1, True, 1.0))
        .when(s.isin("주니어", "junior"), _experience("JUNIOR", 1, 2, False, 0.9))
        .when(s.isin("시니어", "senior", "중급이상", "고급"), _experience("EXPERIENCED", 3, -1, False, 0.9))
        .when((s == "경력") | F.startswith(s, F.lit("경력(")), _experience("EXPERIENCED", -1, -1, False, 0.7))
        .otherwise(unknown)
    )


def experience_from_title(title: Column) -> Column:
    """Category by title: any level, then both, then experienced only."""
    s = F.replace(F.lower(F.trim(title)), F.lit(" "), F.lit(""))
    return (
        F.when(s.rlike("경력무관|경력불문|경력무방"), "ENTRY")
        .when(F.contains(s, F.lit("신입")) & F.contains(s, F.lit("경력")), "MIXED")
        .when(F.contains(s, F.lit("경력")), "EXPERIENCED")
        .otherwise("UNKNOWN")
    )


def is_new_grad(levels: Column) -> Column:
    return F.coalesce(F.exists(levels, lambda x: F.lower(F.trim(x)).isin(*NEW_GRAD_LEVELS)), F.lit(False))


def experience_verdict(levels: Column, level_categories: Column, category: Column) -> Column:
    """PASS_FULL, PASS_PARTIAL or EXCLUDE; ``level_categories`` are the user's levels, parsed."""
    fits = F.exists(level_categories, lambda c: (c == category) | c.isin("MIXED", "UNKNOWN"))
    return (
        F.when(category.isin("ENTRY", "MIXED"), "PASS_FULL")
        .when(category == "UNKNOWN", "PASS_PARTIAL")
        .when(F.size(levels) == 0, "PASS_FULL")
        .when(
            is_new_grad(levels),
            F.when(category == "NEW_GRAD", "PASS_FULL").when(category == "JUNIOR", "PASS_PARTIAL").otherwise("EXCLUDE"),
        )
        .when(fits, "PASS_FULL")
        .otherwise("PASS_PARTIAL")
    )


def is_official(source: Column) -> Column:
    return (F.coalesce(F.trim(source), F.lit("")) != "") & ~F.lower(source).isin(*AGGREGATORS)


def experience_match(
    accepts_new_grad: Column, min_years: Column, requirement: Column, recruitment: Column, new_grad: Column
) -> Column:
    """FULL, PARTIAL or EXCLUDED; unknown facts never exclude."""
    other = F.when(requirement.isin("NONE", "REQUIRED"), "FULL").otherwise("PARTIAL")
    return (
        F.when(~new_grad, other)
        .when(accepts_new_grad.eqNullSafe(False), "EXCLUDED")
        .when((requirement == "REQUIRED") & (min_years >= 1), "EXCLUDED")
        .when(requirement == "PREFERRED", "PARTIAL")
        .when(accepts_new_grad.eqNullSafe(True), "FULL")
        .when(requirement == "NONE", "FULL")
        .when(recruitment.isin("OPEN_HIRE", "NEW_GRAD_HIRE"), "FULL")
        .when(min_years == 0, "FULL")
        .otherwise("PARTIAL")
    )


def classify_by_rules(words: Column, level: Column, description: Column, truncated: Column, table) -> Column:
    """The fallback classifier: struct (domain, role_group, min_years, requirement, scope, confidence, why).

    ``table`` lists (domain, group, words) in order of precedence; the first group with a word in the text decides.
    """
    low = F.lower(words)
    first = lambda k, none: F.coalesce(*[F.when(low.rlike(_word_pattern(r[2])), F.lit(r[k])) for r in table], none)
    domain = first(0, F.lit("UNKNOWN"))
    years = F.nullif(F.regexp_extract(level, r"(\d+)\s*년", 1), F.lit("")).cast("int")
    unknown = domain == "UNKNOWN"
    none = F.coalesce(description, F.lit("")) == ""
    why = F.array(
        F.when(unknown, "INSUFFICIENT_ROLE_SIGNAL"),
        F.when(none, "NO_DESCRIPTION").when(F.coalesce(truncated, F.lit(False)), "DESCRIPTION_TRUNCATED"),
    )
    return F.struct(
        domain.alias("domain"),
        first(1, F.lit(None).cast("string")).alias("role_group"),
        years.alias("min_years"),
        F.when(years.isNull(), "UNKNOWN").when(F.contains(level, F.lit("우대")), "PREFERRED").otherwise("REQUIRED").alias("requirement"),
        F.when(unknown, "UNKNOWN").otherwise("ROLE_SPECIFIC").alias("scope"),
        F.when(~unknown, 0.5).alias("confidence"),
        F.array_compact(why).alias("why"),
    )


# Duty groups in order, their public ids, and the words that name them.
DUTIES = {
    "BACKEND": ((176,), ("백엔드", "서버 개발", "서버개발", "server engineer", "backend engineer", "backend developer", "back-end", "java developer", "api developer", "spring", "서버")),
    "FRONTEND": ((175,), ("프론트엔드", "프론트 엔드", "frontend engineer", "frontend developer", "front-end", "react developer", "web frontend", "vue developer", "angular developer")),
    "MOBILE": ((172, 173), ("android developer", "ios developer", "모바일 개발", "모바일개발", "모바일", "mobile developer", "mobile engineer", "android", "ios")),
    "DEVOPS_INFRA": ((164, 166), ("infrastructure engineer", "cloud engineer", "인프라 엔지니어", "인프라엔지니어", "devops engineer", "site reliability", "sre", "devops", "인프라")),
    "DATA_ENGINEERING": ((179,), ("데이터 엔지니어", "데이터엔지니어", "data engineer")),
    "AI_ML": ((167,), ("machine learning engineer", "ml engineer", "ai engineer", "머신러닝 엔지니어", "머신러닝엔지니어", "llm engineer", "machine learning")),
    "SECURITY": ((166,), ("application security", "security engineer", "보안 엔지니어", "보안엔지니어")),
    "GENERAL_SOFTWARE": ((165, 170), ("software engineer", "sw engineer", "소프트웨어 개발자", "소프트웨어개발자")),
}


def duty_of(role: Column) -> Column:
    """The first duty group with a word in the role, or null."""
    low = F.lower(F.regexp_replace(F.trim(role), r"\s+", " "))
    holds = lambda text, words: reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])
    first = lambda text: F.coalesce(*[F.when(holds(text, words), F.lit(g)) for g, (_, words) in DUTIES.items()])
    return F.transform(F.array(low), first)[0]  # a lambda's argument is worked out once, however often it is used


def duty_plan(roles: Column) -> tuple[Column, Column]:
    """The duty groups of a list of roles, in their own order, and their ids, sorted; unknown roles are skipped.

    Either column names the roles once, so each works out a role's group once.
    """
    found = F.transform(F.coalesce(roles, F.array().cast("array<string>")), duty_of)
    groups = F.array_intersect(F.array(*map(F.lit, DUTIES)), found)
    table = F.create_map(*[x for g, (numbers, _) in DUTIES.items() for x in (F.lit(g), F.array(*map(F.lit, numbers)))])
    return groups, F.array_sort(F.array_distinct(F.flatten(F.transform(groups, lambda g: table[g]))))


def generation_mode(n_selected: Column, fallback: Column, enabled: Column, rewrites: Column) -> Column:
    return F.when(n_selected == 0, "EMPTY").when(fallback | ~enabled, "FALLBACK").when(rewrites > 0, "REWRITTEN").otherwise("LLM")


def fallback_reason(mode: Column, raw: Column, enabled: Column) -> Column:
    """The category of a fallback, from a raw reason; null for reports that needed none."""
    text = F.coalesce(raw, F.lit(""))
    return F.when(
        mode.isin("FALLBACK", "EMPTY"),
        F.when(text == "", F.when(enabled, "validation_retry_exhausted").otherwise("llm_disabled"))
        .when(F.contains(text, F.lit("enrichment")), "enrichment_failed")
        .when(F.contains(text, F.lit("synthesis")), "synthesis_failed")
        .when(F.contains(text, F.lit("rewrite")), "rewrite_failed")
        .when(text.rlike("validation_status|FALLBACK_REQUIRED"), "validation_fallback_required")
        .when(text.isin("unknown", "deterministic_fallback"), "validation_retry_exhausted")
        .otherwise(F.substring(F.trim(F.split(text, ":")[0]), 1, 60)),
    )
