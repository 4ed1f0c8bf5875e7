"""Validators of generated answers: one array of codes per row, in rule order, without collecting a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an item may hold, and what a report must and must not hold.
JOB_DOMAINS = ("IT", "NON_IT", "MIXED", "UNKNOWN")
SCOPES = ("ROLE_SPECIFIC", "MULTI_ROLE", "OPEN_RECRUITMENT", "UNKNOWN")
TRACK_SCOPES = ("MULTI_ROLE", "OPEN_RECRUITMENT")
ROLE_GROUPS = ("BACKEND", "FRONTEND", "FULLSTACK", "DATA", "AI_ML", "MOBILE", "DEVOPS_INFRA", "GENERAL_IT", "OTHER_IT", "NON_DEV")
RECRUITMENTS = ("EXPERIENCED_HIRE", "NEW_GRAD_HIRE", "OPEN_HIRE", "INTERNSHIP", "UNKNOWN")
REQUIREMENTS = ("REQUIRED", "PREFERRED", "NONE", "UNKNOWN")
SECTIONS = ("오늘의 핵심 요약", "추천 공고 TOP", "신규/마감 임박 공고", "오늘의 지원 추천 액션", "오늘의 키워드", "한 줄 정리")
PROMISES = ("합격 가능성이 높", "합격 보장", "반드시 합격", "경쟁률이 낮")
ADVICE = ("매수", "매도", "투자 추천", "수익률 보장")
MAX_CONTENT = 15_000


def _when(bad: Column, code: str, value: Column | None = None) -> Column:
    """The code, with a value behind a colon, where ``bad`` holds."""
    text = F.lit(code) if value is None else F.concat(F.lit(f"{code}:"), value)
    return F.when(F.coalesce(bad, F.lit(False)), text)


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with ``value`` worked out once however often ``of`` uses it."""
    return F.transform(F.array(value), of)[0]


def _facts(raw: Column) -> Column:
    """What the codes of an item or a track are made from, as a struct; texts that only faulty ones show are left to :func:`_codes`."""
    text = lambda name: F.coalesce(F.variant_get(raw, f"$.{name}", "string"), F.lit("UNKNOWN")).alias(name)
    kind = lambda name: F.schema_of_variant(F.variant_get(raw, f"$.{name}", "variant")).alias(f"{name}Kind")
    years = lambda name: F.try_variant_get(raw, f"$.{name}", "long").alias(name)
    groups = F.coalesce(F.try_variant_get(raw, "$.roleGroups", "array<string>"), F.array().cast("array<string>"))
    return F.struct(
        text("jobDomain"), text("recruitmentType"), text("experienceRequirementType"), groups.alias("groups"), F.filter(groups, lambda g: g.isin(*ROLE_GROUPS)).alias("known"),
        kind("acceptsNewGrad"), kind("minRequiredYears"), years("minRequiredYears"), kind("maxRequiredYears"), years("maxRequiredYears"),
    )


def _clash(facts: Column, domain: str) -> Column:
    """Whether development roles stand under ``domain``."""
    return (facts["jobDomain"] == domain) & F.exists(facts["known"], lambda g: g != "NON_DEV")


def _codes(raw: Column, facts: Column, prefix: str) -> list[Column]:
    """Codes that items and tracks share, in order; null for those that don't hold."""
    domain, recruitment, need, accepts = facts["jobDomain"], facts["recruitmentType"], facts["experienceRequirementType"], facts["acceptsNewGradKind"]
    odd = lambda g: ~g.isin(*ROLE_GROUPS)
    strange = F.array_join(F.array_sort(F.array_distinct(F.filter(facts["groups"], odd))), ",")

    def years(name: str) -> tuple[Column, Column]:
        value, kind = facts[name], facts[f"{name}Kind"]
        given = F.coalesce(~kind.isin("VOID"), F.lit(False))
        bad = given & (~kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | (value < 0))
        return bad, F.when(~bad, value)

    low_bad, low = years("minRequiredYears")
    high_bad, high = years("maxRequiredYears")
    shown = lambda name: F.coalesce(F.variant_get(raw, f"$.{name}", "string"), F.lit(""))
    of_roles = _when(_clash(facts, "NON_IT"), f"{prefix}CONTRADICTION_NONIT" + ("_DEV_ROLES" if prefix else "_WITH_DEV_ROLES"), F.array_join(facts["known"], ","))
    of_hire = _when(~recruitment.isin(*RECRUITMENTS), f"{prefix}INVALID_RECRUITMENT_TYPE", recruitment)
    of_need = _when(~need.isin(*REQUIREMENTS), f"{prefix}INVALID_EXP_REQ_TYPE", need)
    return [
        _when(~domain.isin(*JOB_DOMAINS), f"{prefix}INVALID_JOB_DOMAIN", domain),
        F.when(F.exists(facts["groups"], odd), _once(strange, lambda s: _when(s != "", f"{prefix}INVALID_ROLE_GROUPS", s))),
        *((of_need, of_hire, of_roles) if prefix else (of_roles, of_hire, of_need)),
        _when(~accepts.isin("BOOLEAN", "VOID"), f"{prefix}INVALID_ACCEPTS_NEW_GRAD_TYPE", F.lower(accepts)),
        _when(low_bad, f"{prefix}INVALID_MIN_YEARS", shown("minRequiredYears")),
        _when(high_bad, f"{prefix}INVALID_MAX_YEARS", shown("maxRequiredYears")),
        _when(high < low, f"{prefix}YEAR_RANGE_INVALID", F.concat(low.cast("string"), F.lit("-"), high.cast("string"))),
    ]


def item_codes(json: Column, expected_id: Column) -> Column:
    """Codes of one classified item, given as JSON, and of all its tracks; another id is the only code of its item.

    The JSON is parsed once, each track's facts are read once.
    """

    def of_track(track: Column) -> Column:
        facts = lambda f: F.struct(F.array(*_codes(track, f, "TRACK_")).alias("codes"), _clash(f, "IT").alias("clash"))
        return _once(_facts(track), facts)

    def of_item(raw: Column) -> Column:
        scope = F.coalesce(F.variant_get(raw, "$.postingScope", "string"), F.lit("UNKNOWN"))
        tracks = F.coalesce(F.try_variant_get(raw, "$.tracks", "array<variant>"), F.array().cast("array<variant>"))

        def codes(facts: Column) -> Column:
            own = _codes(raw, facts["own"], "")
            own.insert(1, _when(~facts["scope"].isin(*SCOPES), "INVALID_POSTING_SCOPE", facts["scope"]))
            last = (
                _when(facts["scope"].isin(*TRACK_SCOPES) & (F.size(facts["tracks"]) == 0), "TRACKS_EMPTY_FOR_SCOPE", facts["scope"]),
                _when((facts["own"]["jobDomain"] == "NON_IT") & F.exists(facts["tracks"], lambda t: t["clash"]), "CONTRADICTION_ROOT_NONIT_TRACK_IT_DEV"),
            )
            return F.array_compact(F.concat(F.array(*own), F.flatten(facts["tracks"]["codes"]), F.array(*last)))

        got = F.try_variant_get(raw, "$.jobPostingId", "long")
        mismatch = F.concat(F.lit("ID_MISMATCH:got="), F.coalesce(got.cast("string"), F.lit("None")), F.lit(",expected="), expected_id.cast("string"))
        return (
            F.when(raw.isNull(), F.array(F.lit("INVALID_JSON")))
            .when(~got.eqNullSafe(expected_id.cast("long")), F.array(mismatch))
            .otherwise(_once(F.struct(_facts(raw).alias("own"), scope.alias("scope"), F.transform(tracks, of_track).alias("tracks")), codes))
        )

    return _once(F.try_parse_json(json), of_item)


def report_codes(content: Column, summary: Column, referenced: Column, expected: Column, urls: Column, keywords: Column, allowed: Column) -> Column:
    """Codes of a drafted report against the postings it was drafted from (ids, addresses, keywords as arrays)."""
    blank = lambda x: ~F.coalesce(x, F.lit("")).rlike(r"\S")
    same_set = F.array_sort(F.array_distinct(referenced)) == F.array_sort(F.array_distinct(expected))
    order = F.when(referenced == expected, F.lit(None).cast("string")).when(same_set, "ID_ORDER_MISMATCH").otherwise("ID_SET_MISMATCH")
    none = F.array().cast("array<string>")
    unknown = F.transform(F.filter(referenced, lambda i: ~F.array_contains(expected, i)), lambda i: F.concat(F.lit("UNKNOWN_POSTING_ID:"), i))
    links = F.regexp_extract_all(content, F.lit(r"\((https?://[^)\s]+)\)"), F.lit(1))
    foreign = F.transform(F.filter(links, lambda u: ~F.array_contains(urls, u)), lambda u: F.concat(F.lit("UNKNOWN_URL:"), F.substring(u, 1, 80)))
    lower = F.transform(allowed, F.lower)
    strange = F.filter(keywords, lambda k: (F.length(k) > 1) & ~F.array_contains(lower, F.lower(k)))
    keyword = F.when(F.size(strange) > 0, F.concat(F.lit("KEYWORD_OUT_OF_SCOPE:"), F.substring(F.get(strange, F.lit(0)), 1, 30)))
    holds = lambda words, code: [_when(F.contains(content, F.lit(w)), code, F.lit(w)) for w in words]
    found = F.concat(
        F.array(_when(blank(summary), "EMPTY_SUMMARY"), *[_when(~F.contains(content, F.lit(x)), "MISSING_SECTION", F.lit(x)) for x in SECTIONS], order),
        unknown,
        foreign,
        F.array(keyword, *holds(PROMISES, "HALLUCINATION"), *holds(ADVICE, "INVESTMENT_ADVICE"), _when(F.length(content) > MAX_CONTENT, "CONTENT_TOO_LONG", F.length(content).cast("string"))),
    )
    return F.when(blank(content), F.array(F.lit("EMPTY_CONTENT"))).otherwise(F.coalesce(F.array_compact(found), none))


def report_status(codes: Column) -> Column:
    """pass, retryable, or fallback_required where nothing can be rewritten."""
    fatal = F.exists(codes, lambda c: (c == "EMPTY_CONTENT") | F.startswith(c, F.lit("INVESTMENT_ADVICE:")))
    return F.when(fatal, "fallback_required").when(F.size(codes) > 0, "retryable").otherwise("pass")
