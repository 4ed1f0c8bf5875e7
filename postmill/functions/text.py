"""Text, identity and hashing functions as Column expressions (all stay in codegen)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s\p{Z}]+"

# Legal suffixes removed from company names, in order.
COMPANY_SUFFIXES = ("(주)", "주식회사", " co.", " co,", " corp.", " corp,", " inc.", " inc,", " ltd.", " ltd,")

# Words that mark an internship, a new graduate opening, a title outside development.
INTERN_WORDS = ("인턴", "intern", "internship", "채용연계형")
NEW_GRAD_WORDS = ("신입", "new grad", "졸업예정")
NON_DEV_WORDS = (
    "마케팅", "marketing", "영업", "sales", "인사 담당", "인사팀", "hr manager", "human resource", "재무", "finance",
    "회계", "accounting", "product manager", "서비스 기획", "콘텐츠 에디터", "content writer", "content editor", "법무",
    "legal", "graphic designer", "ui designer", "ux designer",
)

# Words in a title and the role they stand for.
TITLE_ROLES = (
    ("데이터 엔지니어", "데이터 엔지니어"), ("data engineer", "데이터 엔지니어"), ("analytics engineer", "데이터 엔지니어"),
    ("서버 개발", "백엔드"), ("platform backend", "백엔드"), ("플랫폼 서버", "백엔드"), ("백엔드", "백엔드"),
    ("backend", "백엔드"), ("back-end", "백엔드"), ("server engineer", "백엔드"), ("프론트엔드", "프론트엔드"),
    ("frontend", "프론트엔드"), ("front-end", "프론트엔드"), ("풀스택", "풀스택"), ("fullstack", "풀스택"),
    ("full-stack", "풀스택"), ("ml engineer", "ML"), ("머신러닝", "ML"), ("machine learning", "ML"),
    ("인프라 엔지니어", "인프라"), ("infrastructure engineer", "인프라"), ("devops", "DevOps"), ("sre", "SRE"),
    ("android", "Android"), ("ios", "iOS"), ("모바일 개발", "모바일"),
)

# Patterns of instructions hidden in a posting, in order of precedence.
INJECTION_PATTERNS = (
    r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions",
    r"(?i)system\s+prompt",
    r"(?i)you\s+are\s+now\s+(?:a\s+)?",
    r"(?i)disregard\s+(?:your\s+)?(?:previous|prior)\s+",
    r"(?i)</?(?:system|instruction|prompt)>",
    r"\[INST\]|\[/INST\]",
)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def clean(c: Column) -> Column:
    return F.nullif(collapse(c), F.lit(""))


def clean_list(values: Column) -> Column:
    return F.filter(F.transform(values, clean), lambda x: x.isNotNull())


def normalize_company(c: Column) -> Column:
    out = F.lower(collapse(c))
    for suffix in COMPANY_SUFFIXES:
        out = F.replace(out, F.lit(suffix), F.lit(""))
    return F.trim(out)


def normalize_company_plain(c: Column) -> Column:
    """Trim and lower-case only; legal suffixes stay."""
    return F.lower(F.trim(c))


def normalize_title(c: Column) -> Column:
    return F.lower(collapse(c))


_URL = r"^([^:/?#]+)://([^/?#]*)([^?#]*)"


def canonical_url(url: Column, keep_query: bool = False) -> Column:
    """Lower-case scheme and authority (port kept), no trailing slash, ``/`` for an empty path, no query or fragment."""
    u = F.trim(url)
    path = F.rtrim(F.regexp_extract(u, _URL, 3), F.lit("/"))
    query = F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1) if keep_query else F.lit("")
    out = F.concat(
        F.lower(F.regexp_extract(u, _URL, 1)),
        F.lit("://"),
        F.lower(F.regexp_extract(u, _URL, 2)),
        F.when(path == "", F.lit("/")).otherwise(path),
        query,
    )
    return F.when(u.rlike(_URL), out).otherwise(u)


def canonical_host_url(url: Column) -> Column:
    """As stored for exposures: host without port, an empty path stays empty, invalid input is unchanged."""
    path = F.regexp_extract(url, _URL, 3)
    trimmed = F.rtrim(path, F.lit("/"))
    out = F.concat(
        F.lower(F.regexp_extract(url, _URL, 1)),
        F.lit("://"),
        F.lower(F.regexp_replace(F.regexp_extract(url, _URL, 2), r"^[^@]*@|:[0-9]*$", "")),
        F.when((path != "") & (trimmed == ""), F.lit("/")).otherwise(trimmed),
    )
    return F.when(url.rlike(r"^[^:/?#\s]+://[^/?#\s]+[^\s]*$"), out).otherwise(url)


def source_record_key(source: Column, external_id: Column, url: Column) -> Column:
    ident = F.coalesce(F.nullif(external_id, F.lit("")), canonical_url(url))
    return F.sha2(F.concat_ws("|", source, ident), 256)


def nullable_record_key(source: Column, external_id: Column, url: Column) -> Column:
    """The key if there is anything to identify the record by, else null."""
    some = F.coalesce(blank_to_null(external_id), blank_to_null(url)).isNotNull() & source.isNotNull()
    return F.when(some, source_record_key(source, external_id, url))


def content_hash(company: Column, title: Column, deadline: Column, description: Column) -> Column:
    """Change detection: the first 500 characters of the description count."""
    text = F.substring(F.regexp_replace(F.coalesce(description, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), 1, 500)
    parts = [company, title, F.coalesce(deadline.cast("string"), F.lit("")), text]
    return F.sha2(F.concat_ws("|", *parts), 256)


def canonical_fingerprint(company: Column, title: Column, deadline: Column) -> Column:
    return F.sha2(F.concat_ws("|", company, title, F.coalesce(deadline.cast("string"), F.lit(""))), 256)


def analysis_input_hash(
    title: Column, description: Column, roles: Column, experience: Column, employment: Column, truncated: Column
) -> Column:
    norm = lambda c: F.lower(collapse(F.coalesce(c, F.lit(""))))
    has_text = F.when(norm(description) != "", F.lit("1")).otherwise(F.lit("0"))
    flag = F.when(truncated.isNull(), F.lit("?")).when(truncated, F.lit("1")).otherwise(F.lit("0"))
    joined = F.array_join(F.array_sort(F.transform(F.coalesce(roles, F.array().cast("array<string>")), norm)), ",")
    return F.sha2(F.concat_ws("|", norm(title), norm(description), joined, norm(experience), norm(employment), has_text, flag), 256)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def infer_roles(title: Column) -> Column:
    """Distinct role labels of a title in table order; none for titles outside development."""
    low = F.lower(title)
    labels = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(label)) for w, label in TITLE_ROLES]))
    return F.when(contains_any(low, NON_DEV_WORDS), F.array().cast("array<string>")).otherwise(F.array_distinct(labels))


def primary_text(title: Column, roles_json: Column) -> Column:
    unwrapped = F.substr(roles_json, F.lit(2), F.greatest(F.length(roles_json) - 2, F.lit(0)))
    inner = F.when(F.startswith(roles_json, F.lit("[")), F.replace(unwrapped, F.lit('"'), F.lit(" "))).otherwise(roles_json)
    return F.concat(
        F.coalesce(F.concat(F.lower(title), F.lit(" ")), F.lit("")),
        F.when(F.trim(F.coalesce(roles_json, F.lit(""))) != "", F.lower(inner)).otherwise(F.lit("")),
    )


def truncate(c: Column, limit: int = 4000) -> tuple[Column, Column]:
    """The first ``limit`` characters, and whether that cut anything."""
    return F.substring(c, 1, limit), F.length(c) > limit


def clean_paragraphs(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"), F.lit(" \n\t\r"))


def strip_code_fences(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c, F.lit(" \n")), r"^```[A-Za-z]*\n?|\n?```$", ""), F.lit(" \n"))


def injection_match(text: Column) -> Column:
    """The first pattern's match, 60 characters at most; empty if there is none."""
    hits = [F.nullif(F.substring(F.regexp_extract(text, p, 0), 1, 60), F.lit("")) for p in INJECTION_PATTERNS]
    return F.coalesce(*hits, F.lit(""))


def unsupported_quotes(evidence: Column, text: Column) -> Column:
    """Quoted passages of 5 to 80 characters that the text doesn't hold."""
    quotes = F.regexp_extract_all(evidence, F.lit('"([^"]{5,80})"'), F.lit(1))
    return F.filter(quotes, lambda q: ~F.contains(F.lower(text), F.lower(q)))


def error_text(c: Column, limit: int = 500) -> Column:
    return F.substring(F.coalesce(c, F.lit("unknown")), 1, limit)


def contact_email(report_email: Column, email: Column) -> Column:
    return F.coalesce(blank_to_null(report_email), email)


def action_lines(content: Column) -> Column:
    """Numbered lines without their numbers."""
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(r"^\d+\.\s"))
    return F.transform(lines, lambda x: F.regexp_replace(x, r"^\d+\.\s+", ""))


def id_in_path(url: Column, pattern: str = r"/(\d+)(?:[/?#]|$)") -> Column:
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
