"""Site codes and sections turned into the labels postings carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Site codes and their labels.
GREETING_LEVELS = {"NEW_COMER": "신입", "NOT_MATTER": "경력 무관", "NEW_COMER_AND_EXPERIENCED": "신입/경력"}
SK_LEVELS = {"New": "신입", "Experienced": "경력", "Irrelevant": None}
SK_EMPLOYMENT = {"Permanent": "정규직", "Contract": "계약직"}
ABLY_EMPLOYMENT = {"full_time": "정규직", "intern": "인턴", "contractor": "계약직"}
LOCATIONS = {"SEOUL": "서울", "Seoul": "서울", "서울": "서울", "BUSAN": "부산", "REMOTE": "원격", "Remote": "원격"}
# Headings of required and of preferred sections.
BOARD_REQUIRED = ("이런 분을 찾고 있어요", "이런 분과 함께하고 싶어요", "이런 분이에요", "지원 자격", "자격 요건", "필수 요건", "필요 역량")
TOSS_REQUIRED = (
    "이런 분과 함께하고 싶어요", "이런 분을 찾고 있어요", "이런 분이에요", "지원 자격을 꼭 확인해주세요", "지원 자격", "자격 요건", "필수 요건", "필수 자격",
)
TOSS_PREFERRED = ("이런 경험이 있다면 더 좋아요", "이런 경험이 있으면 더 좋아요", "우대사항", "우대 사항", "우대 조건")


def by_table(code: Column, table: dict[str, str | None], other: Column | None = None) -> Column:
    """The label of a trimmed code; a code outside the table gives ``other``, by default itself, blank nothing."""
    c = F.trim(code)
    out = F.when(F.coalesce(c, F.lit("")) == "", F.lit(None).cast("string"))
    for key, label in table.items():
        out = out.when(c == key, F.lit(label).cast("string"))
    return out.otherwise(c if other is None else other)


def greeting_level(kind: Column, years_from: Column) -> Column:
    experienced = F.when(years_from.isNotNull(), F.concat(years_from.cast("string"), F.lit("년 이상"))).otherwise("경력")
    return by_table(kind, GREETING_LEVELS, F.when(kind == "EXPERIENCED", experienced))


def samsung_level(card: Column) -> Column:
    """The card's text with either middle dot as a slash; blank is nothing."""
    return F.nullif(F.regexp_replace(F.trim(F.coalesce(card, F.lit(""))), "[·ㆍ]", "/"), F.lit(""))


def samsung_employment(title: Column) -> Column:
    return F.when(F.contains(title, F.lit("인턴")), "인턴").when(F.contains(title, F.lit("계약직")), "계약직").otherwise("정규직")


def sk_roles(roles: Column) -> Column:
    """Groups are divided by a bullet, roles within them by commas."""
    parts = F.transform(F.split(F.coalesce(roles, F.lit("")), "[•,]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def first_label(values: Column, table: dict[str, str]) -> Column:
    """The label of the first value that the table knows."""
    known = F.filter(values, lambda v: v.isin(*table))
    return F.get(F.transform(known, lambda v: by_table(v, table)), F.lit(0))


def kakao_level(title: Column, qualification: Column) -> Column:
    """The hint in the title's brackets, with the least year that the qualification asks for."""
    q = F.coalesce(qualification, F.lit(""))
    hint = F.nullif(F.regexp_extract(title, r"\((신입/경력|신입|경력)[^)]*\)", 1), F.lit(""))
    over = F.array_min(F.transform(F.regexp_extract_all(q, F.lit(r"(\d+)년\s*이상"), F.lit(1)), lambda x: x.cast("int")))
    ranged = lambda k: F.nullif(F.regexp_extract(q, r"(\d+)년[~-](\d+)년", k), F.lit("")).cast("int")
    low, high = F.nullif(F.coalesce(over, ranged(1)), F.lit(0)), F.when(over.isNull(), F.nullif(ranged(2), F.lit(0)))
    at_least = F.concat(low.cast("string"), F.lit("년 이상"))
    between = F.concat(low.cast("string"), F.lit("~"), high.cast("string"), F.lit("년"))
    return (
        F.when(hint == "신입", "신입")
        .when(hint == "경력", F.coalesce(F.concat(F.lit("경력 "), between), F.concat(F.lit("경력 "), at_least), hint))
        .when(hint.isNotNull(), F.coalesce(F.concat(hint, F.lit(" "), at_least), hint))
    )


def section(text: Column, opens, closes=None) -> Column:
    """The lines below headings (``#``) that ``opens`` accepts and ``closes`` doesn't, joined; null if there are none."""
    empty = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("kept"))

    def step(state, line):
        bare = F.trim(line)
        heading = F.regexp_replace(bare, r"^#+\s*|[.!。…\s]+$", "")
        wanted = opens(heading) if closes is None else opens(heading) & ~closes(heading)
        kept = F.when(state["on"], F.concat(state["kept"], F.array(line))).otherwise(state["kept"])
        return F.when(F.startswith(bare, F.lit("#")), F.struct(wanted.alias("on"), state["kept"].alias("kept"))).otherwise(F.struct(state["on"].alias("on"), kept.alias("kept")))

    found = F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), empty, step, lambda s: s["kept"])
    return F.when(F.size(found) > 0, F.array_join(found, "\n"))


def years_label(text: Column, bare_range: bool = False) -> Column:
    """``경력 a~b년`` or ``경력 a년 이상`` by the first form that the text has."""
    part = lambda pattern, k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    both = lambda pattern: F.concat(F.lit("경력 "), part(pattern, 1), F.lit("~"), part(pattern, 2), F.lit("년"))
    one = lambda pattern: F.concat(F.lit("경력 "), part(pattern, 1), F.lit("년 이상"))
    forms = [both(r"경력\s*(\d+)\s*년\s*이상\s*(\d+)\s*년\s*이하")]
    if bare_range:
        forms.append(both(r"(\d+)\s*년\s*이상\s*(\d+)\s*년\s*이하"))
    forms += [both(r"(\d+)\s*[~～&]\s*(?:sim;)?(\d+)\s*년"), one(r"경력\s*(\d+)\s*년\s*이상"), one(r"(\d+)\s*년\s*이상")]
    return F.coalesce(*forms)


def board_level(markup: Column) -> Column:
    """Experience in the required sections of a board's HTML, whose headings are matched whole."""
    plain = F.regexp_replace(F.regexp_replace(markup, r"(?is)<h[1-4][^>]*>(.*?)</h[1-4]>", "\n# $1\n"), r"<[^>]+>", "\n")
    return years_label(section(plain, lambda h: h.isin(*BOARD_REQUIRED)))


def toss_level(description: Column, employment: Column, title: Column) -> Column:
    """Experience in the required sections of a markdown description; newcomers are looked for before years."""
    holds = lambda words: lambda h: h.rlike("|".join(words))
    text = section(description, holds(TOSS_REQUIRED), holds(TOSS_PREFERRED))
    return (
        F.when(F.coalesce(employment == "인턴", F.lit(False)) | F.contains(title, F.lit("인턴")), "인턴")
        .when(text.isNull(), F.lit(None).cast("string"))
        .when(text.rlike("경력 ?무관"), "경력 무관")
        .when(text.rlike(r"신입\s*(지원\s*가능|또는|도\s*가능|부터|~|/)|(?i:신입|freshman|junior).*가능"), "신입")
        .otherwise(F.coalesce(years_label(text, bare_range=True), F.when(text.rlike(r"\S"), "경력")))
    )
