"""Row-level validation as arrays of codes, and deterministic report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def codes(*rules: tuple[str, Column]) -> Column:
    """The codes of the rules that fail, in rule order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(failed, F.lit(False)), F.lit(code)) for code, failed in rules]))


def severity(found: Column, fatal: tuple[str, ...]) -> Column:
    """pass < retryable < fallback_required."""
    worst = F.exists(found, lambda c: c.isin(*fatal))
    return F.when(worst, "fallback_required").when(F.size(found) > 0, "retryable").otherwise("pass")


def next_step(status: Column, rewrites: Column) -> Column:
    """One rewrite at most, then the fallback."""
    return F.when(status == "pass", "save").when((status == "retryable") & (rewrites < 1), "rewrite").otherwise("fallback")


def order_codes(expected: Column, found: Column) -> Column:
    same_set = F.array_sort(F.array_distinct(expected)) == F.array_sort(F.array_distinct(found))
    return F.when(expected == found, F.lit(None)).when(same_set, "ID_ORDER_MISMATCH").otherwise("ID_SET_MISMATCH")


def reasons(parts: list[tuple[Column, Column]], fallback: Column) -> Column:
    """Joined texts of the parts whose condition holds, else the fallback."""
    some = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), t) for c, t in parts]))
    return F.when(F.size(some) > 0, F.array_join(some, " · ")).otherwise(fallback)


def urgency(days: Column) -> tuple[list[Column], list[Column]]:
    return [days.between(0, 3), days.between(4, 7)], [
        F.concat(F.lit("마감 "), days.cast("string"), F.lit("일 전 — 긴급")),
        F.concat(F.lit("마감 "), days.cast("string"), F.lit("일 이내")),
    ]


def overflow_label(names: Column, shown: int = 3) -> Column:
    """The first names and how many more there are."""
    distinct = F.array_distinct(names)
    more = F.size(distinct) - shown
    head = F.array_join(F.slice(distinct, 1, shown), ", ")
    return F.when(more > 0, F.concat(head, F.lit(" 외 "), more.cast("string"), F.lit("개"))).otherwise(head)


def overflow_of(first: str, n: Column, shown: int = 3) -> Column:
    """As :func:`overflow_label` from the first names, already cut, and the number of all."""
    head = F.array_join(first, ", ")
    return F.when(n > shown, F.concat(head, F.lit(" 외 "), (n - shown).cast("string"), F.lit("개"))).otherwise(head)


def first_of(rows: DataFrame, key: str, *order: str, k: int = 7) -> DataFrame:
    """The first ``k`` rows of each key with their ``place``: what one report shows."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= k)


# Headings and sentences of the report.
HEADINGS = {
    "title": "# 오늘의 채용 브리핑", "summary": "## 오늘의 핵심 요약", "top": "## 🏆 추천 공고 TOP ", "near": "## ⏰ 신규/마감 임박 공고",
    "actions": "## 💡 오늘의 지원 추천 액션", "keywords": "## 🔑 오늘의 키워드", "closing": "## ✏️ 한 줄 정리",
}
NONE_NEAR = "선별된 공고 중 7일 이내 마감 임박 공고가 없습니다."
EMPTY = {
    "summary": ("- {date} 기준, 선호도에 맞는 채용 공고가 오늘은 없습니다.", "- 선호 조건을 확인하고 내일 다시 브리핑을 살펴보세요.", "- 조건을 조금 넓히면 더 많은 공고를 만날 수 있습니다."),
    "top": ("오늘 추천할 공고가 없습니다.",),
    "actions": ("1. 선호 조건(역할, 기업, 스킬, 위치)을 다시 확인해 보세요.", "2. 내일 다시 브리핑을 확인해 주세요."),
    "keywords": ("해당 사항 없습니다.",),
    "closing": ("내일은 더 많은 공고가 준비되어 있을 거예요.",),
}


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _sections(bodies: dict[str, Column], n: Column) -> Column:
    """The report around its sections' bodies, divided by rules."""
    out = [F.lit(f"{HEADINGS['title']}\n\n{HEADINGS['summary']}\n\n"), bodies["summary"]]
    for name in ("top", "near", "actions", "keywords", "closing"):
        out += [F.lit(f"\n\n---\n\n{HEADINGS[name]}"), *([n] if name == "top" else []), F.lit("\n\n"), bodies[name]]
    return _text(*out)


def empty_report(date: Column) -> Column:
    bodies = {k: F.replace(F.lit("\n".join(v)), F.lit("{date}"), date) for k, v in EMPTY.items()}
    return _sections(bodies | {"near": F.lit(NONE_NEAR)}, F.lit("0"))


def report(rows: DataFrame, key: str, date: Column, roles: list[str], skills: list[str]) -> DataFrame:
    """(key, n, content): a report per key over its articles (``place`` .. ``is_urgent``), at most seven each."""
    fields = ("place", "company", "title", "url", "source", "why", "deadline", "is_new", "is_urgent")
    per = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("articles"), F.count("*").alias("n"))
    companies = overflow_label(F.transform("articles", lambda a: a["company"]))
    top, n = F.get("articles", F.lit(0))["company"], F.col("n")
    near = F.filter("articles", lambda a: a["is_urgent"])
    badge = lambda a: F.concat(F.when(a["is_new"], " 🆕 NEW").otherwise(""), F.when(a["is_urgent"], " ⏰ URGENT").otherwise(""))
    day = lambda a: a["deadline"].cast("string")
    link = lambda a: F.when(F.coalesce(a["url"], F.lit("")) != "", _text("[공고 보기](", a["url"], ")")).otherwise(F.coalesce(a["source"], F.lit("채용 사이트")))
    article = lambda a: _text("### ", a["place"], ". ", a["title"], badge(a), "\n- **기업**: ", a["company"], "\n- **출처**: ", link(a), "\n- **추천 이유**: ", a["why"],
                              F.coalesce(_text("\n- **마감일**: ", day(a)), F.lit("")))
    matched = [*[f"{r} 역할" for r in roles[:1]], *([f"{', '.join(skills[:2])} 스킬"] if skills else [])]
    if matched:
        basis = F.lit(f"- 주요 매칭 조건: {' 및 '.join(matched)}이 선별 기준으로 반영되었습니다.")
    else:
        basis = _text("- 선호도 설정에 따라 ", n, "건의 공고가 추천되었습니다.")
    actions = [_text(top, "의 공고를 확인하고 즉시 지원해 보세요.")]
    if skills:
        actions.append(F.lit(f"이력서에 **{', '.join(skills[:2])}** 관련 프로젝트 경험을 구체적으로 작성하세요."))
    actions.append(F.when(F.size(near) > 0, _text("마감 임박 공고(", F.size(near), "건)를 오늘 안에 지원 검토하세요.")))
    if roles:
        actions.append(F.lit(f"{roles[0]} 관련 GitHub 또는 기술 포트폴리오를 최신화하세요."))
    keywords = list(dict.fromkeys([*skills[:5], *roles[:2]]))[:10]
    bodies = {
        "summary": _text("- ", date, " 기준, ", companies, "에서 ", n, "건의 추천 공고를 선별했습니다.\n", basis, "\n- ", top, "의 공고를 오늘 확인해 지원 타이밍을 놓치지 마세요."),
        "top": F.array_join(F.transform("articles", article), "\n\n"),
        "near": F.when(F.size(near) > 0, F.array_join(F.transform(near, lambda a: _text("- **", a["title"], "** (", a["company"], ") — 마감: ", day(a))), "\n")).otherwise(NONE_NEAR),
        "actions": F.array_join(F.transform(F.array_compact(F.array(*actions)), lambda a, i: _text(i + 1, ". ", a)), "\n"),
        "keywords": F.lit(" · ".join(keywords) or "채용 공고"),
        "closing": _text(f"{roles[0] if roles else '개발자'} 포지션 중심으로 ", companies, "에서 ", n, "건의 공고가 확인되었습니다. 지금 바로 지원해 보세요!"),
    }
    return per.select(key, "n", _sections(bodies, n).alias("content"))
