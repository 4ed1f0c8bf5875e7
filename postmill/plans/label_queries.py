"""Registered queries of site labels and section-aware experience, over values made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import labels, policy
from postmill.sources.fixtures import postings, with_postings


def _cycle(values, k):
    """One of ``values`` by ``k``; None is null."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (k % len(values) + 1).cast("int"))


def _sql(values, k: str = "id") -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"([{', '.join(map(quote, values))}])[CAST({k} % {len(values)} AS INT) + 1]"


#: Inputs with what they must give.
KAKAO = (
    (("백엔드 (신입)", "5년 이상"), "신입"), (("서버 (경력)", "7년 이상 또는 3년 이상"), "경력 3년 이상"), (("서버 (경력)", "2년~4년 경험"), "경력 2~4년"), (("서버 (경력직)", ""), "경력"),
    (("앱 (신입/경력)", "1년이상"), "신입/경력 1년 이상"), (("앱 (신입/경력)", None), "신입/경력"), (("앱 개발", "3년 이상"), None),
)
BOARD = (
    ("<h3>자격 요건</h3><p>경력 3년 이상 7년 이하</p><h3>우대 사항</h3><p>9년 이상</p>", "경력 3~7년"), ("<h2>지원 자격!</h2><ul><li>2~5년</li></ul>", "경력 2~5년"),
    ("<h3>우대 사항</h3><p>9년 이상</p>", None), ("<p>4년 이상</p><h4>필요 역량</h4><div>6 년 이상</div>", "경력 6년 이상"), ("<h3>주요 업무</h3><p>1년 이상</p>", None), ("", None),
)
TOSS = (
    ("## 이런 분과 함께하고 싶어요\n- 경력 5년 이상\n## 우대 사항\n- 10년 이상", "경력 5년 이상"), ("# 지원 자격\n3년 이상 6년 이하", "경력 3~6년"), ("# 자격 요건.\n신입 지원 가능\n2년 이상", "신입"),
    ("# 자격 요건\n경력무관", "경력 무관"), ("# 필수 자격\nPython", "경력"), ("# 우대사항\n3년 이상", None), ("3년 이상", None), ("# 지원 자격 (우대 조건)\n3년 이상", None), ("# 지원 자격\nJunior도 지원 가능", "신입"),
)
GREETING = ((("NEW_COMER", None), "신입"), (("EXPERIENCED", 3), "3년 이상"), (("EXPERIENCED", None), "경력"), (("NOT_MATTER", 1), "경력 무관"), (("OTHER", 2), None), ((None, None), None))
SAMSUNG = ((" 신입·경력 ", "신입/경력"), ("신입ㆍ경력", "신입/경력"), ("인턴", "인턴"), (" ", None), ("기타", "기타"))
SK = (("New", "신입"), (" Experienced", "경력"), ("Irrelevant", None), ("Both", "Both"), ("", None))
ROLES = (("개발,  보안 • 기획", "개발|보안|기획"), ("", ""), (" • ,AI", "AI"))


def register(add) -> None:
    col = F.col
    first = lambda table: [x for x, _ in table]
    second = lambda table: [y for _, y in table]

    def sections(s, d):
        k = col("id")
        return postings(s, d).select(
            "id",
            labels.board_level(_cycle(first(BOARD), k)).alias("board"),
            labels.toss_level(_cycle(first(TOSS), k), F.when(k % 25 == 3, "인턴"), F.when(k % 25 == 4, "서버 인턴십").otherwise("서버")).alias("toss"),
            labels.kakao_level(_cycle([t for (t, _), _ in KAKAO], k), _cycle([q for (_, q), _ in KAKAO], k)).alias("kakao"),
        )

    add("H57_H58_H60_section_levels", sections, with_postings(
        f"SELECT id, {_sql(second(BOARD))} AS board, CASE WHEN id % 25 IN (3, 4) THEN '인턴' ELSE {_sql(second(TOSS))} END AS toss, {_sql(second(KAKAO))} AS kakao FROM postings"))

    def codes(s, d):
        k = col("id")
        years = _cycle([None if y is None else str(y) for (_, y), _ in GREETING], k).cast("int")
        return postings(s, d).select(
            "id",
            labels.greeting_level(_cycle([t for (t, _), _ in GREETING], k), years).alias("greeting"),
            labels.samsung_level(_cycle(first(SAMSUNG), k)).alias("samsung"),
            labels.samsung_employment(col("title")).alias("samsung_employment"),
            labels.by_table(_cycle(first(SK), k), labels.SK_LEVELS).alias("sk"),
            labels.by_table(_cycle(["Permanent", "Contract", "Other", None], k), labels.SK_EMPLOYMENT).alias("sk_employment"),
            F.array_join(labels.sk_roles(_cycle(first(ROLES), k)), "|").alias("sk_roles"),
            labels.first_label(F.array(_cycle(["x", "intern", None], k), _cycle(["contractor", "full_time", "y"], k)), labels.ABLY_EMPLOYMENT).alias("ably_employment"),
            labels.by_table(_cycle(["SEOUL", "Remote", "판교"], k), labels.LOCATIONS).alias("place"),
        )

    add("H61_H62_H63_H64_H66_site_codes", codes, with_postings(f"""SELECT id, {_sql(second(GREETING))} AS greeting, {_sql(second(SAMSUNG))} AS samsung,
      CASE WHEN contains(title, '인턴') THEN '인턴' ELSE '정규직' END AS samsung_employment, {_sql(second(SK))} AS sk, {_sql(['정규직', '계약직', 'Other', None])} AS sk_employment, {_sql(second(ROLES))} AS sk_roles,
      {_sql(['계약직', '인턴', None])} AS ably_employment, {_sql(['서울', '원격', '판교'])} AS place FROM postings"""))

    # roles by id, the groups and ids that they must give
    plans = (
        (("백엔드", "Spring  Boot"), "BACKEND", "176"), (("SRE", "보안 엔지니어"), "DEVOPS_INFRA,SECURITY", "164,166"), (("정원사",), "", ""), (("iOS", "Software Engineer", "ML Engineer"), "MOBILE,AI_ML,GENERAL_SOFTWARE", "165,167,170,172,173"),
        (("Machine Learning Engineer", "  data   engineer "), "DATA_ENGINEERING,AI_ML", "167,179"), ((), "", ""),
    )

    def planned(s, d):
        roles = F.filter(F.split(_cycle([";".join(r) for r, _, _ in plans], col("id")), ";"), lambda x: x != "")
        groups, ids = policy.duty_plan(roles)
        return postings(s, d).select("id", F.array_join(groups, ",").alias("duty_groups"), F.array_join(ids, ",").alias("duty_ids"))

    add("H19_role_plan", planned, with_postings(f"SELECT id, {_sql([g for _, g, _ in plans])} AS duty_groups, {_sql([i for _, _, i in plans])} AS duty_ids FROM postings"))

    raws = (
        ("enrichment_failed: x", "enrichment_failed"), ("synthesis timeout", "synthesis_failed"), ("in rewrite", "rewrite_failed"), ("validation_status=bad", "validation_fallback_required"),
        ("unknown", "validation_retry_exhausted"), (" odd : y", "odd"), ("", None), (None, None),
    )

    def modes(s, d):
        k = col("id")
        enabled = k % 3 > 0
        mode = policy.generation_mode(k % 5, k % 2 == 0, enabled, k % 7)
        return postings(s, d).select("id", mode.alias("mode"), policy.fallback_reason(mode, _cycle([r for r, _ in raws], k), enabled).alias("reason"))

    mode = "CASE WHEN id % 5 = 0 THEN 'EMPTY' WHEN id % 2 = 0 OR id % 3 = 0 THEN 'FALLBACK' WHEN id % 7 > 0 THEN 'REWRITTEN' ELSE 'LLM' END"
    add("K18_generation_modes", modes, with_postings(
        f"SELECT id, {mode} AS mode, CASE WHEN {mode} IN ('EMPTY', 'FALLBACK') THEN coalesce({_sql([c for _, c in raws])}, CASE WHEN id % 3 > 0 THEN 'validation_retry_exhausted' ELSE 'llm_disabled' END) END AS reason FROM postings"))
