"""Rows of particular job services: nested JSON to postings, and lists joined with their details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import dates
from postmill.sources.parsers import given

_NAME = "struct<name:string>"
_JOBS = (
    "struct<jobs:struct<job:array<struct<id:string,url:string,company:struct<detail:struct<name:string>>,"
    f"position:struct<title:string,`job-type`:{_NAME},location:{_NAME},`experience-level`:{_NAME},`job-category`:{_NAME}>,"
    "keyword:string,`expiration-date`:string,`posting-date`:string>>>>"
)


def service_jobs(body: Column) -> Column:
    """Array of postings of a job service's answer; those without address, company or title are none of them.

    The category is the only role, the comma-separated keywords are the skills; blank fields are null or empty.
    """
    jobs = F.from_json(body, _JOBS)["jobs"]["job"]
    words = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda k: F.trim(k)), lambda k: k != "")

    def row(j: Column) -> Column:
        p = j["position"]
        category = given(p["job-category"]["name"])
        return F.struct(
            given(j["id"]).alias("external_id"), given(j["url"]).alias("url"), given(j["company"]["detail"]["name"]).alias("company"), given(p["title"]).alias("title"),
            given(p["job-type"]["name"]).alias("employment"), given(p["location"]["name"]).alias("location"), given(p["experience-level"]["name"]).alias("experience_level"),
            F.when(category.isNull(), F.array().cast("array<string>")).otherwise(F.array(category)).alias("roles"), words(j["keyword"]).alias("skills"),
            dates.iso_day(given(j["expiration-date"])).alias("deadline"), F.try_to_timestamp(given(j["posting-date"])).alias("posted"),
        )

    rows = F.transform(F.coalesce(jobs, F.from_json(F.lit('{"jobs":{"job":[]}}'), _JOBS)["jobs"]["job"]), row)
    return F.filter(rows, lambda r: r["url"].isNotNull() & r["company"].isNotNull() & r["title"].isNotNull())


# Labels of a service's broad job groups, which are no roles, its career codes, and where its postings are.
BROAD_GROUPS = ("IT서비스", "IT Service", "경영지원", "영업/마케팅")
CAREERS = {"A": "신입", "B": "경력", "C": "인턴", "D": "신입·경력", "E": "산학장학생"}
NOTICE_URL = "https://careers.lg.com/apply/"
_NOTICES = "struct<data:struct<jobNoticeList:array<struct<jobNoticeId:bigint,companyCode:string,jobNoticeName:string,careerTypeCode:string,careerTypeName:string>>>>"
_DETAIL = (
    "struct<data:struct<jobNoticesDetail:struct<jobNoticesDetail:struct<companyName:string,jobNoticeName:string,careerTypeCode:string,careerTypeName:string,qualForAppInfo:string,"
    "recStartDate:string,recEndDate:string>,recList:array<struct<jobGroupName:string,locationName:string>>>>>"
)


def notices(lists: DataFrame, details: DataFrame, code: str, name: str, max_discover: int = 50, max_fetch: int = 30) -> tuple[DataFrame, DataFrame]:
    """(postings, report) of lists of notices (source_id, company, body) and details (job_id, body).

    Of a list the first ``max_discover`` notices count, and the first ``max_fetch`` of these are looked up. A notice of another company code, one without detail and one whose
    detail names another company are warnings. The detail's values go before the list's. The report has counters and warnings per source.
    """
    col = F.col
    found = F.from_json("body", _NOTICES)["data"]["jobNoticeList"]
    rows = lists.select("source_id", "company", F.coalesce(F.size(found), F.lit(0)).alias("discovered"), F.posexplode_outer(F.slice(found, 1, min(max_discover, max_fetch))).alias("pos", "n"))
    known = details.select("job_id", F.from_json("body", _DETAIL)["data"]["jobNoticesDetail"].alias("w")).withColumn("there", F.lit(True)).dropDuplicates(["job_id"])
    mine = col("n.companyCode").eqNullSafe(F.lit(code))
    joined = rows.join(known, mine & (col("n.jobNoticeId") == col("job_id")), "left")
    d = lambda field: col(f"w.jobNoticesDetail.{field}")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    warning = (
        F.when(col("n").isNull(), F.lit(None).cast("string"))
        .when(~mine, text("skipped ", col("n.jobNoticeId"), " — companyCode=", col("n.companyCode")))
        .when(col("there").isNull(), text("detail failed for ", col("n.jobNoticeId")))
        .when(~d("companyName").eqNullSafe(F.lit(name)), text("skipped ", col("n.jobNoticeId"), " — companyName=", d("companyName")))
    )
    told = joined.withColumn("warning", warning)
    first = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), F.coalesce(b, F.lit("")))
    careers = F.create_map(*[F.lit(x) for pair in CAREERS.items() for x in pair])
    groups = F.transform(F.coalesce(col("w.recList"), F.array().cast("array<struct<jobGroupName:string,locationName:string>>")), lambda r: F.struct(given(r["jobGroupName"]).alias("group"), given(r["locationName"]).alias("place")))
    day = lambda c: F.try_to_timestamp(F.nullif(F.regexp_extract(c, r"(\d{4}\.\d{2}\.\d{2})", 1), F.lit("")), F.lit("yyyy.MM.dd")).cast("date")
    career = first(d("careerTypeCode"), col("n.careerTypeCode"))
    postings = told.filter("n IS NOT NULL AND warning IS NULL").select(
        "source_id", "pos", col("n.jobNoticeId").cast("string").alias("external_id"), text(NOTICE_URL, col("n.jobNoticeId")).alias("url"), "company", first(d("jobNoticeName"), col("n.jobNoticeName")).alias("title"),
        F.array_distinct(F.filter(F.transform(groups, lambda r: r["group"]), lambda g: g.isNotNull() & ~g.isin(*BROAD_GROUPS))).alias("roles"),
        F.get(F.filter(F.transform(groups, lambda r: r["place"]), lambda p: p.isNotNull()), F.lit(0)).alias("location"),
        F.coalesce(F.try_element_at(careers, career), first(d("careerTypeName"), col("n.careerTypeName"))).alias("experience_level"),
        F.when(career == "C", "인턴").otherwise("정규직").alias("employment"), day(d("recStartDate")).alias("posted"), day(d("recEndDate")).alias("deadline"), given(d("qualForAppInfo")).alias("description"),
    )
    report = told.groupBy("source_id").agg(
        F.max("discovered").alias("discovered"), F.count_if(mine & col("there").isNotNull()).alias("fetched"), F.count_if(col("n").isNotNull() & col("warning").isNull()).alias("parsed"),
        F.array_sort(F.collect_list("warning")).alias("warnings"),  # max_fetch at most
    )
    return postings, report
