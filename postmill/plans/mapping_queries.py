"""Registered row mappings of job services and posting pages, over markup made from the postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.sources import mappings, parsers
from postmill.sources.fixtures import postings, with_postings


def register(add) -> None:
    col = F.col
    joined = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    def jobs(s, d):
        i = col("id")
        job = joined('{"id":', i, ',"url":"', F.when(i % 7 == 0, " ").otherwise(joined("https://s.example/", i)), '","active":1,"company":{"detail":{"href":"x","name":" ', col("company"), ' "}},"position":{"title":"T', i, '"',
                     F.when(i % 3 > 0, joined(',"job-type":{"code":"1","name":"', F.when(i % 3 == 1, "정규직").otherwise(""), '"}')).otherwise(""), ',"location":{"name":"서울"},"job-category":{"name":"', F.when(i % 2 == 0, "개발").otherwise(" "), '"}},"keyword":" a, ,b', i, '",',
                     '"expiration-date":"2001-09-0', i % 9 + 1, 'T23:59:59+0900","posting-date":"', F.when(i % 5 == 0, "soon").otherwise("2001-08-01T10:00:00Z"), '"}')
        body = F.when(i % 11 == 0, "{bad").otherwise(joined('{"jobs":{"count":2,"job":[', job, ',{"id":0,"url":"u","position":{"title":"no company"}}]}}'))
        rows = postings(s, d).select("id", F.explode(mappings.service_jobs(body)).alias("r")).select("id", "r.*")
        return rows.withColumns({"roles": F.array_join("roles", "|"), "skills": F.array_join("skills", "|"), "posted": col("posted").cast("date")})

    add("A17_service_jobs", jobs, with_postings("""SELECT id, CAST(id AS VARCHAR) AS external_id, 'https://s.example/' || id AS url, company, 'T' || id AS title, CASE WHEN id % 3 = 1 THEN '정규직' END AS employment, '서울' AS location, CAST(NULL AS VARCHAR) AS experience_level,
      CASE WHEN id % 2 = 0 THEN '개발' ELSE '' END AS roles, 'a|b' || id AS skills, DATE '2001-09-01' + CAST(id % 9 AS INT) AS deadline, CASE WHEN id % 5 > 0 THEN DATE '2001-08-01' END AS posted FROM postings WHERE id % 7 > 0 AND id % 11 > 0"""))

    def notice_inputs(s, d):
        i = col("id")
        p = postings(s, d)
        notice = lambda k: joined('{"jobNoticeId":', i * 10 + k, ',"companyCode":"', F.when(i % 5 == k, "OTHER").otherwise("CNS"), '","jobNoticeName":"list', i, '","careerTypeCode":"', F.when(i % 4 == 0, "Z").otherwise("B"), '","careerTypeName":"other"}')
        lists = p.select(i.alias("source_id"), "company", F.when(i % 17 == 0, "{}").otherwise(joined('{"data":{"jobNoticeList":[', notice(0), ",", notice(1), ",", notice(2), "]}}")).alias("body"))
        detail = joined('{"data":{"jobNoticesDetail":{"jobNoticesDetail":{"companyName":"', F.when(col("job_id") % 7 == 0, "LG X").otherwise("LG CNS"), '","jobNoticeName":"', F.when(i % 3 == 0, "").otherwise(joined("detail", i)), '","careerTypeCode":"', F.when(i % 4 == 1, "C").otherwise(""),
                        '","qualForAppInfo":" q ","recStartDate":"2001.08.01 09:00","recEndDate":"', F.when(i % 6 == 0, "2001.13.45").otherwise("2001.09.30 23:00"), '"},"recList":[{"jobGroupName":"IT서비스"},{"jobGroupName":" Cloud ","locationName":" "},{"jobGroupName":"Cloud","locationName":"서울"},{"jobGroupName":"Data","locationName":"부산"}]}}}')
        details = p.select("id", F.explode(F.array(i * 10, i * 10 + 1, i * 10 + 2)).alias("job_id")).filter("job_id % 9 > 0").select("job_id", detail.alias("body"))
        return mappings.notices(lists, details, "CNS", "LG CNS", max_fetch=2)

    add("A27_notices", lambda s, d: notice_inputs(s, d)[0].withColumn("roles", F.array_join("roles", "|")), with_postings("""SELECT id AS source_id, k AS pos, CAST(job_id AS VARCHAR) AS external_id, 'https://careers.lg.com/apply/' || job_id AS url, company,
      CASE WHEN id % 3 = 0 THEN 'list' || id ELSE 'detail' || id END AS title, 'Cloud|Data' AS roles, '서울' AS location, CASE id % 4 WHEN 1 THEN '인턴' WHEN 0 THEN 'other' ELSE '경력' END AS experience_level, CASE WHEN id % 4 = 1 THEN '인턴' ELSE '정규직' END AS employment,
      DATE '2001-08-01' AS posted, CASE WHEN id % 6 > 0 THEN DATE '2001-09-30' END AS deadline, 'q' AS description
      FROM (SELECT *, id * 10 + k AS job_id FROM postings, (VALUES (0), (1)) v(k)) q WHERE id % 17 > 0 AND id % 5 <> k AND job_id % 9 > 0 AND job_id % 7 > 0"""))
    add("A27_notice_report", lambda s, d: notice_inputs(s, d)[1].withColumn("warnings", F.array_join("warnings", "|")), with_postings("""SELECT id AS source_id, CAST(CASE WHEN id % 17 = 0 THEN 0 ELSE 3 END AS INT) AS discovered, count(*) FILTER (WHERE there AND mine) AS fetched, count(*) FILTER (WHERE there AND mine AND job_id % 7 > 0) AS parsed,
      coalesce(string_agg(w, '|' ORDER BY w), '') AS warnings FROM (SELECT id, job_id, there, mine, CASE WHEN id % 17 = 0 THEN NULL WHEN NOT mine THEN 'skipped ' || job_id || ' — companyCode=OTHER' WHEN NOT there THEN 'detail failed for ' || job_id
        WHEN job_id % 7 = 0 THEN 'skipped ' || job_id || ' — companyName=LG X' END AS w
        FROM (SELECT id, id * 10 + k AS job_id, id % 5 <> k AS mine, (id * 10 + k) % 9 > 0 AND id % 17 > 0 AS there FROM postings, (VALUES (0), (1)) v(k)) a) b GROUP BY id"""))

    def posting_pages(s, d):
        i = col("id")
        page = joined("<html><head><title>", col("company"), F.when(i % 2 == 0, " | 채용공고").otherwise(" | Jobs"), "</title><script>var x = '계약직 2009년 1월 1일';</script></head><body><img src='a.png' alt='로고'>",
                      F.when(i % 3 > 0, joined("<img class=\"i\" alt=\"", F.when(i % 3 == 1, col("company")).otherwise(""), " 기업 아이콘\">")).otherwise(""), F.when(i % 4 == 0, "<h1> </h1>").when(i % 4 == 1, "").otherwise(joined("<h1 class='t'>H1 <b>", i, "</b></h1>")),
                      F.when(i % 5 > 0, joined("<h2>H2 ", i, "</h2>")).otherwise(""), "<p>인턴, ", F.when(i % 2 == 0, "계약직").otherwise("프리랜서"), " 2001년 8월 1일부터 2001년 ", F.when(i % 6 == 0, "13").otherwise("9"), "월 3일</p></body></html>")
        return postings(s, d).select("id", page.alias("html"))

    add("A14_posting_pages", lambda s, d: posting_pages(s, d).select("id", parsers.parse_posting(col("html")).alias("p")).filter("p IS NOT NULL").select("id", "p.*"), with_postings("""SELECT id, company, CASE WHEN id % 4 >= 2 THEN 'H1 ' || id ELSE 'H2 ' || id END AS title,
      CASE WHEN id % 2 = 0 THEN '계약직' ELSE '인턴' END AS employment, CASE WHEN id % 6 > 0 THEN DATE '2001-09-03' END AS deadline FROM postings WHERE id % 3 = 1 AND (id % 4 >= 2 OR id % 5 > 0)"""))
    add("A06_generic_pages", lambda s, d: posting_pages(s, d).select("id", parsers.parse_page(col("html")).alias("p")).select("id", "p.*"), with_postings("""SELECT id, CASE WHEN id % 4 >= 2 THEN 'H1 ' || id ELSE company END AS title,
      CASE WHEN id % 2 = 0 THEN '계약직' ELSE '인턴' END AS employment, CASE WHEN id % 6 > 0 THEN DATE '2001-09-03' END AS deadline FROM postings"""))

    def links(s, d):
        i = col("id")
        page = joined('<a href="/o/', i, '">1</a><a href="o/', i + 1, '">2</a><a href="https://g.example/o/', i, '">again</a><a href="https://other.example/o/9">far</a><a href="/o/apply/', i, '">no</a><a href="/about">about</a><a href="/o/', i + 2, '#x">3</a><a href="mailto:a@g.example/o/">m</a><a href="/o/', i + 3, '">4</a>')
        base = joined("https://g.example/jobs", F.when(i % 2 == 0, "").otherwise("/list?x=1"))
        return postings(s, d).select("id", F.array_join(parsers.page_links(page, "/o/", base, "/apply", 4), "|").alias("links"))

    add("A20_same_origin_links", links, with_postings("""SELECT id, 'https://g.example/o/' || id || '|https://g.example/' || CASE WHEN id % 2 = 0 THEN '' ELSE 'jobs/' END || 'o/' || (id + 1) || '|https://g.example/o/' || (id + 2) || '#x|https://g.example/o/' || (id + 3) AS links FROM postings"""))
