"""Registered queries of the validators and of delivery, over values with known faults made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import markdown
from postmill.operators import sinks, state, validation
from postmill.plans.recommend import provenance
from postmill.sources.fixtures import REF, analyses, postings, with_postings

#: Faults by id; Spark writes them into JSON, the oracle states the codes they must give.
ITEMS_SQL = """SELECT posting_id, posting_id + CASE WHEN posting_id % 23 = 0 THEN 1 ELSE 0 END AS got,
  CASE WHEN posting_id % 17 = 0 THEN 'BOTH' ELSE job_domain END AS domain, CASE WHEN posting_id % 19 = 0 THEN 'WIDE' ELSE coalesce(scope, 'UNKNOWN') END AS scope,
  role_groups, posting_id % 11 = 0 AS chef, CASE WHEN posting_id % 29 = 0 THEN 'HEADHUNT' ELSE coalesce(recruitment_type, 'UNKNOWN') END AS recruitment,
  CASE WHEN posting_id % 31 = 0 THEN 'MAYBE' ELSE requirement END AS need, posting_id % 13 = 0 AS text_accepts, accepts_new_grad,
  CASE WHEN posting_id % 14 = 1 THEN -1 ELSE min_years END AS low, CASE WHEN posting_id % 15 = 1 THEN -2 WHEN posting_id % 4 = 1 THEN 1 END AS high,
  n_tracks, t2_groups, t2_accepts, t2_min, t2_requirement FROM analyses"""


def register(add) -> None:
    col = F.col

    def items(s, d):
        over = sinks.spread(postings(s, d), "id")  # a small file is few splits, and items take long to write and check
        rows = s.sql(ITEMS_SQL.replace("FROM analyses", "FROM {analyses}"), analyses=analyses(s, d, over))
        groups = F.filter(F.split("role_groups", ","), lambda g: g != "")
        track = lambda domain, of, accepts, low, need: F.struct(
            domain.alias("jobDomain"), of.alias("roleGroups"), accepts.alias("acceptsNewGrad"), low.alias("minRequiredYears"), need.alias("experienceRequirementType"), F.lit("OPEN_HIRE").alias("recruitmentType"),
        )
        tracks = F.slice(
            F.array(
                track(col("domain"), groups, col("accepts_new_grad"), F.lit(0), F.lit("NONE")),
                track(F.lit("IT"), F.split("t2_groups", ","), col("t2_accepts"), col("t2_min"), col("t2_requirement")),
            ), 1, col("n_tracks"),
        )
        own = F.to_json(F.struct(
            col("got").alias("jobPostingId"), col("domain").alias("jobDomain"), col("scope").alias("postingScope"),
            F.when(col("chef"), F.concat(groups, F.array(F.lit("CHEF")))).otherwise(groups).alias("roleGroups"), col("recruitment").alias("recruitmentType"),
            col("need").alias("experienceRequirementType"), col("low").alias("minRequiredYears"), col("high").alias("maxRequiredYears"), tracks.alias("tracks"),
        ))
        accepts = F.when(col("text_accepts"), '"yes"').otherwise(F.coalesce(col("accepts_new_grad").cast("string"), F.lit("null")))
        json = F.concat(F.lit('{"acceptsNewGrad":'), accepts, F.lit(","), F.substr(own, F.lit(2)))
        return rows.select("posting_id", F.array_join(validation.item_codes(json, col("posting_id")), "|").alias("codes"))

    gs = "list_filter(string_split(role_groups, ','), lambda g: g <> '')"
    dev = f"len(list_filter({gs}, lambda g: g <> 'NON_DEV')) > 0"
    add("K14_item_codes", items, with_postings(f""", it AS ({ITEMS_SQL})
      SELECT posting_id, CASE WHEN got <> posting_id THEN 'ID_MISMATCH:got=' || got || ',expected=' || posting_id ELSE concat_ws('|',
        CASE WHEN domain = 'BOTH' THEN 'INVALID_JOB_DOMAIN:BOTH' END, CASE WHEN scope = 'WIDE' THEN 'INVALID_POSTING_SCOPE:WIDE' END, CASE WHEN chef THEN 'INVALID_ROLE_GROUPS:CHEF' END,
        CASE WHEN domain = 'NON_IT' AND {dev} THEN 'CONTRADICTION_NONIT_WITH_DEV_ROLES:' || role_groups END, CASE WHEN recruitment = 'HEADHUNT' THEN 'INVALID_RECRUITMENT_TYPE:HEADHUNT' END,
        CASE WHEN need = 'MAYBE' THEN 'INVALID_EXP_REQ_TYPE:MAYBE' END, CASE WHEN text_accepts THEN 'INVALID_ACCEPTS_NEW_GRAD_TYPE:string' END, CASE WHEN low < 0 THEN 'INVALID_MIN_YEARS:' || low END,
        CASE WHEN high < 0 THEN 'INVALID_MAX_YEARS:' || high END, CASE WHEN low >= 0 AND high >= 0 AND high < low THEN 'YEAR_RANGE_INVALID:' || low || '-' || high END,
        CASE WHEN n_tracks > 0 AND domain = 'BOTH' THEN 'TRACK_INVALID_JOB_DOMAIN:BOTH' END, CASE WHEN n_tracks > 0 AND domain = 'NON_IT' AND {dev} THEN 'TRACK_CONTRADICTION_NONIT_DEV_ROLES:' || role_groups END,
        CASE WHEN scope IN ('MULTI_ROLE', 'OPEN_RECRUITMENT') AND n_tracks = 0 THEN 'TRACKS_EMPTY_FOR_SCOPE:' || scope END,
        CASE WHEN domain = 'NON_IT' AND n_tracks > 1 AND t2_groups <> 'NON_DEV' THEN 'CONTRADICTION_ROOT_NONIT_TRACK_IT_DEV' END) END AS codes FROM it"""))

    body = "\n".join(f"## {x}" for x in validation.SECTIONS)

    def drafts(s, d):
        k = col("id") % 11
        content = (
            F.when(k == 0, F.lit(" \n")).when(k == 1, F.lit(body.replace("오늘의 키워드", "키워드"))).when(k == 2, F.lit(f"{body} 합격 보장 그리고 매도"))
            .when(k == 3, F.concat(F.lit(f"{body} [a](https://evil.example/"), col("id").cast("string"), F.lit(")"))).when(k == 4, F.lit(body + "가" * 15_000))
            .otherwise(F.concat(F.lit(f"{body} [b]("), F.regexp_replace("url", r"[\s)]", ""), F.lit(")")))
        )
        ids = F.array(col("id").cast("string"), (col("id") + 1).cast("string"))
        said = F.when(k == 5, F.reverse(ids)).when(k == 6, F.concat(ids, F.array(F.lit("x")))).otherwise(ids)
        keywords = F.when(k == 7, F.array(F.lit("java"), F.lit("z"), F.lit("Cobol"))).otherwise(F.array(F.lit("JAVA")))
        found = validation.report_codes(content, F.when(k == 8, " ").otherwise("s"), said, ids, F.array(F.regexp_replace("url", r"[\s)]", "")), keywords, F.array(F.lit("Java")))
        rows = postings(s, d).withColumn("url", F.regexp_replace("url", "^HTTPS", "https")).select("id", found.alias("found"))
        return rows.select("id", F.array_join("found", "|").alias("codes"), validation.report_status(col("found")).alias("status"))

    add("K16_report_codes", drafts, with_postings(f"""SELECT id, CASE id % 11 WHEN 0 THEN 'EMPTY_CONTENT' WHEN 1 THEN 'MISSING_SECTION:오늘의 키워드' WHEN 2 THEN 'HALLUCINATION:합격 보장|INVESTMENT_ADVICE:매도'
      WHEN 3 THEN 'UNKNOWN_URL:https://evil.example/' || id WHEN 4 THEN 'CONTENT_TOO_LONG:{len(body) + 15_000}' WHEN 5 THEN 'ID_ORDER_MISMATCH' WHEN 6 THEN 'ID_SET_MISMATCH|UNKNOWN_POSTING_ID:x' WHEN 7 THEN 'KEYWORD_OUT_OF_SCOPE:Cobol'
      WHEN 8 THEN 'EMPTY_SUMMARY' ELSE '' END AS codes, CASE WHEN id % 11 IN (0, 2) THEN 'fallback_required' WHEN id % 11 > 8 THEN 'pass' ELSE 'retryable' END AS status FROM postings"""))

    source = lambda: F.concat(F.lit("# T "), col("id").cast("string"), F.lit("\n\n## a & b\n- **x** <y>\n- [z](https://e.example/"), col("id").cast("string"), F.lit(")\n\n---\n\n1. one\n2. two\n\nplain\nlines"))
    expected = """'<h1>T ' || id || '</h1>' || chr(10) || '<h2>a &amp; b</h2>' || chr(10) || '<ul>' || chr(10) || '<li><strong>x</strong> &lt;y&gt;</li>' || chr(10) || '<li><a href="https://e.example/' || id || '">z</a></li>' || chr(10) || '</ul>' || chr(10)
      || '<hr />' || chr(10) || '<ol>' || chr(10) || '<li>one</li>' || chr(10) || '<li>two</li>' || chr(10) || '</ol>' || chr(10) || '<p>plain' || chr(10) || 'lines</p>' || chr(10)"""
    add("H28_markdown", lambda s, d: postings(s, d).select("id", markdown.body(source()).alias("html")), with_postings(f"SELECT id, {expected} AS html FROM postings"))

    def delivered(s, d):
        path = sinks.scratch_path(s, "messages")
        per = postings(s, d).groupBy("company").agg(F.count("*").alias("n"))
        sinks.write_messages(per.select(F.concat("company", F.lit("@e.example")).alias("to"), F.lit("오늘").alias("subject"), F.md5("company").alias("message_id"), F.concat(F.lit("<p>\n"), col("n").cast("string"), F.lit("</p>")).alias("content")), path)
        return sinks.read_messages(s, path)

    add("B15_message_files", delivered, with_postings("SELECT company || '@e.example' AS to, '오늘' AS subject, md5(company) AS message_id, '<p>' || chr(10) || count(*) || '</p>' AS content FROM postings GROUP BY company"))

    def provenance_rows(s, d):
        p = provenance(s, d).withColumn("k", col("posting_id") % 5)
        at = lambda x: F.lit(x).cast("timestamp_ntz")
        day = lambda x: F.lit(x).cast("date")
        shifted = lambda n: F.when(col("k") == n, -col("posting_id")).otherwise(col("posting_id")).alias("posting_id")
        old = p.select(shifted(0), "source", F.md5("source").alias("content_hash"), at("2001-01-01 00:00:00").alias("first_seen"), at("2001-02-01 00:00:00").alias("last_seen"), day("2001-02-01").alias("last_collected"), "active")
        seen = p.select(F.when(col("k") == 1, col("posting_id") + 1_000_000_000_000).otherwise(col("posting_id")).alias("posting_id"), "source", F.when(col("k") > 2, F.lit("new")).alias("content_hash"))
        return state.touch_sources(old, seen, ["posting_id", "source"], at(f"{REF} 00:00:00"), day(REF))

    add("B07_provenance_rows", provenance_rows, f"""WITH p AS (SELECT DISTINCT l_partkey AS id, s_name AS source, s_acctbal >= 0 AS active, l_partkey % 5 AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
      o AS (SELECT CASE WHEN k = 0 THEN -id ELSE id END AS posting_id, source, md5(source) AS content_hash, TIMESTAMP '2001-01-01' AS first_seen, TIMESTAMP '2001-02-01' AS last_seen, DATE '2001-02-01' AS last_collected, active FROM p),
      n AS (SELECT CASE WHEN k = 1 THEN id + 1000000000000 ELSE id END AS posting_id, source, CASE WHEN k > 2 THEN 'new' END AS new_hash, true AS seen FROM p)
      SELECT posting_id, source, coalesce(new_hash, content_hash) AS content_hash, coalesce(first_seen, TIMESTAMP '{REF}') AS first_seen, CASE WHEN seen THEN TIMESTAMP '{REF}' ELSE last_seen END AS last_seen,
        CASE WHEN seen THEN DATE '{REF}' ELSE last_collected END AS last_collected, coalesce(active, true) AS active FROM o FULL JOIN n USING (posting_id, source)""")
