"""Registered queries of the source parsers, over markup made from the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.sources import boards, parsers
from postmill.sources.fixtures import postings, with_postings


def register(add) -> None:
    col = F.col
    def sitemap(s, d):
        p = postings(s, d).select("id", F.concat(F.lit('<urlset xmlns="http://x"><url><loc>https://a.example/'), col("id").cast("string"), F.lit("</loc>"),
            F.when(col("published").isNotNull(), F.concat(F.lit("<lastmod>"), col("published").cast("string"), F.lit("T00:00:00Z</lastmod>"))).otherwise(F.lit("")), F.lit("</url></urlset>")).alias("xml"))
        return parsers.parse_sitemap(p, "xml", F.lit("2001-07-20").cast("date"))

    add("A02_A03_A13_sitemap", sitemap, with_postings("SELECT 'https://a.example/' || CAST(id AS VARCHAR) AS loc, coalesce(published, DATE '0001-01-01') AS lastmod FROM postings WHERE published IS NULL OR published >= DATE '2001-07-20'"))

    def feed(s, d):
        item = lambda n: F.concat(F.lit("<item><title>"), F.when(col("id") % 3 == n, "").otherwise(col("company")), F.lit("</title><link>https://f.example/"), col("id").cast("string"), F.lit(f"/{n}</link><pubDate>Wed, 1 Aug 2001 10:00:00 +0000</pubDate></item>"))
        p = postings(s, d).select("id", F.concat(F.lit('<rss version="2.0"><channel>'), item(0), item(1), F.lit("</channel></rss>")).alias("xml"))
        return parsers.parse_feed(p, "xml").select("id", "title", "link", col("posted").cast("date").alias("day"))

    add("A04_A05_feed", feed, with_postings("SELECT id, company AS title, 'https://f.example/' || CAST(id AS VARCHAR) || '/' || CAST(n AS VARCHAR) AS link, DATE '2001-08-01' AS day FROM postings, (VALUES (0), (1)) v(n) WHERE id % 3 <> n"))
    add("A06_A14_H25_page", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", parsers.parse_page(col("html")).alias("p")).select("page_id", F.length("p.title").alias("title_chars"), "p.employment", "p.deadline"),
        r"""SELECT page_id, length(CASE WHEN h1 <> '' AND length(h1) < 200 THEN h1 ELSE nullif(t, '') END) AS title_chars, CAST(NULL AS VARCHAR) AS employment, CAST(NULL AS DATE) AS deadline FROM (SELECT page_id,
        trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS h1,
        trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS t FROM pages) q""")

    def keys(s, d):
        config = F.when(col("id") % 5 == 0, F.lit(None).cast("string")).when(col("id") % 5 == 1, "{bad").when(col("id") % 5 == 2, '{"max_fetch":7}').when(col("id") % 5 == 3, '{"parser_key":"  "}').otherwise('{"parser_key":" abc ","max_fetch":"x"}')
        return postings(s, d).select("id", parsers.parser_key(config).alias("k"), parsers.config_number(F.when(col("id") % 5 != 1, config), "max_fetch", 20).alias("max_fetch")).select("id", "k.key", "k.error", "max_fetch")

    add("A08_A09_config", keys, with_postings("SELECT id, CASE id % 5 WHEN 4 THEN 'ABC' END AS key, CASE id % 5 WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'missing_key' WHEN 3 THEN 'empty_key' END AS error, CASE id % 5 WHEN 2 THEN 7 ELSE 20 END AS max_fetch FROM postings"))
    add("A11_A20_links", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.array_join(parsers.page_links(col("html"), "^/[a-z]"), "|").alias("links")), None)

    def board(s, d):
        job = F.concat(F.lit('{"jobs":[{"id":'), col("id").cast("string"), F.lit(',"title":"'), F.when(col("id") % 4 == 0, " ").otherwise(col("company")), F.lit('","absolute_url":"https://b.example/'), col("id").cast("string"),
                       F.lit('","metadata":[{"name":"Corporate","value":"C'), (col("id") % 9).cast("string"), F.lit('"},{"name":"Valid Through","value":"2001-09-01T00:00:00Z"}]}]}'))
        return parsers.parse_board(postings(s, d).select(job.alias("json")), "json")

    add("A17_A19_A32_board", board, with_postings("SELECT id, company AS title, 'https://b.example/' || CAST(id AS VARCHAR) AS url, 'C' || CAST(id % 9 AS VARCHAR) AS company, DATE '2001-09-01' AS deadline FROM postings WHERE id % 4 <> 0").replace("company AS title,", "company AS title,"))
    add("A24_A26_A28_guards", lambda s, d: postings(s, d).filter((col("company") == "Brand#12") & ~F.coalesce(col("source") == "Saramin", F.lit(False))).select("id", "company"), with_postings("SELECT id, company FROM postings WHERE company = 'Brand#12' AND source <> 'Saramin'"))
    add("A33_preflight", lambda s, d: parsers.preflight(postings(s, d), ["title", "url"], F.when(col("id") % 3 == 0, "SITEMAP").when(col("id") % 3 == 1, "RSS").otherwise("FAX")), "SELECT * FROM (VALUES ('SITEMAP', NULL), ('RSS', NULL), ('FAX', 'UNSUPPORTED_ADAPTER')) v(adapter, code)")

    def probed(s, d):
        k = col("id") % 14
        text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
        urls = F.array_join(F.transform(F.sequence(F.lit(1), (col("id") % 9 + 1).cast("int")), lambda i: text("<url><loc>https://a.example/", i, "</loc></url>")), "")
        items = F.array_join(F.transform(F.sequence(F.lit(1), (col("id") % 7 + 1).cast("int")), lambda i: text("<item><title>t</title><link>https://a.example/", i, "</link></item>")), "")
        p = postings(s, d).select(
            "id", F.when(k == 0, "FAX").when(k.between(1, 4), " sitemap ").when(k.between(5, 7), "rss").otherwise("CUSTOM").alias("adapter"),
            F.when(k != 1, "https://a.example/list").alias("source_url"),
            F.when(k == 8, "{bad").when(k == 9, '{"parser_key":" "}').when(k == 10, '{"parser_key":"nobody"}').when(k == 11, '{"parser_key":"sk_careers"}').otherwise('{"parser_key":"greenhouse"}').alias("config"),
            F.when(k == 2, "TIMEOUT").when((k == 12) & (col("id") % 4 == 0), "SHELL").when((k == 12) & (col("id") % 4 == 2), "404").otherwise("OK").alias("fetched"),
            F.when(k == 3, "<urlset><url>").when(k == 4, text("<urlset>", urls, "</urlset>")).when(k == 5, "<rss><channel></channel></rss>").when(k == 6, "<rss><channel><item><title></title></item></channel></rss>")
            .when(k == 7, text("<rss><channel>", items, "</channel></rss>")).when(col("id") % 4 == 1, '{"jobs":[]}').when(col("id") % 4 == 3, '{"jobs":[{"title":" "}]}').otherwise('{"jobs":[{"title":"a","absolute_url":"u"}]}').alias("body"),
            F.when(col("id") % 5 == 0, "<html><body></body></html>").otherwise("<html><h1>Backend</h1></html>").alias("sample"),
        )
        return parsers.probe(p).select("id", "code", "discovered", "sampled")

    add("A33_probe_codes", probed, with_postings("""SELECT id, code, CASE WHEN code IS NOT NULL THEN 0 WHEN id % 14 = 4 THEN least(id % 9 + 1, 5) WHEN id % 14 = 7 THEN least(id % 7 + 1, 5) ELSE 1 END AS discovered, CASE WHEN code IS NULL THEN 1 ELSE 0 END AS sampled
      FROM (SELECT id, CASE id % 14 WHEN 0 THEN 'UNSUPPORTED_ADAPTER' WHEN 1 THEN 'INVALID_CONFIG' WHEN 2 THEN 'TIMEOUT' WHEN 3 THEN 'REQUIRED_FIELD_PARSE_FAILED' WHEN 4 THEN CASE WHEN id % 5 = 0 THEN 'REQUIRED_FIELD_PARSE_FAILED' END
        WHEN 5 THEN 'NO_ITEMS_DISCOVERED' WHEN 6 THEN 'NO_ITEMS_DISCOVERED' WHEN 7 THEN NULL WHEN 8 THEN 'INVALID_CONFIG' WHEN 9 THEN 'MISSING_PARSER_KEY' WHEN 10 THEN 'UNKNOWN_PARSER' WHEN 11 THEN 'UNSUPPORTED_ADAPTER'
        ELSE CASE WHEN id % 14 = 12 AND id % 4 = 0 THEN 'CLOUDFLARE_SHELL' WHEN id % 14 = 12 AND id % 4 = 2 THEN 'URL_UNREACHABLE' WHEN id % 4 = 1 THEN 'NO_ITEMS_DISCOVERED' WHEN id % 4 = 3 THEN 'REQUIRED_FIELD_PARSE_FAILED' END END AS code FROM postings) q"""))

    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    def opening_rows(s, d):
        k = col("id")
        job = F.when(k % 3 == 0, "").otherwise(col("company"))
        level = F.when(k % 4 == 0, "EXPERIENCED").when(k % 4 == 1, "NEW_COMER").otherwise("NOT_MATTER")
        position = F.to_json(F.struct(
            F.struct(job.alias("job")).alias("workspaceJob"), F.struct(F.lit("Occ").alias("occupation")).alias("workspaceOccupation"), F.struct(col("location")).alias("workspacePlace"),
            F.struct(level.alias("careerType"), F.when(k % 8 == 0, (k % 5).cast("int")).alias("careerFrom")).alias("jobPositionCareer"),
            F.struct(F.when(k % 2 == 0, "INTERN").otherwise("GIG").alias("employmentType")).alias("jobPositionEmployment"),
        ))
        opening = lambda n: text('{"openingId":', k * 2 + n, ',"title":"  A  ', k, '","dueDate":"', F.coalesce("deadline", F.lit("2001-01-01").cast("date")), 'T10:00:00Z","openingJobPosition":{"openingJobPositions":[', position, "]}}")
        page = text('<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"dehydratedState":{"queries":[{"queryKey":["user"],"state":{"data":[]}},{"queryKey":["openings",1],"state":{"data":[', opening(0), ",", opening(1), "]}}]}}}}</script></html>")
        return boards.openings(postings(s, d).select("id", page.alias("html")), "html")

    add("A21_A22_openings", opening_rows, with_postings("""SELECT id, id * 2 + n AS opening_id, 'A ' || id AS title, CASE WHEN id % 3 = 0 THEN 'Occ' ELSE company END AS role, location,
      CASE WHEN id % 8 = 0 THEN (id % 5) || '년 이상' WHEN id % 4 = 0 THEN '경력' WHEN id % 4 = 1 THEN '신입' ELSE '경력 무관' END AS level, CASE WHEN id % 2 = 0 THEN '인턴' ELSE 'GIG' END AS employment,
      coalesce(deadline, DATE '2001-01-01') AS deadline FROM postings, (VALUES (0), (1)) v(n)"""))

    def recruits(s, d):
        k = col("id")
        item = lambda n: text('{"title":"', col("company"), " ", k, '","status":"', F.when(k % 5 == n, "closed").otherwise("in_progress"), '","isPrivate":', (k % 7 == n).cast("string"), ',"applyUrl":"https://x.example/job_posting/K', F.floor(k / 2), '/","types":["gig","', F.when(k % 2 == 0, "intern").otherwise("full_time"), '"],"deadline":"2001-09-0', n + 1, '"}')
        page = F.concat(F.lit('<script>var a = 1;</script><script>{"props":{"pageProps":{"recruits":['), item(F.lit(0)), F.lit(","), item(F.lit(1)), F.lit("]}}}</script>"))
        return boards.inline_recruits(postings(s, d).select("id", page.alias("html")), "html", "id")

    add("A30_inline_recruits", recruits, with_postings("""SELECT 'K' || (id // 2) AS key, company || ' ' || id AS title, CASE WHEN id % 2 = 0 THEN '인턴' ELSE '정규직' END AS employment, DATE '2001-09-01' + CAST(n AS INT) AS deadline
      FROM (SELECT *, row_number() OVER (PARTITION BY id // 2 ORDER BY id, n) AS r FROM postings, (VALUES (0), (1)) v(n) WHERE id % 5 <> n AND id % 7 <> n) q WHERE r = 1"""))
    add("A31_job_ids", lambda s, d: boards.job_ids(postings(s, d).select(text("https://t.example/job?x=1&job_id=", F.floor(col("id") / 3), F.when(col("id") % 2 == 0, "&y").otherwise("#z")).alias("u")), "u"), with_postings("SELECT DISTINCT id // 3 AS job_id FROM postings"))

    def pages(s, d):
        p = postings(s, d).withColumn("page", F.ceil((F.row_number().over(Window.partitionBy("company").orderBy("id"))) / 10).cast("int"))
        listed = p.groupBy(col("company").alias("listing"), "page").agg(F.array_sort(F.collect_list("id")).alias("items"))
        return boards.paged(listed.withColumn("total", F.when(F.ascii(F.substring("listing", 8, 1)) % 2 == 0, 25).otherwise(1_000_000)), 10)

    add("A12_A16_A23_paged_lists", pages, with_postings("""SELECT company AS listing, page, pos, id AS item FROM (SELECT company, id, CAST((r - 1) // 10 + 1 AS INT) AS page, CAST((r - 1) % 10 AS INT) AS pos
      FROM (SELECT company, id, row_number() OVER (PARTITION BY company ORDER BY id) AS r FROM postings) a) b WHERE ascii(substr(company, 8, 1)) % 2 = 1 OR page = 1 OR (page - 1) * 10 < 25"""))
    add("A26_A28_guarded_ids", lambda s, d: boards.guarded(postings(s, d).withColumn("k", F.floor(col("id") / 2)), "k", "id", col("company"), F.lit("Brand#12")).select("k", "id"),
        with_postings("SELECT id // 2 AS k, min(id) AS id FROM postings WHERE company = 'Brand#12' GROUP BY 1"))
