"""Registered identity merge, analysis actions, name and keyword joins, typed XML sources and per-user query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text
from postmill.operators import identity, joins
from postmill.plans.collect import RAW_SQL, raw_records
from postmill.plans.functions_queries import _company, _sp, _url, csv
from postmill.sources import parsers
from postmill.sources.fixtures import ANALYSES_SQL, POSTINGS_SQL, analyses, postings, users, with_postings

REPLACE, ENRICH = ["deadline", "description", "content_hash"], ["skills_json", "roles_json", "location", "experience_level"]


def _keys(df: DataFrame) -> DataFrame:
    """Postings with what they are found by. The batch's addresses are distinct per size, so that chains over both kinds of keys occur."""
    company, title = text.normalize_company(F.col("company")), text.normalize_title(F.col("title"))
    return df.select(
        "id", "seq", "url", "deadline", "description", *ENRICH,
        text.source_record_key(F.col("source"), F.when(F.col("id") % 4 > 0, F.col("id").cast("string")), F.col("url")).alias("record_key"),
        text.canonical_fingerprint(company, title, F.lit(None).cast("date")).alias("fingerprint"),
        F.md5(F.coalesce("description", F.lit(""))).alias("content_hash"),
    )


def merge_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(batch, known postings, known sources): both reports of all postings against a pool of each fifth posting."""
    rows = _keys(raw_records(spark, d))
    batch = rows.withColumn("url", F.when(F.col("id") % 11 > 0, F.col("url"))).withColumn("stored", F.col("fingerprint"))
    pool = _keys(postings(spark, d).filter("id % 5 = 0")).withColumn("location", F.when(F.col("id") % 2 == 0, F.col("location")))
    known = pool.select("record_key", F.col("id").alias("posting_id"), F.when(F.col("id") % 3 > 0, F.col("content_hash")).otherwise("stale").alias("content_hash"))
    known = known.groupBy("record_key").agg(F.min("posting_id").alias("posting_id"), F.max("content_hash").alias("content_hash"))
    return batch, pool, known


def resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    batch, pool, known = merge_inputs(spark, d)
    return identity.changed_hashes(identity.resolve(batch, pool, known), known), pool


#: The loop over the batch as a recursion over the rows that may create a posting, one by one.
_MERGE_SQL = f"""WITH RECURSIVE postings AS ({POSTINGS_SQL}), {RAW_SQL},
  keyed AS (SELECT *, sha256(source || '|' || CASE WHEN id % 4 > 0 THEN CAST(id AS VARCHAR) ELSE {_url('url')} END) AS record_key,
      sha256({_company('company')} || '|' || lower({_sp('title')}) || '|') AS fingerprint, md5(coalesce(description, '')) AS content_hash FROM raw),
  batch AS (SELECT * REPLACE (CASE WHEN id % 11 > 0 THEN url END AS url) FROM keyed),
  pool AS (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN location END AS location) FROM keyed WHERE seq < 1000000000 AND id % 5 = 0),
  known AS (SELECT record_key, min(id) AS posting_id, max(CASE WHEN id % 3 > 0 THEN content_hash ELSE 'stale' END) AS known_hash FROM pool GROUP BY 1),
  rows AS (SELECT b.*, k.posting_id AS by_key, k.known_hash, min(seq) OVER (PARTITION BY b.record_key) AS head FROM batch b LEFT JOIN known k USING (record_key)),
  heads AS (SELECT *, (SELECT min(id) FROM pool p WHERE p.fingerprint = r.fingerprint) AS old_fp, (SELECT min(id) FROM pool p WHERE p.url = r.url) AS old_url
    FROM rows r WHERE by_key IS NULL AND seq = head),
  cand AS (SELECT seq, fingerprint, url, row_number() OVER (ORDER BY seq) AS i FROM heads WHERE old_fp IS NULL AND old_url IS NULL),
  before AS MATERIALIZED (SELECT a.i, list(b.i) AS bs FROM cand a JOIN cand b ON b.i < a.i AND (b.fingerprint = a.fingerprint OR b.url = a.url) GROUP BY a.i),
  step AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS made
    UNION ALL SELECT s.i + 1, CASE WHEN list_has_any(s.made, coalesce(b.bs, [])) THEN s.made ELSE list_append(s.made, s.i + 1) END
    FROM step s LEFT JOIN before b ON b.i = s.i + 1 WHERE s.i < (SELECT count(*) FROM cand)),
  made AS (SELECT c.* FROM (SELECT unnest(made) AS i FROM (SELECT made FROM step ORDER BY i DESC LIMIT 1)) m JOIN cand c USING (i)),
  placed AS (SELECT *, (SELECT min(seq) FROM made m WHERE m.fingerprint = h.fingerprint AND m.seq < h.seq) AS new_fp, (SELECT min(seq) FROM made m WHERE m.url = h.url AND m.seq < h.seq) AS new_url FROM heads h),
  told AS (SELECT head, CASE WHEN old_fp IS NOT NULL OR new_fp IS NOT NULL THEN old_fp ELSE old_url END AS posting_id,
      CASE WHEN old_fp IS NOT NULL THEN NULL WHEN new_fp IS NOT NULL THEN new_fp WHEN old_url IS NOT NULL THEN NULL WHEN new_url IS NOT NULL THEN new_url ELSE seq END AS creator,
      CASE WHEN old_fp IS NOT NULL OR new_fp IS NOT NULL THEN 'FINGERPRINT' WHEN old_url IS NOT NULL OR new_url IS NOT NULL THEN 'URL' ELSE 'NEW' END AS via FROM placed),
  res AS (SELECT r.*, coalesce(by_key, t.posting_id) AS posting_id, CASE WHEN by_key IS NULL THEN t.creator END AS creator,
      CASE WHEN by_key IS NOT NULL OR r.head <> r.seq THEN 'KEY' ELSE t.via END AS via,
      coalesce(lag(content_hash) OVER (PARTITION BY record_key ORDER BY seq), known_hash) AS prior FROM rows r LEFT JOIN told t ON t.head = r.head),
  decided AS (SELECT *, via = 'KEY' AND prior IS NOT NULL AND prior <> content_hash AS overwrites FROM res)"""


def _fold(c: str) -> str:
    blank = lambda x: f"coalesce(trim({x}), '') IN ('', '[]')"
    return f"""list_reduce(list({{'v': {c}, 'o': o}} ORDER BY seq), lambda a, x: CASE WHEN coalesce(trim(x.v), '') = '' THEN a WHEN x.o OR {blank('a.v')} THEN x ELSE a END).v AS {c}"""


def register(add) -> None:
    col = F.col
    add("B01_identity_merge", lambda s, d: resolved(s, d)[0].select("seq", "via", "posting_id", "creator", "overwrites"), _MERGE_SQL + " SELECT seq, via, posting_id, creator, overwrites FROM decided")

    def after(s, d):
        return identity.merge_postings(*resolved(s, d), REPLACE, ENRICH)

    add("B01_B02_B03_merged_postings", after, _MERGE_SQL + f""",
      steps AS (SELECT id AS posting_id, CAST(NULL AS BIGINT) AS creator, CAST(-1 AS BIGINT) AS seq, false AS o, 0 AS n, deadline, description, content_hash, {', '.join(ENRICH)} FROM pool
        UNION ALL SELECT posting_id, creator, seq, overwrites, 1, deadline, description, content_hash, {', '.join(ENRICH)} FROM decided)
      SELECT posting_id, creator, sum(n) AS n_rows, arg_max(deadline, seq) FILTER (WHERE deadline IS NOT NULL) AS deadline, arg_max(description, seq) FILTER (WHERE coalesce(trim(description), '') <> '') AS description,
        arg_max(content_hash, seq) AS content_hash, {', '.join(map(_fold, ENRICH))} FROM steps GROUP BY posting_id, creator""")  # fmt: skip

    def actions(s, d):
        p = postings(s, d).select("id", text.analysis_input_hash(col("title"), col("description"), F.from_json("roles_json", "array<string>"), col("experience_level"), col("employment_type"), F.lit(False)).alias("input_hash"))
        known = analyses(s, d).join(p, col("posting_id") == col("id")).select("posting_id", F.when(col("id") % 5 == 0, F.reverse("input_hash")).otherwise(col("input_hash")).alias("input_hash"), F.when(col("id") % 7 == 0, "0.9.0").otherwise("1.0.0").alias("version"))
        return identity.analysis_actions(p, known, "1.0.0")

    add("B04_analysis_actions", actions, with_postings("SELECT p.id, CASE WHEN a.posting_id IS NULL THEN 'INSERT_PENDING' WHEN p.id % 5 = 0 OR p.id % 7 = 0 THEN 'RESET_PENDING' ELSE 'TOUCH' END AS action FROM postings p LEFT JOIN analyses a ON a.posting_id = p.id"))

    def companies(s, d):
        wanted = users(s, d).select("user_id", F.explode(csv(col("companies"))).alias("wanted"))
        pairs = joins.prefix_pairs(postings(s, d), wanted, "company", "wanted")
        rows = postings(s, d).groupBy(F.lower("company").alias("left")).agg(F.count("*").alias("n"))
        return wanted.withColumn("right", F.lower("wanted")).join(pairs, "right").join(rows, "left").select("user_id", "wanted", col("left").alias("company"), "n")

    add("D12_company_preferences", companies, with_postings("""SELECT user_id, wanted, lower(company) AS company, count(*) AS n
      FROM (SELECT user_id, trim(w) AS wanted FROM (SELECT user_id, unnest(string_split(companies, ',')) AS w FROM users) q WHERE trim(w) <> '') u
      JOIN postings ON starts_with(lower(company), lower(wanted)) OR starts_with(lower(wanted), lower(company)) GROUP BY ALL"""))

    def mentions(s, d):
        skills = users(s, d).select(F.explode(csv(col("skills"))).alias("keyword"))
        words = skills.unionByName(s.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.split("text", r"[ .,\n]+")).alias("keyword")).filter("length(keyword) BETWEEN 9 AND 11"))
        docs = s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("d"), col("doc_id").cast("string")).alias("id"), "text")
        posts = postings(s, d).select(F.concat(F.lit("p"), col("id").cast("string")).alias("id"), F.concat_ws(" ", "title", "skills_json", "description").alias("text"))
        return joins.containing(docs.unionByName(posts), words, "id", "text").groupBy("keyword").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))

    add("D13_mentions", mentions, with_postings(r"""SELECT keyword, count(*) AS n, min(id) AS first, max(id) AS last FROM (
        SELECT DISTINCT lower(trim(k)) AS keyword FROM (SELECT unnest(string_split(skills, ',')) AS k FROM users
          UNION ALL SELECT k FROM (SELECT unnest(string_split_regex(text, '[ .,\n]+')) AS k FROM benchmark) q WHERE length(k) BETWEEN 9 AND 11) w WHERE trim(k) <> '') ks
      JOIN (SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, lower(text) AS t FROM documents UNION ALL SELECT 'p' || CAST(id AS VARCHAR), lower(concat_ws(' ', title, skills_json, description)) FROM postings) x
      ON contains(t, keyword) GROUP BY 1"""))

    joined = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    def sitemaps(s, d):
        loc = F.when(col("id") % 3 == 0, joined("<![CDATA[https://a.example/x?p=", col("id"), "&q=<1>]]>")).otherwise(joined(" https://a.example/x?p=", F.floor(col("id") / 2), "&amp;q=&lt;1&gt;\n"))
        url = joined("<url><loc>", loc, "</loc>", F.when(col("published").isNotNull(), joined("<lastmod>", col("published"), "T00:00:00Z</lastmod>")).otherwise(""), '<image:image xmlns:image="http://i"><image:loc>no</image:loc></image:image></url>')
        broken = F.when(col("id") % 13 == 0, "").otherwise("</urlset>")
        maps = postings(s, d).select("company", joined('<?xml version="1.0" encoding="UTF-8"?>\n<!-- map --><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', url, "<url><loc> </loc></url>", broken).alias("xml"))
        return parsers.parse_sitemap(maps, "xml", F.lit("2001-07-10").cast("date"), parsers.FETCHED, keys=("company",))

    add("A02_A03_A13_sitemaps_per_source", sitemaps, with_postings("""SELECT company, loc, lastmod, row_number() OVER (PARTITION BY company ORDER BY lastmod DESC, loc) AS pos FROM (
        SELECT company, loc, max(coalesce(published, DATE '0001-01-01')) AS lastmod FROM (
          SELECT company, published, 'https://a.example/x?p=' || CASE WHEN id % 3 = 0 THEN id ELSE id // 2 END || '&q=<1>' AS loc FROM postings WHERE id % 13 > 0 AND (published IS NULL OR published >= DATE '2001-07-10')) a
        GROUP BY 1, 2) b QUALIFY pos <= 20"""))

    def feeds(s, d):
        i = col("id")
        rss = lambda n: joined('<item rdf:about="', i, '"><title>', F.when(i % 3 == n, " ").otherwise(joined(col("company"), " R&amp;D")), "</title><link>https://f.example/?i=", i, f"&amp;n={n}</link><description><![CDATA[<b>", i, "</b>]]></description><pubDate>Wed, 1 Aug 2001 10:00:00 +0000</pubDate></item>")
        atom = lambda n: joined("<entry><title type='html'>", col("company"), " &lt;", i, f"&gt;</title><link rel='alternate' href='https://f.example/?i=", i, f"&amp;n={n}'/><updated>2001-08-02T10:00:00Z</updated><summary>s", i, "</summary></entry>")
        kind = i % 4
        xml = (
            F.when(kind == 0, joined('<rss version="2.0" xmlns:rdf="http://r"><channel><title>c</title>', rss(0), rss(1), rss(2), "</channel></rss>"))
            .when(kind == 1, joined('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>', atom(0), atom(1), atom(2), "</feed>"))
            .when(kind == 2, joined('<rdf:RDF xmlns:rdf="http://r" xmlns="http://purl.org/rss/1.0/"><channel rdf:about="x"/>', rss(0), rss(1), rss(2), "</rdf:RDF>"))
            .otherwise(joined("<rss><channel>", rss(0)))
        )
        return parsers.parse_feed(postings(s, d).select("id", xml.alias("xml")), "xml", 2).select("id", "pos", "title", "link", "description", col("posted").cast("date").alias("day"))

    add("A04_A05_feeds_and_atom", feeds, with_postings("""SELECT id, n AS pos, CASE WHEN id % 4 = 1 THEN company || ' <' || id || '>' ELSE company || ' R&D' END AS title, 'https://f.example/?i=' || id || '&n=' || n AS link,
        CASE WHEN id % 4 = 1 THEN 's' || id ELSE '<b>' || id || '</b>' END AS description, CASE WHEN id % 4 = 1 THEN DATE '2001-08-02' ELSE DATE '2001-08-01' END AS day
      FROM postings, (VALUES (0), (1)) v(n) WHERE id % 4 < 3 AND (id % 4 = 1 OR id % 3 <> n)"""))

    def plans(s, d):
        u = users(s, d)
        planned = parsers.search_queries(csv(col("roles")), csv(col("companies")), csv(col("skills")), 5)
        return u.select("user_id", F.posexplode(planned).alias("pos", "query"))

    _list = lambda c: f"list_filter(list_transform(string_split({c}, ','), lambda x: trim(x)), lambda x: x <> '')"
    add("A15_user_queries", plans, with_postings(f"""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS pos, query FROM (
        SELECT user_id, arg_min(query, k) AS query, min(k) AS k FROM (
          SELECT user_id, qs[k] AS query, k, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(qs[k]), '\\s+'), lambda w: w <> ''))), ' ') AS words
          FROM (SELECT user_id, qs, unnest(range(1, len(qs) + 1)) AS k FROM (SELECT user_id, list_concat(r, c, flatten(list_transform(r[1:3], lambda x: list_transform(s[1:2], lambda y: x || ' ' || y)))) AS qs
            FROM (SELECT user_id, {_list('roles')} AS r, {_list('companies')} AS c, {_list('skills')} AS s FROM users) l) q) z) y WHERE words <> '' GROUP BY user_id, words) x QUALIFY pos < 5"""))
