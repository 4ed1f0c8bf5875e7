"""Registered winners' evidence, source dispatch, paged discovery, streams drained to tables, backfills and reads per user."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.functions import policy, text
from postmill.operators import dedup, evidence, reports, state
from postmill.operators.sinks import scratch_path
from postmill.plans.collect import HEAD, LISTS, RAW_SQL, SCALARS, normalize, raw_records
from postmill.plans.functions_queries import PRIMARY, _url, csv, user_profiles
from postmill.plans.recommend import _F, _POOL, _S, EXPOSED_SQL, PENALTY, SELECT_SQL, _csv, ref_date, top_per_user
from postmill.sources import adapters, boards
from postmill.sources.fixtures import REF, analyses, postings, users, with_postings
from postmill.streaming import leases
from postmill.streaming.incremental import IncrementalMerge

KINDS = ("roles", "companies", "skills", "industries", "locations", "experience_levels", "employment_types", "company_sizes")


def winner_evidence(spark, d):
    """K05, K20: evidence and reasons of the winners only, by joining them back with their postings and users."""
    col = F.col
    won = top_per_user(spark, d).select("user_id", "rank", "id")
    p = postings(spark, d).select(
        "id", "company", "title", "skills_json", "location", "employment_type", "experience_level", "company_size", "deadline", csv(F.coalesce("industry_codes", F.lit(""))).alias("industry_list"),
        text.primary_text(col("title"), col("roles_json")).alias("primary"), policy.role_groups(text.primary_text(col("title"), col("roles_json"))).alias("groups"),
        policy.parse_experience(col("experience_level"))["category"].alias("category"),
    )
    u = user_profiles(users(spark, d)).select("user_id", "acceptable", "level_list", "level_categories", *[csv(col(k)).alias(f"u_{k}") for k in KINDS])
    rows = won.join(p, "id").join(u, "user_id")
    prefs = {k: col(f"u_{k}") for k in KINDS}
    role = policy.role_verdict(col("acceptable"), col("groups"))
    exp = policy.experience_verdict(col("level_list"), col("level_categories"), col("category"))
    found = evidence.match_evidence(prefs, role, col("primary"), col("company"), col("skills_json"), exp, col("experience_level"), col("industry_list"), col("location"), col("employment_type"), col("company_size"))
    days = F.datediff("deadline", ref_date())
    skills = F.from_json("skills_json", "array<string>")
    rows = rows.withColumn("e", found)
    reason = evidence.why(col("e"), prefs, col("company"), col("title"), skills, col("location"), col("experience_level"), days.between(0, 7), days)
    return rows.select("user_id", "rank", "id", *[F.array_join(f"e.{k}", "|").alias(k) for k in KINDS], reason.alias("why"))


def _evidence_sql() -> str:
    firsts = lambda xs, hit: f"list_filter({xs}, lambda x: {hit})[1:1]"
    one = lambda cond, v: f"CASE WHEN {cond} THEN [{v}] ELSE CAST([] AS VARCHAR[]) END"
    ev = {
        "roles": "CASE WHEN rv = 'MATCH' THEN list_filter(rs, lambda x: contains(primary_text, lower(x))) ELSE CAST([] AS VARCHAR[]) END",
        "companies": one("len(list_filter(u_companies, lambda c: starts_with(lower(company), lower(c)) OR starts_with(lower(c), lower(company)))) > 0", "company"),
        "skills": "list_filter(u_skills, lambda x: contains(lower(coalesce(skills_json, '')), lower(x)))[1:5]",
        "industries": firsts("u_industries", "list_contains(list_transform(string_split(coalesce(industry_codes, ''), ','), lambda c: lower(trim(c))), lower(x))"),
        "locations": firsts("u_locations", "contains(coalesce(location, ''), x) OR contains(x, coalesce(location, ''))"),
        "experience_levels": one("score_exp = 'PASS_FULL' AND coalesce(trim(experience_level), '') <> ''", "experience_level"),
        "employment_types": one("len(list_filter(u_employment, lambda x: lower(x) = lower(coalesce(employment_type, '')))) > 0", "employment_type"),
        "company_sizes": one("len(list_filter(u_sizes, lambda x: lower(x) = lower(coalesce(company_size, '')))) > 0", "company_size"),
    }
    parts = [("e_companies[1:2]", "'관심 기업 ' || {}"), ("e_roles[1:2]", "{} || ' 역할 일치'"), ("e_skills[1:3]", "{} || ' 스킬 매칭'"), ("e_locations[1:2]", "{} || ' 근무'"), ("e_experience_levels[1:1]", "{} || ' 경력 조건 부합'"), ("e_employment_types[1:1]", "{}")]
    said = ", ".join(f"CASE WHEN len({x}) > 0 THEN " + y.format(f"array_to_string({x}, ', ')") + " END" for x, y in parts)
    low = "list_transform(coalesce(from_json(skills_json, '[\"VARCHAR\"]'), CAST([] AS VARCHAR[])), lambda s: lower(s))"
    back = [("list_filter(u_companies, lambda x: x = company)[1:1]", "'관심 기업 ' || {}"), ("list_filter(rs, lambda x: contains(lower(title), lower(x)))[1:1]", "{} || ' 역할 일치'"),
            (f"list_filter(u_skills, lambda x: list_contains({low}, lower(x)))[1:3]", "{} || ' 스킬 매칭'"), ("list_filter(u_locations, lambda x: contains(coalesce(location, ''), x))[1:1]", "{} || ' 근무'"),
            ("list_filter(ls, lambda x: x = experience_level)[1:1]", "{} || ' 경력 조건 부합'")]
    fell = ", ".join(f"CASE WHEN len({x}) > 0 THEN " + y.format(f"array_to_string({x}, ', ')") + " END" for x, y in back)
    lists = ", ".join(f"{v} AS e_{k}" for k, v in ev.items())
    return f""", {_POOL}, {_F.replace('{pool}', 'pool')}, {_S}, {EXPOSED_SQL},
      c AS (SELECT s.*, class_score - {PENALTY} AS adjusted FROM (SELECT s.*, date_diff('day', ex.last_exposed, DATE '{REF}') AS d FROM s LEFT JOIN ex USING (user_id, canonical) WHERE class_reason IS NULL) s),
      {SELECT_SQL},
      ev AS (SELECT k.user_id, k.rank, k.id, p.company, p.title, p.skills_json, p.location, p.experience_level, p.deadline, uu.rs, uu.ls, uu.u_companies, uu.u_skills, uu.u_locations, {lists} FROM (SELECT user_id, rank, id, rv, score_exp FROM picked) k JOIN (SELECT user_id, rs, ls, u_companies, u_skills, u_industries, u_locations, u_employment, u_sizes FROM uu) uu USING (user_id)
        JOIN (SELECT *, {PRIMARY} AS primary_text FROM postings) p USING (id)),
      told AS (SELECT *, list_filter([{said}], lambda x: x IS NOT NULL) AS r1, list_filter([{fell}], lambda x: x IS NOT NULL) AS r2, date_diff('day', DATE '{REF}', deadline) AS days FROM ev),
      whole AS (SELECT *, list_concat(CASE WHEN len(r1) > 0 THEN r1 ELSE r2 END, CASE WHEN days BETWEEN 0 AND 3 THEN ['마감 ' || days || '일 전 — 긴급'] WHEN days BETWEEN 1 AND 7 THEN ['마감 ' || days || '일 이내'] ELSE CAST([] AS VARCHAR[]) END) AS r FROM told)
      SELECT user_id, rank, id, {', '.join(f"array_to_string(e_{k}, '|') AS {k}" for k in KINDS)}, CASE WHEN len(r) > 0 THEN array_to_string(r, ' · ') WHEN trim(company || ' ' || title) <> '' THEN trim(company || ' ' || title) ELSE '{evidence.NO_REASON}' END AS why FROM whole"""


def register(add) -> None:
    col = F.col
    add("K05_K20_winner_evidence", winner_evidence, with_postings(_evidence_sql()))

    def searches(s, d):
        p = postings(s, d).withColumn("r", F.row_number().over(Window.partitionBy("company").orderBy("id")))
        # ten per page, two of them again from the page before; from page six on only what was there already
        fresh = p.select(col("company").alias("listing"), F.explode(F.array(F.floor((col("r") - 1) / 8) + 1, F.when(F.pmod(col("r") - 1, F.lit(8)) >= 6, F.floor((col("r") - 1) / 8) + 2))).alias("page"), "r", "id").withColumn("page", col("page").cast("int")).filter("page IS NOT NULL")
        known = fresh.withColumn("page", F.when(col("page") > 5, 6).otherwise(col("page"))).filter((col("page") < 6) | (col("r") <= 40))
        listed = known.groupBy("listing", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("items"))
        return boards.discovered(listed, 25).select("listing", "page", "item", "nth")

    add("A12_discovered_items", searches, with_postings("""SELECT company AS listing, CAST((r - 1) // 8 + 1 AS INT) AS page, id AS item, r AS nth FROM (SELECT company, id, row_number() OVER (PARTITION BY company ORDER BY id) AS r FROM postings) q WHERE r <= 25"""))

    joined = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    def search_pages(s, d):
        i = col("id")
        one = lambda n, kind: joined('{"id":', i * 3 + n, ',"recruit_type":', kind, "}")
        state_of = joined('{"data":{"data":[', one(0, F.lit(0)), ",", one(1, i % 2), ",", one(0, F.lit(1)), "]}}")
        data = joined('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"dehydratedState":{"queries":[{"queryKey":["user"],"state":{}},{"queryKey":["jobSearch",1],"state":', state_of, "}]}}}}</script>")
        links = joined('<a href="/recruit/', i, '">a</a><a href="https://j.example/intern/', i + 1, '?x">b</a><a href="/intern/', i, '">again</a><a href="/about/1">c</a>')
        page = F.when(i % 3 == 0, links).otherwise(F.concat(data, links))
        return postings(s, d).select("id", F.array_join(boards.search_ids(page), ",").alias("found"))

    add("A11_search_ids", search_pages, with_postings("SELECT id, CASE WHEN id % 3 = 0 THEN 'recruit/' || id || ',intern/' || (id + 1) ELSE 'recruit/' || (id * 3) || ',' || CASE WHEN id % 2 = 0 THEN 'recruit/' ELSE 'intern/' END || (id * 3 + 1) END AS found FROM postings"))

    def sources(s, d):
        pages = s.read.parquet(f"{d}/pages.parquet")
        k, safe = col("page_id") % 8, F.replace(F.replace(col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        entry = joined("<url><loc>", safe, "</loc><lastmod>2001-08-0", col("page_id") % 9 + 1, "</lastmod></url><url><loc>https://gone.example/", col("page_id"), "</loc></url>")
        item = joined('{"title":"', F.when(k == 3, "").otherwise("T"), '","absolute_url":"https://b.example/', col("page_id"), '"}')
        return pages.select(
            col("page_id").alias("source_id"), col("page_id").alias("company_id"), F.lit("c").alias("company"),
            F.when(k <= 1, "sitemap").when(k == 2, "rss").when(k == 7, "fax").otherwise("custom").alias("adapter"),
            F.when(k == 4, "{bad").when(k == 5, '{"parser_key":"nobody"}').otherwise('{"parser_key":"greenhouse"}').alias("config"),
            F.when(k == 0, joined("<urlset>", entry, "</urlset>")).when(k == 1, joined("<urlset>", entry)).when(k == 2, joined("<rss><channel><item><title>A &amp; B</title><link>https://f.example/?a=1&amp;b=", col("page_id"), "</link></item></channel></rss>"))
            .when(k == 6, F.lit(None)).otherwise(joined('{"jobs":[', item, "]}")).alias("body"),
        ), pages

    def dispatched(s, d):
        return adapters.dispatch(*sources(s, d), F.lit("2001-08-03").cast("date"))

    add("A03_A05_A07_E13_source_report", lambda s, d: dispatched(s, d)[1], """SELECT page_id AS source_id, CASE k WHEN 0 THEN 'SITEMAP' WHEN 2 THEN 'RSS' WHEN 3 THEN 'GREENHOUSE' END AS route,
      CASE k WHEN 1 THEN 'unexpected error company_id=' || page_id || ': invalid XML' WHEN 4 THEN 'invalid config_json for company_id=' || page_id WHEN 5 THEN 'no custom parser registered for parser_key=NOBODY (company_id=' || page_id || ')'
        WHEN 6 THEN 'not fetched company_id=' || page_id WHEN 7 THEN 'unsupported adapterType=''fax'' company_id=' || page_id END AS warning,
      CAST(CASE k WHEN 0 THEN 1 + fresh WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS INT) AS discovered, CAST(CASE k WHEN 0 THEN fresh WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS INT) AS fetched,
      CAST(CASE k WHEN 0 THEN CASE WHEN title THEN fresh ELSE 0 END WHEN 2 THEN 1 ELSE 0 END AS INT) AS parsed, CAST(CASE k WHEN 0 THEN CASE WHEN title THEN fresh ELSE 0 END WHEN 2 THEN 1 ELSE 0 END AS INT) AS selected
      FROM (SELECT page_id, page_id % 8 AS k, CASE WHEN page_id % 9 + 1 >= 3 THEN 1 ELSE 0 END AS fresh, regexp_matches(html, '(?is)<h1[^>]*>.*?[^\\s<].*?</h1>|<title[^>]*>.*?[^\\s<].*?</title>') AS title FROM pages) q""")
    add("A03_A05_A07_dispatched_postings", lambda s, d: dispatched(s, d)[0].filter("url NOT LIKE 'https://a.%'").select("source_id", "pos", F.when(col("url").startswith("https://f."), col("title")).alias("feed_title"), "url"),
        """SELECT page_id AS source_id, 0 AS pos, CASE WHEN page_id % 8 = 2 THEN 'A & B' END AS feed_title, CASE WHEN page_id % 8 = 2 THEN 'https://f.example/?a=1&b=' || page_id ELSE url END AS url FROM pages
        WHERE page_id % 8 = 2 OR (page_id % 8 = 0 AND page_id % 9 + 1 >= 3 AND regexp_matches(html, '(?is)<h1[^>]*>.*?[^\\s<].*?</h1>|<title[^>]*>.*?[^\\s<].*?</title>') AND url NOT LIKE 'https://a.%')""")

    lease, retry = 129_600, 10_800
    kinds = "CASE event_type WHEN 'signup' THEN 'ENQUEUE' WHEN 'view' THEN 'CLAIM' WHEN 'click' THEN 'CLAIM' WHEN 'error' THEN 'FAIL' ELSE 'SUCCEED' END"

    def lease_queue(s, d):
        schema = s.read.parquet(f"{d}/events.parquet").schema
        events = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/event*.parquet")
        commands = events.select(col("event_id").alias("seq"), (col("user_id") * 3 + col("event_id") % 3).alias("id"), col("ts").cast("timestamp").alias("at"), F.expr(kinds).alias("kind"), (F.floor(col("event_id") / 40) % 2).cast("int").alias("hash"))
        moved = leases.drain(leases.lease_transitions(commands, lease, retry), scratch_path(s, "lease-queue"))
        end = s.read.parquet(f"{d}/events.parquet").agg(F.max(col("ts").cast("timestamp")).alias("end"))
        last = leases.latest(moved, F.lit(end.first()["end"]))
        return last.select("id", "status", "attempts", F.date_format("lease_until", "yyyy-MM-dd HH:mm:ss").alias("lease_until"), F.date_format("next_retry", "yyyy-MM-dd HH:mm:ss").alias("next_retry"))

    step = f"""CASE WHEN c.kind = 'ENQUEUE' AND (r.status IS NULL OR r.hash <> c.hash) THEN {{'status': 'PENDING', 'attempts': 0, 'lease': NULL::TIMESTAMP, 'retry': NULL::TIMESTAMP, 'hash': c.hash, 'kind': NULL, 'at': NULL}}
      WHEN c.kind = 'CLAIM' AND (r.status = 'PENDING' OR (r.status = 'FAILED' AND r.retry <= c.at)) AND r.attempts < 5 THEN {{'status': 'PROCESSING', 'attempts': r.attempts + 1, 'lease': c.at + to_seconds({lease}), 'retry': r.retry, 'hash': r.hash, 'kind': NULL, 'at': NULL}}
      WHEN c.kind = 'FAIL' AND r.status = 'PROCESSING' THEN {{'status': 'FAILED', 'attempts': r.attempts + 1, 'lease': NULL::TIMESTAMP, 'retry': c.at + to_seconds(CAST({retry} * pow(2, least(r.attempts + 1, 6)) AS BIGINT)), 'hash': r.hash, 'kind': NULL, 'at': NULL}}
      WHEN c.kind = 'SUCCEED' AND r.status = 'PROCESSING' THEN {{'status': 'SUCCEEDED', 'attempts': r.attempts, 'lease': NULL::TIMESTAMP, 'retry': r.retry, 'hash': r.hash, 'kind': NULL, 'at': NULL}} ELSE r END"""
    freed = "CASE WHEN {s}.status = 'PROCESSING' AND {s}.lease < {at} THEN {{'status': 'PENDING', 'attempts': {s}.attempts, 'lease': NULL::TIMESTAMP, 'retry': {s}.retry, 'hash': {s}.hash, 'kind': NULL, 'at': NULL}} ELSE {s} END"
    none = "{'status': NULL::VARCHAR, 'attempts': 0, 'lease': NULL::TIMESTAMP, 'retry': NULL::TIMESTAMP, 'hash': NULL::INT, 'kind': NULL::VARCHAR, 'at': NULL::TIMESTAMP}"
    add("I02_I03_I05_lease_stream", lease_queue, f"""WITH cmds AS (SELECT user_id * 3 + event_id % 3 AS id, {{'status': NULL::VARCHAR, 'attempts': 0, 'lease': NULL::TIMESTAMP, 'retry': NULL::TIMESTAMP, 'hash': CAST(event_id // 40 % 2 AS INT), 'kind': {kinds}, 'at': ts}} AS cmd, ts, event_id FROM events),
      f AS (SELECT id, list_reduce(list(cmd ORDER BY ts, event_id), lambda s, c: list_transform([{freed.format(s='s', at='c.at')}], lambda r: {step})[1], {none}) AS s FROM cmds GROUP BY id),
      g AS (SELECT id, {freed.format(s='s', at='(SELECT max(ts) FROM events)')} AS s FROM f)
      SELECT id, s.status AS status, s.attempts AS attempts, strftime(s.lease, '%Y-%m-%d %H:%M:%S') AS lease_until, strftime(s.retry, '%Y-%m-%d %H:%M:%S') AS next_retry FROM g WHERE s.status IS NOT NULL""")

    def incremental(s, d):
        rows = normalize(raw_records(s, d)).withColumn("hash", F.md5(F.concat_ws("|", F.coalesce("description", F.lit("")), F.coalesce("location", F.lit("")))))
        merge = lambda df: dedup.merge_clusters(df, F.col("record_key"), HEAD, SCALARS, LISTS)
        state_of = IncrementalMerge(s, scratch_path(s, "incremental-merge"), rows.schema, "record_key", "hash", merge, buckets=32)
        for k in range(3):  # as three deliveries
            state_of.apply(rows.filter(col("seq") % 3 == k), k)
        return state_of.current().select("record_key", "n_merged", F.array_join("skills", "|").alias("skills"))

    add("I01_incremental_merge", incremental, with_postings(f""", {RAW_SQL},
      m AS (SELECT sha256(source || '|' || {_url('url')}) AS record_key, md5(coalesce(nullif(trim(regexp_replace(description, '[\\s\\p{{Z}}]+', ' ', 'g')), ''), '') || '|' || coalesce(nullif(trim(location), ''), '')) AS hash, seq,
        coalesce(list_transform(from_json(skills_json, '["VARCHAR"]'), lambda x: trim(x)), CAST([] AS VARCHAR[])) AS skills FROM raw),
      -- of the rows of a delivery that agree the first counts, and later deliveries add nothing to them
      o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY record_key, hash ORDER BY seq % 3, seq) = 1),
      g AS (SELECT record_key, count(*) AS n_merged, flatten(list(skills ORDER BY seq)) AS flat FROM o GROUP BY 1)
      SELECT record_key, n_merged, (SELECT coalesce(string_agg(v, '|' ORDER BY k), '') FROM (SELECT v, min(k) AS k FROM (SELECT unnest(flat) AS v, generate_subscripts(flat, 1) AS k) x GROUP BY v) y) AS skills FROM g"""))

    hashed = lambda s, d: postings(s, d).select("id", F.md5("title").alias("input_hash"))
    known = lambda s, d: analyses(s, d).join(hashed(s, d), col("posting_id") == col("id")).select("posting_id", "status", F.when(col("id") % 5 == 1, "old").otherwise(col("input_hash")).alias("input_hash"), F.when(col("id") % 7 == 0, "0.9").otherwise("1.0").alias("version"))
    reason = lambda force: f"CASE WHEN status IS NULL THEN 'NO_ANALYSIS_ROW' WHEN status IN ('SUCCEEDED', 'FALLBACK') THEN CASE WHEN {force} THEN 'FORCE_RECLASSIFY' WHEN id % 5 <> 1 AND id % 7 > 0 THEN 'ALREADY_COMPLETED_SAME_VERSION' ELSE 'VERSION_OR_INPUT_CHANGED' END ELSE 'ALREADY_PENDING_OR_PROCESSING' END"
    chosen = lambda force: f"SELECT id, {reason(force)} AS reason FROM (SELECT p.id, a.status FROM postings p LEFT JOIN analyses a ON a.posting_id = p.id WHERE p.id > 40 ORDER BY p.id LIMIT 1000) q"
    for force in (False, True):
        add("I14_E11_backfill_forced" if force else "I14_E11_backfill_dry_run",
            lambda s, d, f=force: state.backfill(hashed(s, d), known(s, d), "1.0", after_id=40, force=f).groupBy("reason", "enqueued").agg(F.count("*").alias("n"), F.max("id").alias("cursor")),
            with_postings(f"SELECT reason, reason NOT LIKE 'ALREADY%' AS enqueued, count(*) AS n, max(id) AS cursor FROM ({chosen(str(force).lower())}) z GROUP BY ALL"))
    add("I14_backfill_applied", lambda s, d: state.apply_backfill(known(s, d), state.backfill(hashed(s, d), known(s, d), "1.0", after_id=40), "1.0").groupBy("status", "version").agg(F.count("*").alias("n")),
        with_postings(f"""SELECT CASE WHEN r LIKE 'ALREADY%' OR r IS NULL THEN status ELSE 'PENDING' END AS status, CASE WHEN r LIKE 'ALREADY%' OR r IS NULL THEN CASE WHEN posting_id % 7 = 0 THEN '0.9' ELSE '1.0' END ELSE '1.0' END AS version, count(*) AS n
          FROM (SELECT coalesce(a.posting_id, z.id) AS posting_id, a.status, z.reason AS r FROM analyses a FULL JOIN (SELECT * FROM ({chosen('false')}) WHERE reason NOT LIKE 'ALREADY%') z ON z.id = a.posting_id) w GROUP BY ALL"""))

    def source_updates(s, d):
        sup = s.read.parquet(f"{d}/supplier.parquet")
        i = col("s_suppkey")
        old = sup.select(i.alias("id"), (i % 20).alias("company_id"), F.lit("OFFICIAL_CAREER").alias("source_type"), F.concat(F.lit("https://s/"), i.cast("string")).alias("url"), F.lit("RSS").alias("adapter"), F.lit("ACTIVE").alias("status"),
                         F.lit('{"a":1,"b":{"c":2}}').alias("config"), F.lit("VERIFIED").alias("verification"), F.lit("2001-08-01").alias("verified_at"))
        none = F.lit(None).cast("string")
        kind = i % 6
        asked = sup.filter("s_suppkey % 7 > 0").select(i.alias("id"), F.when(kind == 0, " official_career ").alias("source_type"), F.when(kind == 1, F.concat(F.lit("https://s/"), (i + 20).cast("string"))).when(kind == 2, "https://new").alias("url"),
                         F.when(kind == 3, "sitemap").otherwise(none).alias("adapter"), F.when(kind == 0, "paused").alias("status"), F.when(kind == 4, '{"b":{"c":2},"a":1}').when(kind == 5, '{"a":2}').alias("config"))
        return state.update_sources(old, asked).drop("source_type")

    add("B19_source_updates", source_updates, """SELECT id, company_id, outcome, CASE WHEN outcome = 'RESET' AND k = 2 THEN 'https://new' WHEN outcome = 'RESET' AND k = 1 THEN 'https://s/' || (id + 20) ELSE 'https://s/' || id END AS url, CASE WHEN outcome = 'RESET' AND k = 3 THEN 'SITEMAP' ELSE 'RSS' END AS adapter,
      CASE WHEN outcome = 'RESET' THEN 'PENDING' WHEN outcome = 'UPDATED' AND k = 0 THEN 'PAUSED' ELSE 'ACTIVE' END AS status, CASE WHEN outcome = 'UPDATED' AND k = 4 THEN '{"b":{"c":2},"a":1}' WHEN outcome = 'RESET' AND k = 5 THEN '{"a":2}' ELSE '{"a":1,"b":{"c":2}}' END AS config,
      CASE WHEN outcome = 'RESET' THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS verification, CASE WHEN outcome <> 'RESET' THEN '2001-08-01' END AS verified_at
      FROM (SELECT s_suppkey AS id, s_suppkey % 20 AS company_id, s_suppkey % 6 AS k, CASE WHEN s_suppkey % 7 = 0 THEN 'KEPT' WHEN s_suppkey % 6 = 1 AND s_suppkey + 20 IN (SELECT s_suppkey FROM supplier) THEN 'DUPLICATE' WHEN s_suppkey % 6 IN (1, 2, 3, 5) THEN 'RESET' ELSE 'UPDATED' END AS outcome FROM supplier) q""")

    def seeds(s, d):
        u = users(s, d)
        kind = lambda k: u.select("user_id", F.lit(k).alias("kind"), F.posexplode(csv(col(k))).alias("pos", "value"))
        every = kind(KINDS[0])
        for k in KINDS[1:]:
            every = every.unionByName(kind(k))
        first = every.groupBy("kind", "value").agg(F.min(F.struct("user_id", "pos")).alias("first"))
        # distinct values of a kind: a vocabulary, not the users
        return first.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "value"))), lambda x: x["value"]), "|").alias("values"))

    every = " UNION ALL ".join(f"SELECT user_id, '{k}' AS kind, {_csv(k)} AS xs FROM users" for k in KINDS)
    add("E12_seed_lists", seeds, with_postings(f"""SELECT kind, string_agg(value, '|' ORDER BY user_id, pos) AS "values" FROM (SELECT kind, value, user_id, pos FROM (SELECT kind, user_id, unnest(xs) AS value, generate_subscripts(xs, 1) AS pos FROM ({every}) a) b
      QUALIFY row_number() OVER (PARTITION BY kind, value ORDER BY user_id, pos) = 1) c GROUP BY kind"""))

    def dashboard(s, d):
        c = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", (col("c_nationkey") * 10 + F.ascii("c_mktsegment") % 10).alias("user_id"))
        o = s.read.parquet(f"{d}/orders.parquet").join(c, col("o_custkey") == col("c_custkey")).select("user_id", "o_orderkey", "o_orderdate", "o_orderstatus")
        last = o.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(col("o_orderdate").desc(), col("o_orderkey").desc()))).filter("r <= 3")  # pruned before the shuffle by its rank limit
        recent = last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("r", "o_orderkey", "o_orderstatus"))).alias("recent"))
        prefs = users(s, d).select("user_id", *[F.size(csv(col(k))).alias(f"n_{k}") for k in ("roles", "skills", "companies")])
        return prefs.join(recent, "user_id", "left").select("*", F.get("recent", F.lit(0))["o_orderkey"].alias("latest"), F.array_join(F.transform("recent", lambda x: F.concat(x["o_orderkey"].cast("string"), x["o_orderstatus"])), ",").alias("reports")).drop("recent")

    add("L01_dashboard_per_user", dashboard, with_postings(f"""SELECT user_id, len({_csv('roles')}) AS n_roles, len({_csv('skills')}) AS n_skills, len({_csv('companies')}) AS n_companies, latest, reports FROM users LEFT JOIN (
        SELECT user_id, arg_min(o_orderkey, r) AS latest, string_agg(o_orderkey || o_orderstatus, ',' ORDER BY r) AS reports FROM (
          SELECT c_nationkey * 10 + ascii(c_mktsegment) % 10 AS user_id, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY c_nationkey * 10 + ascii(c_mktsegment) % 10 ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders JOIN customer ON o_custkey = c_custkey) q WHERE r <= 3 GROUP BY 1) z USING (user_id)"""))
    add("K22_empty_reports", lambda s, d: s.read.parquet(f"{d}/orders.parquet").groupBy(col("o_orderdate").cast("date").alias("day")).agg(F.count_if(col("o_orderstatus") == "P").alias("n")).filter("n = 0").select("day", F.md5(reports.empty_report(col("day").cast("string"))).alias("digest"), F.length(reports.empty_report(col("day").cast("string"))).alias("n_chars")),
        "SELECT day, md5(body) AS digest, length(body) AS n_chars FROM (SELECT day, " + _EMPTY.replace("{REF}", "' || CAST(day AS VARCHAR) || '") + " AS body FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'P') = 0) q) z")


#: The report without postings, restated; {REF} is its day.
_EMPTY = """'# 오늘의 채용 브리핑' || chr(10) || chr(10) || '## 오늘의 핵심 요약' || chr(10) || chr(10) || '- {REF} 기준, 선호도에 맞는 채용 공고가 오늘은 없습니다.' || chr(10)
        || '- 선호 조건을 확인하고 내일 다시 브리핑을 살펴보세요.' || chr(10) || '- 조건을 조금 넓히면 더 많은 공고를 만날 수 있습니다.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 🏆 추천 공고 TOP 0' || chr(10) || chr(10) || '오늘 추천할 공고가 없습니다.'
        || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## ⏰ 신규/마감 임박 공고' || chr(10) || chr(10) || '선별된 공고 중 7일 이내 마감 임박 공고가 없습니다.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 💡 오늘의 지원 추천 액션' || chr(10) || chr(10)
        || '1. 선호 조건(역할, 기업, 스킬, 위치)을 다시 확인해 보세요.' || chr(10) || '2. 내일 다시 브리핑을 확인해 주세요.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 🔑 오늘의 키워드' || chr(10) || chr(10) || '해당 사항 없습니다.' || chr(10) || chr(10) || '---'
        || chr(10) || chr(10) || '## ✏️ 한 줄 정리' || chr(10) || chr(10) || '내일은 더 많은 공고가 준비되어 있을 거예요.'"""
