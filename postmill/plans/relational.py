"""Registered joins, aggregates, set operations, state transforms and reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.functions import policy
from postmill.operators import dedup, joins, reports, state
from postmill.plans.functions_queries import _any
from postmill.plans.recommend import provenance
from postmill.sources.fixtures import REF, analyses, postings, with_postings

NOW = "2024-01-16 00:00:00"
#: Words of the rule classifier, by domain and group, in order of precedence.
CLASSIFIER = (
    ("IT", "BACKEND", ("backend", "백엔드", "server-side", "서버 개발")),
    ("IT", "FRONTEND", ("frontend", "프론트엔드", "front-end")),
    ("IT", "FULLSTACK", ("fullstack", "풀스택", "full-stack")),
    ("IT", "DATA", ("data engineer", "데이터 엔지니어", "data pipeline", "데이터 파이프라인")),
    ("IT", "AI_ML", ("machine learning", "머신러닝", "ml engineer", "ai engineer", "deep learning", "딥러닝", "nlp engineer")),
    ("IT", "DEVOPS_INFRA", ("devops", "sre", "site reliability", "platform engineer", "cloud engineer", "인프라 엔지니어", "infra engineer")),
    ("IT", "MOBILE", ("android", "ios", "mobile", "앱 개발", "flutter", "react native")),
    ("IT", "OTHER_IT", ("qa engineer", "qa 엔지니어", "quality engineer", "security engineer", "보안 엔지니어", "automation engineer", "테스트 엔지니어")),
    ("IT", "GENERAL_IT", ("software engineer", "소프트웨어 엔지니어", "developer", "개발자", "programmer", "프로그래머", "engineer", "엔지니어")),
    ("NON_IT", "NON_DEV", ("sales", "영업", "operations manager", "operations specialist", "운영", "총무", "경리", "회계", "재무", "marketing", "마케팅",
                           "hr manager", "인사", "보험", "insurance", "법무", "legal", "manager", "매니저")),
)

QUEUE_SQL = f"""SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'PROCESSING' WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SUCCEEDED' ELSE 'FALLBACK' END AS status,
  CAST(event_id % 6 AS INT) AS attempts, ts AS created, ts + INTERVAL '12' HOUR AS lease_until, ts + INTERVAL '7' DAY AS next_retry, CAST(user_id AS VARCHAR(20)) AS token, CAST(event_id % 7 AS INT) AS hash FROM events"""


def queue(spark, d):
    sql = QUEUE_SQL.replace("FROM events", "FROM {events}")
    return spark.sql(sql, events=spark.read.parquet(f"{d}/events.parquet"))


def register(add) -> None:
    col = F.col
    t = lambda spark, d, name: spark.read.parquet(f"{d}/{name}.parquet")
    q = f"WITH queue AS ({QUEUE_SQL}) "
    now = lambda: F.lit(NOW).cast("timestamp_ntz")

    # --- joins
    add("A34_scan", lambda s, d: t(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
    add("D02_inner_join_aggregate", lambda s, d: t(s, d, "orders").join(t(s, d, "customer"), col("o_custkey") == col("c_custkey")).filter("c_acctbal > 0").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_order")),
        "SELECT c_nationkey, count(*) AS n, max(o_orderdate) AS last_order FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1")
    add("D03_D04_dimension_joins", lambda s, d: t(s, d, "supplier").join(t(s, d, "nation"), col("s_nationkey") == col("n_nationkey")).join(t(s, d, "region"), col("n_regionkey") == col("r_regionkey")).select("s_suppkey", "n_name", "r_name"),
        "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
    add("D05_left_enrichment", lambda s, d: t(s, d, "documents").select("doc_id", "lang").join(t(s, d, "labels"), "doc_id", "left"), "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
    add("D06_missing_report", lambda s, d: t(s, d, "documents").select("doc_id").join(t(s, d, "labels"), "doc_id", "left_anti"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
    add("D07_D08_reconcile", lambda s, d: joins.reconcile(t(s, d, "orders").select(F.when(col("o_orderkey") % 3 == 0, -col("o_orderkey")).otherwise(col("o_orderkey")).alias("k")), t(s, d, "lineitem").select(F.when(col("l_orderkey") % 4 == 0, col("l_orderkey") + 1_000_000_000_000).otherwise(col("l_orderkey")).alias("k"), "l_linenumber"), "k", "l_linenumber"),
        """SELECT coalesce(o.k, l.k) AS k, CASE WHEN o.k IS NULL THEN 'UNEXPECTED' WHEN l.k IS NULL THEN 'MISSING' ELSE 'MATCHED' END AS outcome, coalesce(n - 1, 0) AS n_duplicates
        FROM (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS k FROM orders) o FULL JOIN (SELECT CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey + 1000000000000 ELSE l_orderkey END AS k, count(*) AS n FROM lineitem GROUP BY 1) l ON o.k = l.k""")
    def resolve(s, d):
        sup = t(s, d, "supplier")
        comp = sup.select(col("s_suppkey").alias("company_id"), F.lower("s_name").alias("normalized"), (col("s_acctbal") >= 0).alias("active"))
        al = sup.select(col("s_suppkey").alias("company_id"), F.concat(F.lower("s_name"), F.lit(" co")).alias("alias"))
        names = comp.select(F.when(col("company_id") % 2 == 0, col("normalized")).otherwise(F.concat("normalized", F.lit(" co"))).alias("name"))
        return joins.resolve_names(names, comp, al)

    add("D09_two_step_resolution", resolve, "SELECT s_suppkey AS company_id, CASE WHEN s_suppkey % 2 = 0 THEN lower(s_name) ELSE lower(s_name) || ' co' END AS name, s_suppkey % 2 = 0 AS direct FROM supplier WHERE s_acctbal >= 0")
    add("D11_E22_L04_nested_lists", lambda s, d: t(s, d, "nation").join(t(s, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("suppliers")), col("n_nationkey") == col("s_nationkey"), "left").select("n_nationkey", "n_name", "suppliers"),
        "SELECT n_nationkey, n_name, (SELECT string_agg(s_name, ',' ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
    add("D15_G06_E21_semi_users", lambda s, d: t(s, d, "customer").filter("c_acctbal > 0").join(t(s, d, "orders").select("o_custkey"), col("c_custkey") == col("o_custkey"), "left_semi").select("c_custkey"),
        "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders)")
    add("D16_B09_B14_insert_missing", lambda s, d: state.insert_missing(t(s, d, "nation").select(F.when(col("n_nationkey") < 12, col("n_nationkey")).otherwise(col("n_nationkey") + 100).alias("n_nationkey"), "n_name"), t(s, d, "nation").select(F.when(col("n_nationkey") > 5, col("n_nationkey")).otherwise(col("n_nationkey") + 200).alias("n_nationkey"), F.upper("n_name").alias("n_name")), ["n_nationkey"]),
        "SELECT CASE WHEN n_nationkey < 12 THEN n_nationkey ELSE n_nationkey + 100 END AS n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, upper(n_name) FROM nation WHERE n_nationkey >= 12 UNION ALL SELECT n_nationkey + 200, upper(n_name) FROM nation WHERE n_nationkey <= 5")
    add("D17_uniqueness_probe", lambda s, d: t(s, d, "supplier").alias("a").join(t(s, d, "supplier").alias("b"), (col("a.s_nationkey") == col("b.s_nationkey")) & (F.substring(col("a.s_name"), -1, 1) == F.substring(col("b.s_name"), -1, 1)) & (col("a.s_suppkey") != col("b.s_suppkey")), "left_semi").select("s_suppkey"),
        "SELECT s_suppkey FROM supplier a WHERE EXISTS (SELECT 1 FROM supplier b WHERE a.s_nationkey = b.s_nationkey AND right(a.s_name, 1) = right(b.s_name, 1) AND a.s_suppkey <> b.s_suppkey)")
    add("D18_B11_left_backfill", lambda s, d: t(s, d, "orders").join(t(s, d, "lineitem").filter("l_linenumber = 2").select("l_orderkey", "l_shipdate"), col("o_orderkey") == col("l_orderkey"), "left").select("o_orderkey", F.coalesce(col("l_shipdate").cast("date"), F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), col("o_orderdate")).cast("date")).alias("day")),
        "SELECT o_orderkey, coalesce(CAST(l_shipdate AS DATE), CAST(o_orderdate + INTERVAL 9 HOUR AS DATE)) AS day FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 2")
    add("C14_L03_search", lambda s, d: joins.search(t(s, d, "supplier").select(col("s_suppkey").alias("company_id"), col("s_name").alias("name"), (col("s_acctbal") >= 0).alias("active")), t(s, d, "supplier").select(col("s_suppkey").alias("company_id"), F.concat(F.lit("alias "), (col("s_suppkey") * 3).cast("string")).alias("alias")), " 12 ", 20),
        "SELECT s_suppkey AS company_id, s_name AS name FROM supplier WHERE s_acctbal >= 0 AND (contains(lower(s_name), '12') OR contains('alias ' || CAST(s_suppkey * 3 AS VARCHAR), '12')) ORDER BY s_name, s_suppkey LIMIT 20")
    # --- aggregates
    add("E09_L05_status_counts", lambda s, d: queue(s, d).groupBy("status").count().withColumnRenamed("count", "n"), q + "SELECT status, count(*) AS n FROM queue GROUP BY 1")
    add("E10_status_pivot", lambda s, d: queue(s, d).agg(F.count("*").alias("total"), *[F.count_if(col("status") == v).alias(v.lower()) for v in ("PENDING", "PROCESSING", "SUCCEEDED", "FALLBACK", "FAILED", "CONFLICT")]),
        q + "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{v}') AS {v.lower()}" for v in ("PENDING", "PROCESSING", "SUCCEEDED", "FALLBACK", "FAILED", "CONFLICT")) + " FROM queue")
    add("E11_I14_backfill_reasons", lambda s, d: analyses(s, d).groupBy(F.when(col("status") == "SUCCEEDED", "ALREADY_DONE").when(col("min_years").isNull(), "NO_INPUT").otherwise("ENQUEUE").alias("reason")).agg(F.count("*").alias("n")),
        with_postings("SELECT CASE WHEN status = 'SUCCEEDED' THEN 'ALREADY_DONE' WHEN min_years IS NULL THEN 'NO_INPUT' ELSE 'ENQUEUE' END AS reason, count(*) AS n FROM analyses GROUP BY 1"))
    def seeds(s, d):
        w = postings(s, d).select("seq", F.posexplode(F.from_json("skills_json", "array<string>")).alias("pos", "skill"))
        return w.groupBy("skill").agg(F.min(F.struct("seq", "pos")).alias("first")).select("skill", col("first.seq").alias("first_seq"), col("first.pos").alias("first_pos"))

    add("E12_ordered_distinct_union", seeds, with_postings("SELECT skill, first.seq AS first_seq, first.pos AS first_pos FROM (SELECT skill, min({'seq': seq, 'pos': pos}) AS first FROM (SELECT seq, unnest(ls) AS skill, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT seq, from_json(skills_json, '[\"VARCHAR\"]') AS ls FROM postings) a) b GROUP BY skill) c"))
    def per_source(s, d):
        """Tallies, and the first three companies with how many more there are: three are gathered per source, the rest are counted."""
        p = postings(s, d)
        names = p.select("source", "company").distinct()
        first = names.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("company"))).filter("r <= 3").groupBy("source").agg(F.array_sort(F.collect_list("company")).alias("first"))
        counted = p.groupBy("source").agg(F.count("*").alias("n"), F.count_if(col("deadline").isNull()).alias("open_ended")).join(names.groupBy("source").agg(F.count("*").alias("names")), "source").join(first, "source")
        return counted.select("source", "n", "open_ended", reports.overflow_of("first", col("names")).alias("label"))

    add("E14_E17_E23_per_source", per_source,
        with_postings("SELECT source, count(*) AS n, count(*) FILTER (WHERE deadline IS NULL) AS open_ended, array_to_string(list_sort(list(DISTINCT company))[1:3], ', ') || CASE WHEN count(DISTINCT company) > 3 THEN ' 외 ' || CAST(count(DISTINCT company) - 3 AS VARCHAR) || '개' ELSE '' END AS label FROM postings GROUP BY 1"))
    add("E15_E16_outcomes", lambda s, d: t(s, d, "events").groupBy("user_id").agg(F.count_if(col("event_type") == "error").alias("failed"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.when(col("event_type") == "error", F.concat(col("event_type"), F.lit(":"), F.weekday("ts").cast("string"))))), ", ").alias("failures")).select("user_id", "failures", F.when(col("failed") == 0, "COMPLETED").when(col("failed") == col("n"), "FAILED").otherwise("PARTIAL_SUCCESS").alias("outcome"), "failed"),
        "SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'COMPLETED' WHEN count(*) FILTER (WHERE event_type = 'error') = count(*) THEN 'FAILED' ELSE 'PARTIAL_SUCCESS' END AS outcome, count(*) FILTER (WHERE event_type = 'error') AS failed, coalesce(array_to_string(list_sort(list(DISTINCT 'error:' || CAST((isodow(ts) - 1) AS VARCHAR)) FILTER (WHERE event_type = 'error')), ', '), '') AS failures FROM events GROUP BY 1")
    add("E18_E24_duplicates", lambda s, d: t(s, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n")).filter("n > 1"), "SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
    add("E19_B12_keep_latest", lambda s, d: dedup.keep_latest(t(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey"), "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
    add("E20_B13_keep_preferred", lambda s, d: t(s, d, "orders").groupBy("o_custkey").agg(F.coalesce(F.max(F.when(col("o_orderstatus") == "F", col("o_orderkey"))), F.max("o_orderkey")).alias("kept")), "SELECT o_custkey, coalesce(max(o_orderkey) FILTER (WHERE o_orderstatus = 'F'), max(o_orderkey)) AS kept FROM orders GROUP BY 1")
    add("A18_keep_first_by_url", lambda s, d: dedup.keep_first(postings(s, d).select("url", "seq", "company"), ["url"]), with_postings("SELECT url, min(seq) AS seq, arg_min(company, seq) AS company FROM postings GROUP BY 1"))
    # --- sets
    add("G01_bag_union", lambda s, d: t(s, d, "supplier").select(col("s_name").alias("name"), F.lit(0).alias("adapter")).unionByName(t(s, d, "customer").select(col("c_name").alias("name"), F.lit(1).alias("adapter"))).groupBy("adapter").agg(F.count("*").alias("n")), "SELECT 0 AS adapter, count(*) AS n FROM supplier UNION ALL SELECT 1, count(*) FROM customer")
    ids = "list(l_partkey ORDER BY l_linenumber, l_partkey)"
    add("G04_G05_id_order", lambda s, d: t(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x")).select("l_orderkey", reports.order_codes(F.transform("x", lambda v: v["l_partkey"]), F.array_sort(F.transform("x", lambda v: v["l_partkey"]))).alias("code")),
        f"SELECT l_orderkey, CASE WHEN {ids} = list_sort({ids}) THEN NULL ELSE 'ID_ORDER_MISMATCH' END AS code FROM lineitem GROUP BY 1")
    # --- paging and reads
    add("F09_F10_L02_page", lambda s, d: t(s, d, "orders").select("o_orderkey", "o_orderdate").orderBy(col("o_orderdate").desc(), col("o_orderkey").desc()).offset(20).limit(10), "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10 OFFSET 20")
    add("F11_F17_L01_latest", lambda s, d: t(s, d, "orders").filter("o_orderstatus = 'F'").orderBy(col("o_orderdate").desc(), "o_orderkey").select("o_orderkey", "o_totalprice").limit(3), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 3")
    add("F12_keyset_page", lambda s, d: t(s, d, "orders").filter("o_orderkey > 100").orderBy("o_orderkey").limit(50).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY 1 LIMIT 50")
    add("C15_C16_C17_projection_filter", lambda s, d: t(s, d, "documents").filter(F.contains(F.lower("text"), F.lower(F.lit("The")))).select("doc_id", F.substring("text", 1, 20).alias("head")), "SELECT doc_id, substr(text, 1, 20) AS head FROM documents WHERE contains(lower(text), 'the')")
    add("C11_C12_C18_C19_predicates", lambda s, d: t(s, d, "orders").filter(col("o_orderstatus").isin("O", "P") & col("o_orderdate").between(F.lit("2000-01-01").cast("timestamp_ntz"), F.lit("2000-12-31").cast("timestamp_ntz"))).select("o_orderkey", F.when(col("o_orderpriority").rlike("URGENT|HIGH"), "retryable").otherwise("fatal").alias("kind")),
        "SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, 'URGENT|HIGH') THEN 'retryable' ELSE 'fatal' END AS kind FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'")
    add("C20_B08_display_order", lambda s, d: reports.first_of(postings(s, d), "company", "p_size", "id").filter("trim(title) <> ''").select("id", "company", (F.row_number().over(Window.partitionBy("company").orderBy("p_size", "id")) - 1).alias("display_order")),
        with_postings("SELECT id, company, row_number() OVER (PARTITION BY company ORDER BY p_size, id) - 1 AS display_order FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY p_size, id) AS r FROM postings) q WHERE r <= 7 AND trim(title) <> ''"))
    # --- state
    due = f"(status = 'PENDING' OR (status = 'FAILED' AND next_retry <= TIMESTAMP '{NOW}')) AND attempts < 5"
    add("F13_I02_claim_batch", lambda s, d: state.claim(queue(s, d), now(), 700, 5, 100).select("id", "status", "attempts", "lease_until"),
        q + f""", p AS (SELECT id FROM queue WHERE {due} ORDER BY created, id LIMIT 100) SELECT q.id, CASE WHEN p.id IS NOT NULL THEN 'PROCESSING' ELSE status END AS status, attempts + CASE WHEN p.id IS NOT NULL THEN 1 ELSE 0 END AS attempts,
        CASE WHEN p.id IS NOT NULL THEN TIMESTAMP '{NOW}' + INTERVAL 700 SECOND ELSE lease_until END AS lease_until FROM queue q LEFT JOIN p ON q.id = p.id""")
    add("I03_L08_release_leases", lambda s, d: state.release_expired(queue(s, d), now()).select("id", "status", "lease_until"), q + f"SELECT id, CASE WHEN status = 'PROCESSING' AND lease_until < TIMESTAMP '{NOW}' THEN 'PENDING' ELSE status END AS status, CASE WHEN NOT (status = 'PROCESSING' AND lease_until < TIMESTAMP '{NOW}') THEN lease_until END AS lease_until FROM queue")
    add("I05_mark_failed", lambda s, d: state.mark_failed(queue(s, d), now()).select("id", "attempts", "next_retry"), q + f"SELECT id, attempts + 1 AS attempts, TIMESTAMP '{NOW}' + to_seconds(60 * CAST(pow(2, least(attempts + 1, 6)) AS INT)) AS next_retry FROM queue")
    def applied(s, d):
        r = queue(s, d).select(F.when(col("id") % 2 == 0, col("id")).otherwise(-col("id")).alias("id"), F.when(col("id") % 3 == 0, F.lit("old")).otherwise(col("token")).alias("token"), F.when(col("id") % 5 == 0, 99).otherwise(col("hash")).alias("hash"), F.lit("done").alias("value"))
        return state.apply_results(queue(s, d), r)

    add("I04_L07_apply_results", applied, q + "SELECT id, CASE WHEN id % 2 = 0 AND id % 3 > 0 AND id % 5 > 0 THEN 'SUCCEEDED' WHEN id % 2 = 0 AND id % 3 > 0 THEN 'CONFLICT' ELSE status END AS status, CASE WHEN id % 2 = 0 AND id % 3 > 0 AND id % 5 > 0 THEN 'done' END AS value FROM queue")
    add("I06_I09_compare_and_set", lambda s, d: state.compare_and_set(queue(s, d), "status", ["PENDING", "FAILED"], "SENDING", col("attempts") < 3).select("id", "status", "claimed"), q + "SELECT id, CASE WHEN status IN ('PENDING', 'FAILED') AND attempts < 3 THEN 'SENDING' ELSE status END AS status, status IN ('PENDING', 'FAILED') AND attempts < 3 AS claimed FROM queue")
    def upserted(s, d):
        p = postings(s, d).select("id", "deadline", "description", "location", "employment_type", F.md5(F.coalesce("description", F.lit(""))).alias("hash"))
        old = p.withColumn("location", F.when(col("id") % 5 > 1, col("location"))).withColumn("hash", F.when(col("id") % 3 == 0, F.lit("stale")).otherwise(col("hash"))).withColumn("id", F.when(col("id") % 4 > 0, col("id")).otherwise(col("id") + 1_000_000_000_000))
        new = p.withColumn("location", F.lit("NEW")).withColumn("id", F.when(col("id") % 3 < 2, col("id")).otherwise(col("id") + 2_000_000_000_000))
        return state.upsert(old, new, "id", ["deadline", "description", "hash"], ["location"], "hash").select("id", "action", "location", "hash")

    add("B01_B06_I01_upsert", upserted, with_postings("""SELECT id, action, CASE action WHEN 'INSERT' THEN 'NEW' WHEN 'KEEP' THEN ol WHEN 'UPDATE' THEN 'NEW' ELSE CASE WHEN coalesce(trim(ol), '') = '' THEN 'NEW' ELSE ol END END AS location,
        CASE action WHEN 'KEEP' THEN oh ELSE h END AS hash FROM (SELECT id, h, CASE WHEN id % 5 > 1 THEN location END AS ol, CASE WHEN id % 3 = 0 THEN 'stale' ELSE h END AS oh,
        CASE WHEN id % 4 = 0 THEN 'INSERT' WHEN id % 3 = 2 THEN 'KEEP' WHEN id % 3 = 0 THEN 'UPDATE' ELSE 'TOUCH' END AS action
        FROM (SELECT *, md5(coalesce(description, '')) AS h FROM postings) p WHERE id % 4 > 0 OR id % 3 < 2) z
        UNION ALL SELECT id + 1000000000000, 'KEEP', CASE WHEN id % 5 > 1 THEN location END, CASE WHEN id % 3 = 0 THEN 'stale' ELSE md5(coalesce(description, '')) END FROM postings WHERE id % 4 = 0
        UNION ALL SELECT id + 2000000000000, 'INSERT', 'NEW', md5(coalesce(description, '')) FROM postings WHERE id % 3 = 2"""))
    add("B02_B03_fold_batch", lambda s, d: state.fold_batch(postings(s, d).withColumn("k", col("id") % 97), "k", "seq", ["deadline"], ["location"]), with_postings("SELECT id % 97 AS k, arg_max(deadline, seq) AS deadline, arg_min(location, seq) AS location, count(*) AS n_in FROM postings GROUP BY 1"))
    add("B04_B19_change_actions", lambda s, d: postings(s, d).join(analyses(s, d), col("id") == col("posting_id"), "left").select("id", F.when(col("posting_id").isNull(), "INSERT_PENDING").when(~col("scope").eqNullSafe(F.lit("ROLE_SPECIFIC")), "RESET_PENDING").otherwise("TOUCH").alias("action")),
        with_postings("SELECT id, CASE WHEN posting_id IS NULL THEN 'INSERT_PENDING' WHEN scope IS DISTINCT FROM 'ROLE_SPECIFIC' THEN 'RESET_PENDING' ELSE 'TOUCH' END AS action FROM postings LEFT JOIN analyses ON id = posting_id"))
    add("B10_json_update", lambda s, d: t(s, d, "events").select("event_id", F.when(F.get_json_object("props", "$.k").cast("int") > 50, "ACTIVE").otherwise(col("event_type")).alias("state")), "SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) > 50 THEN 'ACTIVE' ELSE event_type END AS state FROM events")
    add("B18_H75_map_patch", lambda s, d: t(s, d, "events").select("event_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(state.patch_map(F.from_json("props", "map<string,string>"), F.create_map(F.lit("z"), col("event_type"))))))).alias("merged")), "SELECT event_id, '{\"k\":\"' || json_extract_string(props, '$.k') || '\",\"z\":\"' || event_type || '\"}' AS merged FROM events")
    add("B17_cascade_delete", lambda s, d: t(s, d, "lineitem").join(t(s, d, "orders").join(t(s, d, "customer").filter("c_acctbal < 0"), col("o_custkey") == col("c_custkey"), "left_semi").select("o_orderkey"), col("l_orderkey") == col("o_orderkey"), "left_anti").groupBy("l_returnflag").agg(F.count("*").alias("n")),
        "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0) GROUP BY 1")
    add("I10_I11_idempotent_work", lambda s, d: t(s, d, "orders").select("o_orderkey", "o_custkey").join(t(s, d, "events").select(col("user_id").alias("o_custkey")), "o_custkey", "left_anti").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
    # --- classification and reports
    def rule_classifier(s, d):
        roles = F.coalesce(F.from_json("roles_json", "array<string>"), F.array().cast("array<string>"))
        rows = postings(s, d).withColumn("long", F.length("description") > 20)
        found = policy.classify_by_rules(F.concat("title", F.lit(" "), F.array_join(roles, " ")), F.col("experience_level"), F.col("description"), F.col("long"), CLASSIFIER)
        return rows.select("id", found.alias("f")).select("id", "f.*").withColumn("why", F.array_join("why", ","))

    tx = "lower(title || ' ' || coalesce(array_to_string(from_json(roles_json, '[\"VARCHAR\"]'), ' '), ''))"
    dom = "CASE " + " ".join(f"WHEN {_any(tx, w)} THEN '{a}'" for a, _, w in CLASSIFIER) + " ELSE 'UNKNOWN' END"
    grp = "CASE " + " ".join(f"WHEN {_any(tx, w)} THEN '{b}'" for _, b, w in CLASSIFIER) + " END"
    yr = "CAST(nullif(regexp_extract(experience_level, '([0-9]+)\\s*년', 1), '') AS INT)"
    add("K13_rule_classifier", rule_classifier, with_postings(f"""SELECT id, {dom} AS domain, {grp} AS role_group, {yr} AS min_years,
        CASE WHEN {yr} IS NULL THEN 'UNKNOWN' WHEN contains(experience_level, '우대') THEN 'PREFERRED' ELSE 'REQUIRED' END AS requirement,
        CASE WHEN {dom} = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'ROLE_SPECIFIC' END AS scope, CASE WHEN {dom} <> 'UNKNOWN' THEN 0.5 END::DOUBLE AS confidence,
        concat_ws(',', CASE WHEN {dom} = 'UNKNOWN' THEN 'INSUFFICIENT_ROLE_SIGNAL' END,
          CASE WHEN coalesce(description, '') = '' THEN 'NO_DESCRIPTION' WHEN length(description) > 20 THEN 'DESCRIPTION_TRUNCATED' END) AS why FROM postings"""))
    def validated(s, d):
        a = analyses(s, d)
        found = reports.codes(("INVALID_DOMAIN", ~col("job_domain").isin("IT", "NON_IT")), ("EMPTY_GROUPS", col("role_groups") == ""), ("BAD_YEARS", ~col("min_years").between(0, 2)),
                              ("CONTRADICTION", col("accepts_new_grad") & (col("requirement") == "REQUIRED") & (col("min_years") >= 1)))
        st = reports.severity(found, ("CONTRADICTION",))
        return a.select("posting_id", F.array_join(found, ",").alias("codes"), st.alias("severity"), reports.next_step(st, col("posting_id") % 2).alias("next_step"))

    bad = ["CASE WHEN job_domain NOT IN ('IT', 'NON_IT') THEN 'INVALID_DOMAIN' END", "CASE WHEN role_groups = '' THEN 'EMPTY_GROUPS' END", "CASE WHEN min_years NOT BETWEEN 0 AND 2 THEN 'BAD_YEARS' END",
           "CASE WHEN accepts_new_grad AND requirement = 'REQUIRED' AND min_years >= 1 THEN 'CONTRADICTION' END"]
    add("K14_K16_K17_validation", validated, with_postings(f"""SELECT posting_id, codes, severity, CASE WHEN severity = 'pass' THEN 'save' WHEN severity = 'retryable' AND posting_id % 2 < 1 THEN 'rewrite' ELSE 'fallback' END AS next_step
        FROM (SELECT posting_id, codes, CASE WHEN contains(codes, 'CONTRADICTION') THEN 'fallback_required' WHEN codes <> '' THEN 'retryable' ELSE 'pass' END AS severity FROM (SELECT posting_id, concat_ws(',', {', '.join(bad)}) AS codes FROM analyses) x) y"""))
    def report_rows(s, d):
        """The first seven postings of each company, with their reasons, as the articles of a report."""
        days = F.datediff("deadline", F.lit(REF).cast("date"))
        cond, label = reports.urgency(days)
        parts = [(col("location") == "서울", F.lit("서울 근무")), (F.contains("skills_json", F.lit("SQL")), F.lit("SQL 스킬 매칭")), *zip(cond, label, strict=True)]
        why = reports.reasons(parts, F.concat_ws(" ", "company", F.trim("title")))
        first = reports.first_of(postings(s, d), "company", "p_size", "id")
        return first.select("company", "place", F.trim("title").alias("title"), "source", "url", why.alias("why"), "deadline", days.alias("days"),
                            (F.coalesce("published", "collected") >= F.date_sub(F.lit(REF).cast("date"), 3)).alias("is_new"), F.coalesce(days.between(0, 7), F.lit(False)).alias("is_urgent"))

    dd = f"date_diff('day', DATE '{REF}', deadline)"
    article = """'### ' || place || '. ' || trim(title) || CASE WHEN is_new THEN ' 🆕 NEW' ELSE '' END || CASE WHEN is_urgent THEN ' ⏰ URGENT' ELSE '' END || chr(10) || '- **기업**: ' || company || chr(10)
      || '- **출처**: [공고 보기](' || url || ')' || chr(10) || '- **추천 이유**: ' || CASE WHEN w <> '' THEN w ELSE company || ' ' || trim(title) END || coalesce(chr(10) || '- **마감일**: ' || CAST(deadline AS VARCHAR), '') || chr(10)"""
    add("K19_K20_K21_report_text", lambda s, d: reports.report(report_rows(s, d), "company", F.lit(REF), ["백엔드"], ["SQL", "Java"]), with_postings(f"""SELECT company, n, content FROM (
        SELECT company, count(*) AS n, count(*) FILTER (WHERE is_urgent) AS near, '# 오늘의 채용 브리핑' || chr(10) || chr(10) || '## 오늘의 핵심 요약' || chr(10) || chr(10)
          || '- {REF} 기준, ' || company || '에서 ' || n || '건의 추천 공고를 선별했습니다.' || chr(10) || '- 주요 매칭 조건: 백엔드 역할 및 SQL, Java 스킬이 선별 기준으로 반영되었습니다.' || chr(10)
          || '- ' || company || '의 공고를 오늘 확인해 지원 타이밍을 놓치지 마세요.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 🏆 추천 공고 TOP ' || n || chr(10) || chr(10)
          || string_agg({article}, chr(10) ORDER BY place) || chr(10) || '---' || chr(10) || chr(10) || '## ⏰ 신규/마감 임박 공고' || chr(10) || chr(10)
          || coalesce(string_agg('- **' || trim(title) || '** (' || company || ') — 마감: ' || CAST(deadline AS VARCHAR), chr(10) ORDER BY place) FILTER (WHERE is_urgent), '선별된 공고 중 7일 이내 마감 임박 공고가 없습니다.')
          || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 💡 오늘의 지원 추천 액션' || chr(10) || chr(10) || '1. ' || company || '의 공고를 확인하고 즉시 지원해 보세요.' || chr(10)
          || '2. 이력서에 **SQL, Java** 관련 프로젝트 경험을 구체적으로 작성하세요.' || chr(10)
          || CASE WHEN count(*) FILTER (WHERE is_urgent) > 0 THEN '3. 마감 임박 공고(' || count(*) FILTER (WHERE is_urgent) || '건)를 오늘 안에 지원 검토하세요.' || chr(10) || '4' ELSE '3' END
          || '. 백엔드 관련 GitHub 또는 기술 포트폴리오를 최신화하세요.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 🔑 오늘의 키워드' || chr(10) || chr(10) || 'SQL · Java · 백엔드' || chr(10) || chr(10)
          || '---' || chr(10) || chr(10) || '## ✏️ 한 줄 정리' || chr(10) || chr(10) || '백엔드 포지션 중심으로 ' || company || '에서 ' || n || '건의 공고가 확인되었습니다. 지금 바로 지원해 보세요!' AS content
        FROM (SELECT *, count(*) OVER (PARTITION BY company) AS n FROM (SELECT *, concat_ws(' · ', CASE WHEN location = '서울' THEN '서울 근무' END, CASE WHEN contains(skills_json, 'SQL') THEN 'SQL 스킬 매칭' END,
          CASE WHEN {dd} BETWEEN 0 AND 3 THEN '마감 ' || CAST({dd} AS VARCHAR) || '일 전 — 긴급' END, CASE WHEN {dd} BETWEEN 4 AND 7 THEN '마감 ' || CAST({dd} AS VARCHAR) || '일 이내' END) AS w,
          coalesce(published, collected) >= DATE '{REF}' - 3 AS is_new, coalesce({dd} BETWEEN 0 AND 7, false) AS is_urgent, row_number() OVER (PARTITION BY company ORDER BY p_size, id) AS place FROM postings) p WHERE place <= 7) q GROUP BY company, n) z"""))
    add("D12_prefix_join", lambda s, d: postings(s, d).groupBy("company").agg(F.count("*").alias("n")).join(F.broadcast(s.createDataFrame([("brand#1",), ("BRAND#22 Inc",)], "pref string")), (F.startswith(F.lower("company"), F.lower("pref"))) | F.startswith(F.lower("pref"), F.lower("company"))).select("company", "pref", "n"),
        with_postings("SELECT company, pref, count(*) AS n FROM postings JOIN (VALUES ('brand#1'), ('BRAND#22 Inc')) v(pref) ON starts_with(lower(company), lower(pref)) OR starts_with(lower(pref), lower(company)) GROUP BY 1, 2"))
    add("D13_substring_any", lambda s, d: t(s, d, "documents").select("doc_id", F.exists(F.array(F.lit("hethe"), F.lit("licensed"), F.lit("ción")), lambda k: F.contains(F.lower("text"), k)).alias("hit")), "SELECT doc_id, contains(lower(text), 'hethe') OR contains(lower(text), 'licensed') OR contains(lower(text), 'ción') AS hit FROM documents")
    add("A07_E13_provenance_counts", lambda s, d: provenance(s, d).groupBy("active").agg(F.count("*").alias("n"), F.countDistinct("posting_id").alias("n_postings")), "SELECT s_acctbal >= 0 AS active, count(*) AS n, count(DISTINCT l_partkey) AS n_postings FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
