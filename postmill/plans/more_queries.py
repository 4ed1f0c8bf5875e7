"""Registered queries of track matching, source-side selection and the remaining small operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.functions import policy
from postmill.operators import scoring
from postmill.operators.scoring import IT_GROUPS
from postmill.plans.functions_queries import user_profiles, users_roles_sql
from postmill.sources import parsers
from postmill.sources.fixtures import postings, users, with_postings

GROUP_OF = ("BACKEND", "GENERAL_IT", "DATA", "NON_DEV", "FULLSTACK", "AI_ML")
REQUIREMENT_OF = ("NONE", "REQUIRED", "PREFERRED", "UNKNOWN")
#: Weights of the source-side scores: list -> (text, points).
SOURCE_WEIGHTS = {"companies": ("company", 3.0), "roles": ("title", 2.0), "keywords": ("description", 1.0), "skills": ("skills_json", 1.0), "employment_types": ("employment_type", 0.5)}
SOURCE_SEED = {"companies": ["Brand#1"], "roles": ["backend", "개발자"], "keywords": ["spring"], "skills": ["java"], "employment_types": ["인턴"]}


def track_rows(spark, d):
    """Distinct track lists, three tracks each, of all postings, with their number of postings."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    k = F.col("p_size") + 0
    track = lambda n: F.struct(
        F.lit(n).alias("no"), F.array(pick(GROUP_OF, k + n), pick(GROUP_OF, k * 2 + n)).alias("groups"),
        F.when((k + n) % 3 == 0, True).when((k + n) % 3 == 1, False).alias("accepts"), ((k + n) % 4).cast("int").alias("min_years"),
        pick(REQUIREMENT_OF, k + 2 * n).alias("requirement"), F.lit(None).cast("string").alias("recruitment"), ((k + n) % 5 == 0).alias("unknown"),
    )
    p = postings(spark, d).groupBy("p_size").agg(F.count("*").alias("n"))
    return p.select("p_size", "n", F.array(track(0), track(1), track(2)).alias("tracks"))


def _pick(values, n):
    return "(CASE (" + n + f") % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END)"


TRACK_SQL = f"""tr AS (SELECT p_size, no, [{_pick(GROUP_OF, 'p_size + no')}, {_pick(GROUP_OF, 'p_size * 2 + no')}] AS groups,
    CASE (p_size + no) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS accepts, (p_size + no) % 4 AS min_years, {_pick(REQUIREMENT_OF, 'p_size + 2 * no')} AS requirement
  FROM (SELECT DISTINCT p_size FROM postings), (VALUES (0), (1), (2)) v(no) WHERE (p_size + no) % 5 <> 0),
  us AS ({users_roles_sql()}),
  rt AS (SELECT *, CASE WHEN NOT new_grad THEN CASE WHEN requirement IN ('NONE', 'REQUIRED') THEN 'FULL' ELSE 'PARTIAL' END WHEN accepts = false THEN 'EXCLUDED'
      WHEN requirement = 'REQUIRED' AND min_years >= 1 THEN 'EXCLUDED' WHEN requirement = 'PREFERRED' THEN 'PARTIAL' WHEN accepts = true THEN 'FULL' WHEN requirement = 'NONE' THEN 'FULL'
      WHEN min_years = 0 THEN 'FULL' ELSE 'PARTIAL' END AS exp, len(acceptable) = 0 AS free,
    CASE WHEN len(acceptable) = 0 THEN list_has_any(groups, {list(IT_GROUPS)}) ELSE list_has_any(groups, acceptable) END AS direct, list_contains(groups, 'GENERAL_IT') AS broad FROM tr, us),
  ag AS (SELECT u.user_id, s.p_size, any_value(len(u.acceptable) = 0) AS free, min(no) FILTER (WHERE direct AND exp <> 'EXCLUDED') AS d_ok, min(no) FILTER (WHERE direct) AS d_any,
      min(no) FILTER (WHERE broad AND exp <> 'EXCLUDED') AS b_ok, min(no) FILTER (WHERE broad) AS b_any
    FROM us u CROSS JOIN (SELECT DISTINCT p_size FROM postings) s LEFT JOIN rt ON rt.user_id = u.user_id AND rt.p_size = s.p_size GROUP BY 1, 2),
  rs AS (SELECT *, CASE WHEN d_ok IS NOT NULL THEN d_ok WHEN free THEN NULL WHEN d_any IS NOT NULL THEN d_any WHEN b_ok IS NOT NULL THEN b_ok ELSE b_any END AS track,
    d_ok IS NOT NULL OR (NOT free AND d_any IS NULL AND b_ok IS NOT NULL) AS eligible,
    CASE WHEN d_ok IS NOT NULL OR free OR d_any IS NOT NULL THEN 'DIRECT_MATCH' WHEN b_any IS NOT NULL THEN 'BROAD_IT_MATCH' ELSE 'MISMATCH' END AS role FROM ag)"""


def register(add) -> None:
    col = F.col

    def tracks(s, d):
        rows = track_rows(s, d).join(user_profiles(users(s, d)))  # users are a dimension table
        m = scoring.multi_role_match(col("tracks"), col("acceptable"), col("new_grad"), policy.experience_match, IT_GROUPS)
        return rows.select("user_id", "p_size", m.alias("m")).select("user_id", "p_size", "m.eligible", "m.role", "m.track")

    add("K09_K10_K11_tracks", tracks, with_postings(f", {TRACK_SQL} SELECT user_id, p_size, eligible, role, track FROM rs"))
    hit = lambda c, words: "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), '{w.lower()}')" for w in words) + ")"
    add("K03_K04_source_scores", lambda s, d: postings(s, d).select("id", scoring.first_hit_score(SOURCE_SEED, {c: col(c) for c, _ in SOURCE_WEIGHTS.values()}, SOURCE_WEIGHTS).alias("score")),
        with_postings("SELECT id, " + " + ".join(f"CASE WHEN {hit(c, SOURCE_SEED[k])} THEN {w} ELSE 0 END" for k, (c, w) in SOURCE_WEIGHTS.items()) + " AS score FROM postings"))
    add("K18_modes", lambda s, d: postings(s, d).select("id", F.when(col("source") == "naver", "LLM").when(col("source").isin("jasoseol", "Saramin"), "DETERMINISTIC").otherwise("FALLBACK").alias("mode"), F.when(col("description").isNull(), "EMPTY_INPUT").otherwise("NONE").alias("fallback_reason")),
        with_postings("SELECT id, CASE source WHEN 'naver' THEN 'LLM' WHEN 'greenhouse' THEN 'FALLBACK' ELSE 'DETERMINISTIC' END AS mode, CASE WHEN description IS NULL THEN 'EMPTY_INPUT' ELSE 'NONE' END AS fallback_reason FROM postings"))
    add("C01_category_gate", lambda s, d: postings(s, d).select("id", F.split("p_type", " ").alias("categories")).filter(F.array_contains("categories", "SMALL")).select("id"), with_postings("SELECT id FROM postings WHERE p_type = 'SMALL'"))
    roles = (("백엔드", (11, 12)), ("frontend", (12, 13)), ("data", (21,)))

    def planned(s, d):
        ids = F.flatten(F.array_compact(F.array(*[F.when(F.contains(F.lower("title"), F.lit(w)), F.array(*map(F.lit, k))) for w, k in roles])))
        return postings(s, d).select("id", F.array_join(F.array_sort(F.array_distinct(ids)), ",").alias("duty_ids"))

    add("H19_duty_ids", planned, with_postings("SELECT id, array_to_string(list_sort(list_distinct(flatten(list_filter([" + ", ".join(f"CASE WHEN contains(lower(title), '{w}') THEN {list(k)} END" for w, k in roles) + "], lambda x: x IS NOT NULL)))), ',') AS duty_ids FROM postings"))

    def nested(s, d):
        inner = F.to_json(F.struct(F.struct("company", "p_size").alias("job")))
        page = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), F.to_json(F.struct(inner.alias("raw"))), F.lit("</script></html>"))
        raw = F.get_json_object(parsers.embedded_json(page), "$.raw")
        return postings(s, d).select("id", F.get_json_object(raw, "$.job.company").alias("company"), F.get_json_object(raw, "$.job.p_size").cast("int").alias("size"))

    add("A21_A31_embedded_json", nested, with_postings("SELECT id, company, p_size AS size FROM postings"))
    add("A25_A29_composite_dedup", lambda s, d: postings(s, d).select("company", "p_size", "seq", "title").unionByName(postings(s, d).select("company", "p_size", (col("seq") + 1_000_000_000_000).alias("seq"), F.upper("title").alias("title"))).groupBy("company", "p_size").agg(F.min("seq").alias("seq"), F.min_by("title", "seq").alias("title")).join(postings(s, d).select(F.when(col("id") % 2 == 0, col("id")).otherwise(-col("id")).alias("seq"), "description"), "seq", "left").select("company", "p_size", "seq", "title", "description"),
        with_postings("SELECT g.*, CASE WHEN seq % 2 = 0 THEN (SELECT description FROM postings p WHERE p.id = g.seq) END AS description FROM (SELECT company, p_size, min(seq) AS seq, arg_min(title, seq) AS title FROM postings GROUP BY 1, 2) g"))
    section = r"(?s)(?:자격|Requirements):(.*?)(?:우대:|$)"
    add("H57_H58_section_experience", lambda s, d: postings(s, d).select("id", F.nullif(F.regexp_extract(F.regexp_extract("description", section, 1), r"(\d+)\s*년", 1), F.lit("")).cast("int").alias("years")),
        with_postings("SELECT id, CAST(nullif(regexp_extract(regexp_extract(description, '(?s)(?:자격|Requirements):(.*?)(?:우대:|$)', 1), '(\\d+)\\s*년', 1), '') AS INT) AS years FROM postings"))
    add("I07_I08_retry_cap", lambda s, d: s.read.parquet(f"{d}/events.parquet").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("failures")).select("user_id", F.when(col("failures") <= 2, "PROCESSING").otherwise("FAILED").alias("status")),
        "SELECT user_id, CASE WHEN count(*) <= 2 THEN 'PROCESSING' ELSE 'FAILED' END AS status FROM events WHERE event_type = 'error' GROUP BY 1")
    add("L06_L09_lookups", lambda s, d: s.read.parquet(f"{d}/region.parquet").join(s.read.parquet(f"{d}/nation.parquet").filter("n_nationkey < 10"), col("r_regionkey") == col("n_regionkey"), "left_semi").select("r_regionkey", "r_name"),
        "SELECT r_regionkey, r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 10)")
    add("F17_latest_completed", lambda s, d: s.read.parquet(f"{d}/orders.parquet").groupBy("o_orderstatus").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest")), "SELECT o_orderstatus, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS latest FROM orders GROUP BY 1")
    add("C20_rank_order", lambda s, d: postings(s, d).select("id", F.row_number().over(Window.partitionBy("company").orderBy(F.when(col("p_size") > 5, col("p_size")).otherwise(99), "id")).alias("place")), with_postings("SELECT id, row_number() OVER (PARTITION BY company ORDER BY CASE WHEN p_size > 5 THEN p_size ELSE 99 END, id) AS place FROM postings"))
