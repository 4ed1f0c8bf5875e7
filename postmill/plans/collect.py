"""The collection plan and its parts: normalise, deduplicate, filter, canonicalise, score, budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import policy, text
from postmill.operators import dedup, filters, joins, ranking, scoring
from postmill.operators.sinks import spill
from postmill.plans.functions_queries import _company, _sp, _url, roles_of
from postmill.sources.fixtures import REF, postings, with_postings

SEED = {"roles": ["백엔드", "data engineer"], "companies": ["brand#1"], "skills": ["java", "sql", "spark", "python", "react"],
        "industries": ["widget"], "locations": ["서울"], "experience_levels": ["신입"], "employment_types": ["정규직"]}


def ref_date():
    return F.lit(REF).cast("date")


def raw_records(spark: SparkSession, d: str) -> DataFrame:
    """Postings as two sources report them: the second repeats every third record with gaps filled or opened."""
    p = postings(spark, d)
    again = p.filter("id % 3 = 0").select(
        *[c for c in p.columns if c not in ("seq", "source", "location", "description", "skills_json")],
        (F.col("seq") + 1_000_000_000).alias("seq"), F.lit("mirror").alias("source"), F.lit("세종").alias("location"),
        F.when(F.col("id") % 2 == 0, F.col("title")).alias("description"), F.lit('["Kafka","SQL"]').alias("skills_json"),
    )
    return p.unionByName(again)


RAW_SQL = """raw AS (SELECT id, seq, company, title, roles_json, skills_json, experience_level, employment_type, location, source, url, description, deadline, published, collected FROM postings
  UNION ALL SELECT id, seq + 1000000000, company, title, roles_json, '["Kafka","SQL"]', experience_level, employment_type, '세종', 'mirror', url,
    CASE WHEN id % 2 = 0 THEN title END, deadline, published, collected FROM postings WHERE id % 3 = 0)"""


def normalize(raw: DataFrame) -> DataFrame:
    """K01: cleaned fields, identity keys and lists."""
    col, empty = F.col, F.array().cast("array<string>")
    listed = lambda c: F.coalesce(text.clean_list(roles_of(col(c))), empty)
    company, title = text.normalize_company(col("company")), text.normalize_title(col("title"))
    return raw.select(
        "id", "seq", "source", "url", text.collapse(col("company")).alias("company"), text.collapse(col("title")).alias("title"),
        listed("roles_json").alias("roles"), listed("skills_json").alias("skills"),
        text.clean(col("description")).alias("description"), text.clean(col("location")).alias("location"), "experience_level", "employment_type",
        "deadline", "published", "collected",
        text.source_record_key(col("source"), F.lit(None).cast("string"), col("url")).alias("record_key"),
        text.canonical_fingerprint(company, title, col("deadline")).alias("fingerprint"),
    )


HEAD = ["id", "source", "url", "company", "title", "record_key", "fingerprint"]
SCALARS = ["description", "location", "experience_level", "employment_type", "deadline", "published"]
LISTS = ["roles", "skills"]


def source_dedup(df: DataFrame) -> DataFrame:
    return dedup.merge_clusters(df, F.coalesce(F.nullif("record_key", F.lit("")), "url"), HEAD, SCALARS, LISTS)


def cross_dedup(df: DataFrame) -> DataFrame:
    return dedup.merge_clusters(df, F.col("fingerprint"), HEAD, SCALARS, LISTS)


def collect_daily(spark: SparkSession, d: str, limit: int = 500) -> DataFrame:
    """K25: two dedup passes around the date filter, scored, best ``limit`` rows in stable order."""
    rows = source_dedup(normalize(raw_records(spark, d))).drop("source_refs", "n_merged")
    rows = filters.removal_reason(rows, ref_date()).filter("removed IS NULL")
    merged = cross_dedup(rows)
    s = scoring.collection_score(SEED, {c: F.col(c) for c in ("title", "roles", "company", "skills", "description", "location", "experience_level", "employment_type")})
    best = ranking.top_by(merged.withColumn("score", s), limit, F.col("score").desc(), F.col("seq"))
    return best.select("id", "seq", "source", "company", "score", "location", F.array_join("skills", "|").alias("skills"), "n_merged")


_ARR = "coalesce(list_transform(from_json({c}, '[\"VARCHAR\"]'), lambda x: trim(x)), CAST([] AS VARCHAR[]))"
NORM_SQL = f"""norm AS (SELECT id, seq, source, url, {_sp('company')} AS company, {_sp('title')} AS title, {_ARR.format(c='roles_json')} AS roles, {_ARR.format(c='skills_json')} AS skills,
    nullif({_sp('description')}, '') AS description, location, experience_level, employment_type, deadline, published,
    sha256(source || '|' || {_url('url')}) AS record_key,
    sha256({_company('company')} || '|' || lower({_sp('title')}) || '|' || coalesce(CAST(deadline AS VARCHAR), '')) AS fingerprint FROM raw)"""


def _merge_sql(name: str, source: str, key: str) -> str:
    firsts = ", ".join(f"arg_min({c}, seq) AS {c}" for c in SCALARS)  # skips nulls, as wanted
    heads = ", ".join(f"arg_min({c}, seq) AS {c}" for c in HEAD)
    union = lambda c: (
        f"(SELECT coalesce(list(v ORDER BY o), CAST([] AS VARCHAR[])) FROM (SELECT v, min(o) AS o FROM (SELECT unnest(flat_{c}) AS v, generate_subscripts(flat_{c}, 1) AS o) GROUP BY v))"
    )
    flats = ", ".join(f"flatten(list({c} ORDER BY seq)) AS flat_{c}" for c in LISTS)
    return f"""{name}_g AS (SELECT min(seq) AS seq, {heads}, {firsts}, {flats}, count(*) AS n_merged FROM {source} GROUP BY {key}),
  {name} AS (SELECT * EXCLUDE (flat_roles, flat_skills), {union('roles')} AS roles, {union('skills')} AS skills FROM {name}_g)"""


_KEEP = f"NOT coalesce(deadline < DATE '{REF}', false) AND NOT (coalesce(published < DATE '{REF}' - 7, false) AND NOT coalesce(deadline <= DATE '{REF}' + 14, false))"


def _score_sql() -> str:
    n = lambda words, f: " + ".join(f"CASE WHEN {f(w)} THEN 1 ELSE 0 END" for w in words)
    has = lambda c, w: f"len(list_filter({c}, lambda x: contains(lower(x), '{w}'))) > 0"
    low = lambda c, w: f"contains(lower(coalesce({c}, '')), '{w}')"
    return f"""round(3.0::DOUBLE * ({n(SEED['roles'], lambda w: f"{low('title', w)} OR {has('roles', w)}")}) + 2.0::DOUBLE * ({n(SEED['companies'], lambda w: low('company', w))})
      + least(0.5::DOUBLE * ({n(SEED['skills'], lambda w: has('skills', w))}), 2.0::DOUBLE) + 0.3::DOUBLE * ({n(SEED['industries'], lambda w: low('description', w))})
      + 0.2::DOUBLE * ({n(SEED['locations'], lambda w: low('location', w))}) + 0.15::DOUBLE * ({n(SEED['experience_levels'], lambda w: low('experience_level', w))})
      + 0.1::DOUBLE * ({n(SEED['employment_types'], lambda w: low('employment_type', w))}) + CASE WHEN coalesce(description, '') <> '' THEN 0.3::DOUBLE ELSE 0 END, 6)"""


COLLECT_SQL = f", {RAW_SQL}, {NORM_SQL}, {_merge_sql('once', 'norm', 'record_key')}, open AS (SELECT * FROM once WHERE {_KEEP}), {_merge_sql('merged', 'open', 'fingerprint')}"


def register(add) -> None:
    col = F.col
    add("K25_collect_daily", collect_daily,
        with_postings(f"{COLLECT_SQL} SELECT id, seq, source, company, {_score_sql()} AS score, location, array_to_string(skills, '|') AS skills, n_merged FROM merged ORDER BY score DESC, seq LIMIT 500"))
    add("K01_normalize", lambda spark, d: normalize(raw_records(spark, d)).select("id", "seq", "company", "title", "description", "record_key", "fingerprint", F.size("skills").alias("n_skills")),
        with_postings(f", {RAW_SQL}, {NORM_SQL} SELECT id, seq, company, title, description, record_key, fingerprint, len(skills) AS n_skills FROM norm"))
    for name, fn, key in (("E01_E03_source_dedup", source_dedup, "record_key"), ("E02_E04_cross_dedup", cross_dedup, "fingerprint")):
        add(name, lambda spark, d, f=fn: f(normalize(raw_records(spark, d))).select("id", "seq", "source", "location", "description", F.array_join("skills", "|").alias("skills"), F.array_join("roles", "|").alias("roles"), "n_merged"),
            with_postings(f", {RAW_SQL}, {NORM_SQL}, {_merge_sql('m', 'norm', key)} SELECT id, seq, source, location, description, array_to_string(skills, '|') AS skills, array_to_string(roles, '|') AS roles, n_merged FROM m"))

    def flagged(spark, d):
        """Rows after the first dedup, with how many they merged and why they go: written once, so that counters need no second pass over the raw rows."""
        once = source_dedup(normalize(raw_records(spark, d))).drop("source_refs")
        return spill(filters.removal_reason(once, ref_date()), "flagged")

    def stats(spark, d):
        rows = flagged(spark, d)
        merged = cross_dedup(rows.filter("removed IS NULL").drop("n_merged"))
        before = rows.agg(F.sum("n_merged").alias("collected"), F.count("*").alias("after_source"), F.count_if(col("removed") == "expired").alias("expired"), F.count_if(col("removed") == "stale").alias("stale"))
        names = before.columns
        counts = before.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.coalesce(col(c), F.lit(0)).alias("n")) for c in names])).alias("m")).select("m.*")
        return counts.unionByName(merged.agg(F.count("*").alias("n")).select(F.lit("after_cross").alias("metric"), "n"))

    add("E13_C03_stats_per_source", lambda spark, d: flagged(spark, d).groupBy("source").agg(F.sum("n_merged").alias("collected"), F.count("*").alias("after_source"), F.count_if(col("removed") == "expired").alias("expired"), F.count_if(col("removed") == "stale").alias("stale")),
        with_postings(f"""{COLLECT_SQL} SELECT source, sum(n_merged) AS collected, count(*) AS after_source, count(*) FILTER (WHERE coalesce(deadline < DATE '{REF}', false)) AS expired,
          count(*) FILTER (WHERE NOT coalesce(deadline < DATE '{REF}', false) AND NOT ({_KEEP})) AS stale FROM once GROUP BY 1"""))
    add("E05_E13_C03_collection_stats", stats,
        with_postings(f"""{COLLECT_SQL} SELECT 'collected' AS metric, count(*) AS n FROM norm UNION ALL SELECT 'after_source', count(*) FROM once
          UNION ALL SELECT 'expired', count(*) FROM once WHERE coalesce(deadline < DATE '{REF}', false)
          UNION ALL SELECT 'stale', count(*) FROM once WHERE NOT coalesce(deadline < DATE '{REF}', false) AND NOT ({_KEEP}) UNION ALL SELECT 'after_cross', count(*) FROM merged"""))
    add("C02_C04_C08_C09_C10_flags", lambda spark, d: filters.removal_reason(postings(spark, d), ref_date()).select("id", "removed",
            filters.is_new(col("published"), col("collected"), ref_date()).alias("is_new"), filters.is_urgent(col("deadline"), ref_date()).alias("is_urgent"),
            policy.is_official(col("source")).alias("official"), filters.missing_required(col("title"), col("location")).alias("missing")),
        with_postings(f"""SELECT id, CASE WHEN coalesce(deadline < DATE '{REF}', false) THEN 'expired' WHEN NOT ({_KEEP}) THEN 'stale' END AS removed,
          coalesce(coalesce(published, collected) >= DATE '{REF}' - 3, false) AS is_new, coalesce(date_diff('day', DATE '{REF}', deadline) BETWEEN 0 AND 7, false) AS is_urgent,
          lower(source) NOT IN ('jasoseol', 'saramin', 'fixture') AS official, coalesce(trim(location), '') = '' OR coalesce(trim(title), '') = '' AS missing FROM postings"""))
    add("K02_K03_collection_scores", lambda spark, d: normalize(raw_records(spark, d)).select("seq", scoring.collection_score(SEED, {c: col(c) for c in ("title", "roles", "company", "skills", "description", "location", "experience_level", "employment_type")}).alias("score")),
        with_postings(f", {RAW_SQL}, {NORM_SQL} SELECT seq, {_score_sql()} AS score FROM norm"))
    add("F03_F04_interleave", lambda spark, d: ranking.interleave(postings(spark, d)).select("id", "source", "round", "group_first"),
        with_postings("SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY seq) AS round, min(seq) OVER (PARTITION BY source) AS group_first FROM postings"))

    def budget(spark, d):
        p = postings(spark, d).select("id", F.when(col("id") % 5 == 0, "EXPLORATION").otherwise("TARGETED").alias("pool"))
        return ranking.fetch_budget(ranking.first_of_pools(p, 150, col("id").desc()), 150)

    add("F05_E06_fetch_budget", budget,
        with_postings("""SELECT id, pool, pool_order FROM (SELECT *, count(*) FILTER (WHERE pool = 'TARGETED') OVER () AS t, count(*) FILTER (WHERE pool = 'EXPLORATION') OVER () AS e,
          row_number() OVER (PARTITION BY pool ORDER BY id DESC) AS pool_order FROM (SELECT id, CASE WHEN id % 5 = 0 THEN 'EXPLORATION' ELSE 'TARGETED' END AS pool FROM postings) q) z
          WHERE pool_order <= CASE WHEN pool = 'EXPLORATION' THEN least(30, e) + least(150 - least(120, t) - least(30, e), e - least(30, e))
            ELSE least(120, t) + least(150 - least(120, t) - (least(30, e) + least(150 - least(120, t) - least(30, e), e - least(30, e))), t - least(120, t)) END"""))
    add("F06_F07_explore_select", lambda spark, d: ranking.explore_select(postings(spark, d).withColumn("score", col("id") * 7 % 23).select("id", "seq", "published", "score"), 40).select("id", "score", "slot"),
        with_postings("""SELECT id, score, slot FROM (WITH p AS (SELECT id, seq, published, id * 7 % 23 AS score FROM postings), b AS (SELECT * FROM p ORDER BY score DESC, published DESC NULLS LAST, seq LIMIT 32)
          SELECT id, score, 'relevance' AS slot FROM b UNION ALL SELECT * FROM (SELECT id, score, 'exploration' FROM p WHERE id NOT IN (SELECT id FROM b) ORDER BY published DESC NULLS LAST, seq LIMIT 8)) q"""))
    add("F08_F15_budget_batches", lambda spark, d: ranking.split_batches(ranking.top_by(postings(spark, d), 100, col("deadline").asc_nulls_last(), col("id")), 5, col("id"), "source").select("id", "source", col("batch").cast("long").alias("batch")),
        with_postings("SELECT id, source, (row_number() OVER (PARTITION BY source ORDER BY id) - 1) // 5 AS batch FROM (SELECT * FROM postings ORDER BY deadline ASC NULLS LAST, id LIMIT 100) q"))
    add("E06_merge_candidates", lambda spark, d: dedup.merge_candidates(postings(spark, d).select(F.when(col("id") % 2 == 0, col("id")).otherwise(-col("id")).alias("id"), "seq"), postings(spark, d).select(F.when(col("id") % 3 == 0, col("id")).otherwise(col("id") + 1_000_000_000_000).alias("id"), "seq", col("published").alias("lastmod"))).select("id", "provenance", "lastmod"),
        with_postings("SELECT id, CASE WHEN id % 6 = 0 THEN 'BOTH' WHEN id % 2 = 0 THEN 'TARGETED' ELSE 'EXPLORATION' END AS provenance, CASE WHEN id % 3 = 0 THEN published END AS lastmod FROM postings WHERE id % 2 = 0 OR id % 3 = 0 UNION ALL SELECT -id, 'TARGETED', NULL FROM postings WHERE id % 2 = 1 UNION ALL SELECT id + 1000000000000, 'EXPLORATION', published FROM postings WHERE id % 3 > 0"))

    def canon(spark, d):
        s = spark.read.parquet(f"{d}/supplier.parquet")
        profiles = s.select(F.col("s_suppkey").alias("profile_seq"), "s_name", F.concat(F.lit("Group "), (col("s_suppkey") % 10).cast("string")).alias("canonical_name"),
                            text.normalize_company(F.concat(F.lit("Group "), (col("s_suppkey") % 10).cast("string"))).alias("key_canonical"), text.normalize_company(col("s_name")).alias("key_normalized"))
        named = s.select("s_suppkey", F.concat(F.upper("s_name"), F.lit(" Inc.")).alias("name"))
        return joins.canonicalize(named, text.normalize_company(col("name")), profiles).select("s_suppkey", "canonical")

    add("D10_H03_canonicalize", canon, "SELECT s_suppkey, 'Group ' || CAST(s_suppkey % 10 AS VARCHAR) AS canonical FROM supplier")
