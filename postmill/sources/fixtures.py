"""Posting-shaped input over the test tables.

The SQL is plain enough for Spark and DuckDB alike; it only makes input rows, no operator logic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REF = "2001-08-01"


def _case(column: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values))
    return f"CASE {column} % {len(values)} {arms} END"


POSTINGS_SQL = f"""
SELECT p_partkey AS id, p_partkey AS seq, p_brand AS company, p_size, p_type, p_name,
  {_case("p_partkey", ["'백엔드 개발자 (Java)'", "'Backend Engineer'", "'프론트엔드 개발자'", "'Data Engineer'",
    "'ML Engineer 신입'", "'DevOps Engineer'", "'Android 개발자'", "'마케팅 인턴'", "'풀스택 개발자 신입/경력'",
    "'서비스 기획 경력'", "'  Platform   Backend Developer '", "'Open Recruitment 2001 공채'"])} AS title,
  {_case("(p_partkey + p_size)", ["'[\"백엔드\"]'", "'[\"프론트엔드\",\"풀스택\"]'", "NULL", "'[]'", "'[\"데이터 엔지니어\"]'"])} AS roles_json,
  {_case("(p_partkey + 2 * p_size)", ["'[\"Java\",\"Spring\"]'", "'[\"JavaScript\",\"React\"]'", "'[\"Python\",\"Spark\",\"SQL\"]'", "NULL"])} AS skills_json,
  {_case("(p_partkey + 3 * p_size)", ["'신입'", "'3년 이상'", "'1년 이상'", "'0~1년'", "'신입/경력'", "'경력무관'", "NULL", "'경력'", "'3년 이하'", "'2~4년'", "'junior'"])} AS experience_level,
  {_case("(p_partkey + p_size)", ["'정규직'", "'인턴'", "NULL", "'계약직'"])} AS employment_type,
  {_case("p_partkey", ["'서울'", "'판교'", "NULL", "'부산'", "'서울 강남'"])} AS location,
  {_case("p_partkey", ["'naver'", "'jasoseol'", "'Saramin'", "'greenhouse'"])} AS source,
  {_case("p_partkey", ["'HTTPS://Jobs.Example.COM:8443/p/' || CAST(p_partkey % 50 AS VARCHAR(20)) || '/?ref=a#x'",
    "'https://jobs.example.com/p/' || CAST(p_partkey AS VARCHAR(20))", "'http://Careers.Example.org'"])} AS url,
  {_case("p_partkey", ["NULL", "'  자격: 5년 이상 경력 필수' || chr(10) || chr(10) || chr(10) || p_name", "'Spring  and SQL,	2년 이상 우대 ' || p_name",
    "'우대: React. 마감 2001년 8월 ' || CAST(p_size AS VARCHAR(20)) || '일, 문의 2001년 13월 1일'"])} AS description,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE DATE '{REF}' + CAST(p_size - 10 AS INT) END AS deadline,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE DATE '{REF}' - CAST(p_partkey % 30 AS INT) END AS published,
  DATE '{REF}' - CAST(p_partkey % 5 AS INT) AS collected,
  {_case("ascii(substr(p_brand, 8, 1))", ["'IT, FIN'", "'GAME'", "NULL", "'fin'"])} AS industry_codes,
  {_case("ascii(substr(p_brand, 7, 1))", ["'LARGE'", "'Startup'", "NULL"])} AS company_size
FROM part
"""

#: The label column of `labels` widened to an enrichment row; only some postings have one.
ANALYSES_SQL = f"""
SELECT id AS posting_id,
  {_case("id", ["'SUCCEEDED'", "'FALLBACK'", "'PENDING'", "'FAILED'", "'SUCCEEDED'"])} AS status,
  {_case("(id + p_size)", ["'IT'", "'IT'", "'NON_IT'", "'UNKNOWN'", "'IT'", "'IT'"])} AS job_domain,
  {_case("(id + p_size)", ["'BACKEND'", "'FRONTEND,DATA'", "''", "'GENERAL_IT'", "'AI_ML'", "'FULLSTACK'", "'DEVOPS_INFRA'"])} AS role_groups,
  {_case("id", ["'ROLE_SPECIFIC'", "'OPEN_RECRUITMENT'", "NULL"])} AS scope,
  {_case("(id + p_size)", ["'NEW_GRAD_HIRE'", "'OPEN_HIRE'", "'EXPERIENCED_HIRE'", "NULL"])} AS recruitment_type,
  CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS accepts_new_grad,
  CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(p_size % 4 AS INT) END AS min_years,
  {_case("(id + 2 * p_size)", ["'NONE'", "'REQUIRED'", "'PREFERRED'", "'UNKNOWN'"])} AS requirement,
  CASE WHEN id % 3 = 2 THEN 0 ELSE CAST((id + p_size) % 3 AS INT) END AS n_tracks,
  {_case("(id + 3 * p_size)", ["'GENERAL_IT'", "'BACKEND,DATA'", "'MOBILE'", "'NON_DEV'", "'FULLSTACK'"])} AS t2_groups,
  CASE (id + p_size) % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS t2_accepts,
  CASE WHEN id % 7 = 0 THEN NULL ELSE CAST((p_size + 1) % 3 AS INT) END AS t2_min,
  {_case("(id + p_size)", ["'REQUIRED'", "'NONE'", "'UNKNOWN'", "'PREFERRED'"])} AS t2_requirement,
  (id + p_size) % 11 = 0 AS t2_unknown
FROM postings WHERE id % 4 <> 3
"""

#: One user per market segment and nation: a dimension-sized table.
USERS_SQL = f"""
SELECT user_id, segment, nation,
  CASE segment WHEN 'AUTOMOBILE' THEN '백엔드' WHEN 'BUILDING' THEN 'frontend' WHEN 'FURNITURE' THEN '데이터 엔지니어,ML Engineer'
       WHEN 'MACHINERY' THEN '풀스택,정원사' ELSE '' END AS roles,
  {_case("nation", ["'신입'", "'경력'", "''", "'junior'"])} AS experience_levels,
  {_case("nation", ["'Java,SQL'", "'React'", "'Spark,Python,Go'"])} AS skills,
  {_case("nation", ["'Brand#1'", "'brand#22,Nobody'", "''"])} AS companies,
  {_case("nation", ["'서울'", "''", "'부산,판교'"])} AS locations,
  {_case("nation", ["'정규직'", "''"])} AS employment_types,
  {_case("nation", ["'FIN'", "''", "'game,edu'"])} AS industries,
  {_case("nation", ["''", "'startup'", "'LARGE'", "'MEDIUM,Large'"])} AS company_sizes
FROM (SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation,
        c_nationkey * 10 + ascii(c_mktsegment) % 10 AS user_id FROM customer) u
"""


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run ``sql`` over parquet tables, bound by name without touching the catalog's names."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    bound = sql
    for t in tables:
        bound = bound.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(bound, **frames)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, POSTINGS_SQL, "part")


def analyses(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """The analyses of all postings, or of the postings ``of``."""
    return spark.sql(ANALYSES_SQL.replace("FROM postings", "FROM {postings}"), postings=postings(spark, sf_dir) if of is None else of)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, USERS_SQL, "customer")


def with_postings(sql: str) -> str:
    """Oracle SQL with the fixture tables in front."""
    return f"WITH postings AS ({POSTINGS_SQL}), analyses AS ({ANALYSES_SQL}), users AS ({USERS_SQL}) {sql}"
