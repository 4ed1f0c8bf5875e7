"""The recommendation plan: eligibility, filters, scores, exposure penalty, constrained top-k; all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import dates, policy, text
from postmill.operators import filters, ranking, scoring
from postmill.operators.sinks import scratch_path, spill, spread
from postmill.plans.functions_queries import (
    PRIMARY, _category, _groups, _host_url, csv, user_profiles, users_roles_sql,
)
from postmill.sources.fixtures import REF, analyses, postings, users, with_postings

LOOKBACK_DAYS = 7


def ref_date():
    return F.lit(REF).cast("date")


def eligible_pool(post: DataFrame, sources: DataFrame, ref) -> DataFrame:
    """Postings with an active source and an open or unknown deadline: a left semi join, no distinct."""
    open_ = post.filter(F.col("deadline").isNull() | (F.col("deadline") >= ref))
    active = sources.filter("active AND coalesce(lower(source) NOT IN ('fixture'), true)").select("posting_id")
    return open_.join(active, F.col("id") == F.col("posting_id"), "left_semi")


def provenance(spark: SparkSession, d: str) -> DataFrame:
    """(posting_id, source, active): which suppliers offer a part."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct()
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_partkey").alias("posting_id"), F.col("s_name").alias("source"), (F.col("s_acctbal") >= 0).alias("active")
    )


def exposures(spark: SparkSession, d: str, by_url: DataFrame) -> DataFrame:
    """(user_id, canonical, last_exposed) within the lookback: a maximum per item, then per canonical address."""
    ref = ref_date()
    o = spark.read.parquet(f"{d}/orders.parquet").filter(F.col("o_orderdate") >= F.date_sub(ref, LOOKBACK_DAYS).cast("timestamp_ntz"))
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey")
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", (F.col("c_nationkey") * 10 + F.ascii("c_mktsegment") % 10).alias("user_id"))
    per_item = (
        o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("user_id", "l_partkey")
        .agg(F.max("o_orderdate").cast("date").alias("last_exposed"))
    )
    return (
        per_item.join(by_url.select("id", "canonical"), F.col("l_partkey") == F.col("id"))
        .groupBy("user_id", "canonical")
        .agg(F.max("last_exposed").alias("last_exposed"))
    )


def facts(post: DataFrame, ana: DataFrame) -> DataFrame:
    """Per posting, everything that doesn't depend on the user, computed once before users are joined."""
    ref, col = ref_date(), F.col
    track = lambda no, groups, accepts, years, requirement, unknown: F.struct(
        F.lit(no).alias("no"), csv(col(groups)).alias("groups"), col(accepts).alias("accepts"), col(years).alias("min_years"),
        col(requirement).alias("requirement"), col("recruitment_type").alias("recruitment"), unknown.alias("unknown"),
    )
    both = F.array(
        track(0, "role_groups", "accepts_new_grad", "min_years", "requirement", F.lit(False)),
        track(1, "t2_groups", "t2_accepts", "t2_min", "t2_requirement", col("t2_unknown")),
    )
    a = ana.select(F.col("posting_id"), "status", "job_domain", csv(F.col("role_groups")).alias("a_groups"), "scope", "recruitment_type",
                   "accepts_new_grad", "min_years", "requirement", F.slice(both, 1, col("n_tracks")).alias("tracks"))
    p = post.select(
        "id", "company", "title", "deadline", "location", "employment_type", "skills_json", "experience_level",
        F.coalesce("published", "collected").alias("first_seen"),
        text.canonical_host_url(col("url")).alias("canonical"),
        policy.role_groups(text.primary_text(col("title"), col("roles_json"))).alias("groups"),
        policy.parse_experience(col("experience_level"))["category"].alias("level_category"),
        F.when(F.coalesce(F.trim("experience_level"), F.lit("")) == "", policy.experience_from_title(col("title")))
        .otherwise(policy.parse_experience(col("experience_level"))["category"]).alias("filter_category"),
        policy.is_official(col("source")).alias("official"),
        csv(F.coalesce("industry_codes", F.lit(""))).alias("industry_list"),
        "company_size",
        filters.missing_required(col("title"), col("company"), col("url")).alias("missing"),
        filters.is_expired(col("deadline"), ref).alias("expired"),
        filters.is_new(col("published"), col("collected"), ref).alias("is_new"),
        filters.is_urgent(col("deadline"), ref).alias("is_urgent"),
    )
    return p.join(a, F.col("id") == F.col("posting_id"), "left").drop("posting_id")


def profiles(user: DataFrame) -> DataFrame:
    """Users with their preferences as lists and what follows from them."""
    lists = ("skills", "companies", "locations", "employment_types", "industries", "company_sizes")
    u = user_profiles(user)
    return u.select("user_id", "acceptable", "level_list", "level_categories", "new_grad", *[csv(F.col(c)).alias(f"u_{c}") for c in lists])


SHOWN = ("id", "company", "title", "deadline", "first_seen", "canonical", "is_new", "is_urgent")


def verdicts(pairs: DataFrame, shown: tuple[str, ...] = SHOWN) -> DataFrame:
    """Pairs of facts and profiles with both filter reasons and scores, and the columns ``shown``."""
    col = F.col
    role = policy.role_verdict(col("acceptable"), col("groups"))
    filter_exp = policy.experience_verdict(col("level_list"), col("level_categories"), col("filter_category"))
    score_exp = policy.experience_verdict(col("level_list"), col("level_categories"), col("level_category"))
    wanted = col("u_employment_types")
    mismatch = (F.size(wanted) > 0) & (F.coalesce("employment_type", F.lit("")) != "") & ~F.exists(wanted, lambda x: F.lower(x) == F.lower(col("employment_type")))
    prefs = {k: col(f"u_{k}") for k in ("skills", "companies", "locations", "employment_types", "industries", "company_sizes")}
    keyword = scoring.keyword_score(role, prefs, col("company"), col("skills_json"), score_exp, col("location"), col("employment_type"), col("industry_list"),
                                    col("company_size"), col("official"))
    exp = policy.experience_match(col("accepts_new_grad"), col("min_years"), col("requirement"), col("recruitment_type"), col("new_grad"))
    single = scoring.single_role_match(col("a_groups"), col("acceptable"), exp)
    multi = scoring.multi_role_match(col("tracks"), col("acceptable"), col("new_grad"), policy.experience_match, scoring.IT_GROUPS)
    rows = pairs.withColumn("single", single).withColumn("multi", multi)
    rows = rows.withColumn("match", scoring.classification_match(col("single"), col("multi"), col("status"), col("job_domain"), col("scope"), col("tracks")))
    m = col("match")
    classed = scoring.classified_score(keyword, m, col("scope"), col("recruitment_type"), col("new_grad"))
    reason = filters.recommendation_reason(col("missing"), col("expired"), role, filter_exp, mismatch)
    return rows.select(
        "user_id", *shown, "match",
        reason.alias("keyword_reason"),
        filters.classified_reason(reason, col("missing"), col("expired"), m, mismatch).alias("class_reason"),
        scoring.total(keyword).alias("keyword_score"),
        scoring.total(classed).alias("class_score"),
        F.struct(*[v.alias(k) for k, v in keyword.items()]).alias("parts"),
    )


_ANALYSIS = ("status", "job_domain", "a_groups", "scope", "recruitment_type", "accepts_new_grad", "min_years", "requirement", "tracks")
#: What a verdict hangs on, by facet: columns of the posting and of the user.
FACETS = {
    "role": (("groups",), ("acceptable",)), "filter_exp": (("filter_category",), ("level_list", "level_categories")), "score_exp": (("level_category",), ("level_list", "level_categories")),
    "analysis": (_ANALYSIS, ("acceptable", "new_grad")), "company": (("company",), ("u_companies",)), "skill": (("skills_json",), ("u_skills",)), "industry": (("industry_list",), ("u_industries",)),
    "location": (("location",), ("u_locations",)), "employment": (("employment_type",), ("u_employment_types",)), "company_size": (("company_size",), ("u_company_sizes",)),
}


def with_facets(rows: DataFrame, side: int) -> DataFrame:
    """``rows`` with an id per facet (64-bit hashes of its values): ``f_`` of postings (side 0), ``p_`` of users (side 1)."""
    return rows.withColumns({f"{'fp'[side]}_{name}": F.xxhash64(F.to_json(F.struct(*columns[side]))) for name, columns in FACETS.items()})


def facet_values(fact: DataFrame, user: DataFrame) -> DataFrame:
    """Verdict, points, flag and match of each facet for each pair of values that postings and users have, written once by facet.

    ``fact`` and ``user`` have their facet ids. The products are of distinct values, not of rows.
    """
    col = F.col
    exp = policy.experience_match(col("accepts_new_grad"), col("min_years"), col("requirement"), col("recruitment_type"), col("new_grad"))
    multi = scoring.multi_role_match(col("tracks"), col("acceptable"), col("new_grad"), policy.experience_match, scoring.IT_GROUPS)
    match = scoring.classification_match(scoring.single_role_match(col("a_groups"), col("acceptable"), exp), multi, col("status"), col("job_domain"), col("scope"), col("tracks"))
    prefs = {k: col(f"u_{k}") for k in ("skills", "companies", "locations", "employment_types", "industries", "company_sizes")}
    parts = scoring.keyword_score(F.lit(""), prefs, col("company"), col("skills_json"), F.lit(""), col("location"), col("employment_type"), col("industry_list"), col("company_size"), F.lit(False))
    wanted = col("u_employment_types")
    mismatch = (F.size(wanted) > 0) & (F.coalesce("employment_type", F.lit("")) != "") & ~F.exists(wanted, lambda x: F.lower(x) == F.lower(col("employment_type")))
    verdict = {"role": policy.role_verdict(col("acceptable"), col("groups"))} | {
        k: policy.experience_verdict(col("level_list"), col("level_categories"), col(c)) for k, c in (("filter_exp", "filter_category"), ("score_exp", "level_category"))
    }
    shape = "struct<deferred:boolean,non_it:boolean,eligible:boolean,role:string,experience:string>"
    tables = None
    for name, (of_fact, of_user) in FACETS.items():
        left = fact.select(col(f"f_{name}").alias("f_id"), *of_fact).dropDuplicates(["f_id"])
        right = user.select(col(f"p_{name}").alias("p_id"), *of_user).dropDuplicates(["p_id"])
        table = spread(left, "f_id").crossJoin(right).select(
            "f_id", "p_id", verdict.get(name, F.lit(None).cast("string")).alias("verdict"), (parts[name] if name in parts and name != "role" else F.lit(0)).cast("int").alias("points"),
            (mismatch if name == "employment" else F.lit(False)).alias("flag"), (match if name == "analysis" else F.lit(None)).cast(shape).alias("match"), F.lit(name).alias("facet"),
        )
        tables = table if tables is None else tables.unionByName(table)
    path = scratch_path(fact.sparkSession, "facets")
    tables.write.partitionBy("facet").parquet(path)
    return fact.sparkSession.read.schema(tables.schema).parquet(path)


def facet_verdicts(pairs: DataFrame, values: DataFrame, shown: tuple[str, ...] = SHOWN) -> DataFrame:
    """As :func:`verdicts`, for pairs with facet ids: each facet's value is looked up by an equi-join with a table of distinct values."""
    col = F.col
    for name in FACETS:
        table = values.filter(col("facet") == name).select(col("f_id").alias(f"f_{name}"), col("p_id").alias(f"p_{name}"), F.struct("verdict", "points", "flag", "match").alias(f"v_{name}"))
        pairs = pairs.join(table, [f"f_{name}", f"p_{name}"])
    role, m = col("v_role.verdict"), col("v_analysis.match")
    none = F.array().cast("array<string>")
    own = scoring.keyword_score(role, dict.fromkeys(("skills", "companies", "locations", "employment_types", "industries", "company_sizes"), none), F.lit(""), F.lit(""), col("v_score_exp.verdict"), F.lit(""), F.lit(""), none, F.lit(""), col("official"))
    keyword = {k: col(f"v_{k}.points") if k in FACETS and k != "role" else v for k, v in own.items()}
    classed = scoring.classified_score(keyword, m, col("scope"), col("recruitment_type"), col("new_grad"))
    reason = filters.recommendation_reason(col("missing"), col("expired"), role, col("v_filter_exp.verdict"), col("v_employment.flag"))
    return pairs.select(
        "user_id", *shown, m.alias("match"), reason.alias("keyword_reason"), filters.classified_reason(reason, col("missing"), col("expired"), m, col("v_employment.flag")).alias("class_reason"),
        scoring.total(keyword).alias("keyword_score"), scoring.total(classed).alias("class_score"), F.struct(*[v.alias(k) for k, v in keyword.items()]).alias("parts"),
    )


def class_verdicts(fact: DataFrame, user: DataFrame) -> DataFrame:
    """Verdicts of every user on every class of postings, with the number ``n`` of postings in it.

    For reports over all pairs: a pair is two rows of ids, and what it means is looked up by facet.
    """
    f, u = spill(with_facets(fact, 0), "facts"), spill(with_facets(profiles(user), 1), "profiles")
    own = ("missing", "expired", "official", "scope", "recruitment_type", *[f"f_{name}" for name in FACETS])
    classes = f.groupBy(*own).agg(F.count("*").alias("n"))
    pairs = spread(classes).crossJoin(u.select("user_id", "new_grad", *[f"p_{name}" for name in FACETS]))
    return facet_verdicts(pairs, facet_values(f, u), ("n",))


#: What of a posting and of a user the filter reasons depend on.
REASON_CLASS = ("missing", "expired", "groups", "filter_category", "employment_type", "status", "job_domain", "a_groups", "scope", "recruitment_type", "accepts_new_grad", "min_years", "requirement", "tracks")
REASON_PROFILE = ("acceptable", "level_list", "level_categories", "new_grad", "u_employment_types")


def reason_counts(fact: DataFrame, user: DataFrame, *by: tuple[str, Column]) -> DataFrame:
    """Per user and value of ``by`` (named columns over match, keyword_reason and class_reason): the number ``n`` of postings and of ``eligible`` ones.

    Verdicts are worked out per facet, once for each pair of distinct values: roles, levels and employment by keyword rules, and the analysis with the user's groups and level.
    Facts are counted per combination of facets, and the verdicts join them by facet and profile. A profile's users get its counts by an equi-join.
    """
    col = F.col
    facets = fact.groupBy(*REASON_CLASS).agg(F.count("*").alias("n"))
    analysis = ("status", "job_domain", "a_groups", "scope", "recruitment_type", "accepts_new_grad", "min_years", "requirement", "tracks")
    keyed = spill(facets.withColumn("k_id", F.xxhash64(*[F.to_json(F.struct(c)) for c in analysis])).withColumn("g_id", F.xxhash64(F.to_json(F.struct("groups")))), "facets")
    u = profiles(user).withColumn("p_id", F.xxhash64(*[F.to_json(F.struct(c)) for c in REASON_PROFILE])).withColumn("a_id", F.xxhash64(F.to_json(F.struct("acceptable", "new_grad"))))
    u = spill(u.select("user_id", "p_id", "a_id", *REASON_PROFILE), "reason-profiles")
    kinds = u.dropDuplicates(["p_id"]).drop("user_id")
    # the analysis for each distinct pair of (groups, new graduate) and analysis: the costly part, once
    exp = policy.experience_match(col("accepts_new_grad"), col("min_years"), col("requirement"), col("recruitment_type"), col("new_grad"))
    pairs = spread(keyed.dropDuplicates(["k_id"]).select("k_id", *analysis), "k_id").crossJoin(kinds.dropDuplicates(["a_id"]).select("a_id", "acceptable", "new_grad"))
    pairs = pairs.withColumn("single", scoring.single_role_match(col("a_groups"), col("acceptable"), exp)).withColumn("multi", scoring.multi_role_match(col("tracks"), col("acceptable"), col("new_grad"), policy.experience_match, scoring.IT_GROUPS))
    match = scoring.classification_match(col("single"), col("multi"), col("status"), col("job_domain"), col("scope"), col("tracks"))
    matches = spill(pairs.select("k_id", "a_id", match.alias("match")), "matches")
    # the other facets have few values and cheap verdicts
    slim = keyed.groupBy("k_id", "missing", "expired", "groups", "filter_category", "employment_type").agg(F.sum("n").alias("n"))
    joined = spread(slim, "k_id").join(matches, "k_id").join(kinds, "a_id")
    wanted = col("u_employment_types")
    mismatch = (F.size(wanted) > 0) & (F.coalesce("employment_type", F.lit("")) != "") & ~F.exists(wanted, lambda x: F.lower(x) == F.lower(col("employment_type")))
    reason = filters.recommendation_reason(col("missing"), col("expired"), policy.role_verdict(col("acceptable"), col("groups")), policy.experience_verdict(col("level_list"), col("level_categories"), col("filter_category")), mismatch)
    told = joined.withColumn("keyword_reason", reason).withColumn("class_reason", filters.classified_reason(reason, col("missing"), col("expired"), col("match"), mismatch))
    named = [c.alias(name) for name, c in by]
    counted = told.groupBy("p_id", *named).agg(F.sum("n").alias("n"), F.sum(F.when(col("match.eligible"), col("n")).otherwise(0)).alias("eligible"))
    return u.select("user_id", "p_id").join(counted, "p_id").drop("p_id")


#: How a classification mode filters and ranks: by keywords, or by the analysis.
MODES = {"ENFORCE": ("class_reason", "class_score"), "SHADOW": ("keyword_reason", "keyword_score"), "OFF": ("keyword_reason", "keyword_score")}


def group_keys(mode: str) -> Column:
    """The groups under which a fact can be found: its own, ``?`` if anyone takes it, and ``*`` for users without preference."""
    if mode != "ENFORCE":
        own = F.when(F.size("groups") > 0, F.col("groups")).otherwise(F.array(F.lit("?")))
    else:
        of_tracks = F.flatten(F.transform(F.coalesce("tracks", F.array().cast(scoring.TRACKS)), lambda t: t["groups"]))
        own = F.array_distinct(F.concat(F.coalesce("a_groups", F.array().cast("array<string>")), of_tracks))
    return F.concat(own, F.array(F.lit("*")))


def candidate_pairs(fact: DataFrame, user: DataFrame, mode: str) -> DataFrame:
    """Pairs that the mode's role rule can let pass: an equi-join of postings' groups with those users accept.

    What fails for every user goes before the join, and a pair that meets under several groups is kept under its first.
    """
    if mode == "ENFORCE":
        fact = fact.filter("NOT missing AND NOT expired AND status IN ('SUCCEEDED', 'FALLBACK') AND coalesce(job_domain, '') <> 'NON_IT'")
        wide = "GENERAL_IT"
    else:
        fact = fact.filter("NOT missing AND NOT expired")
        wide = "?"
    u = (user if "acceptable" in user.columns else profiles(user)).withColumn(
        "u_keys", F.when(F.size("acceptable") == 0, F.array(F.lit("*"))).otherwise(F.array_distinct(F.concat("acceptable", F.array(F.lit(wide)))))
    )
    f = spread(fact, "id").withColumn("keys", group_keys(mode))
    joined = f.withColumn("key", F.explode("keys")).join(u.withColumn("key", F.explode("u_keys")), "key")
    return joined.filter(F.col("key") == F.get(F.array_intersect("keys", "u_keys"), F.lit(0)))


def top_per_user(spark: SparkSession, d: str, mode: str = "ENFORCE") -> DataFrame:
    """K24: the flagship. ``mode`` chooses filter and score together; the default is that of production."""
    reason, score = MODES[mode]
    post = postings(spark, d)
    fact = spill(with_facets(facts(eligible_pool(post, provenance(spark, d), ref_date()), analyses(spark, d)), 0), "facts")
    user = spill(with_facets(profiles(users(spark, d)), 1), "profiles")
    rows = facet_verdicts(candidate_pairs(fact, user, mode), facet_values(fact, user)).filter(F.col(reason).isNull())
    seen = exposures(spark, d, post.select("id", text.canonical_host_url(F.col("url")).alias("canonical")))
    rows = rows.join(seen, ["user_id", "canonical"], "left")
    penalty = dates.exposure_penalty(F.datediff(ref_date(), F.col("last_exposed")))
    rows = rows.withColumn("penalty", penalty).withColumn("adjusted", F.col(score) - F.col("penalty"))
    return ranking.select_top(ranking.prune_for_top(rows)).select("user_id", "rank", "id", "company", "adjusted", "penalty", "is_new", "is_urgent")


_POOL = f"""src AS (SELECT DISTINCT l_partkey AS posting_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal >= 0),
  pool AS (SELECT p.* FROM postings p WHERE (deadline IS NULL OR deadline >= DATE '{REF}') AND id IN (SELECT posting_id FROM src))"""
_F = f"""fact AS (SELECT p.*, coalesce(published, collected) AS first_seen, {_host_url('url')} AS canonical, {_groups(PRIMARY)} AS groups,
    {_category('experience_level')} AS level_category,
    coalesce(coalesce(published, collected) >= DATE '{REF}' - 3, false) AS is_new,
    coalesce(deadline BETWEEN DATE '{REF}' AND DATE '{REF}' + 7, false) AS is_urgent,
    lower(source) NOT IN ('jasoseol', 'saramin', 'fixture') AS official,
    coalesce(deadline < DATE '{REF}', false) AS expired,
    a.status, a.job_domain, list_filter(string_split(a.role_groups, ','), lambda x: x <> '') AS a_groups, a.scope, a.recruitment_type,
    a.accepts_new_grad, a.min_years, a.requirement, a.n_tracks, list_filter(string_split(a.t2_groups, ','), lambda x: x <> '') AS t2_list, a.t2_accepts, a.t2_min,
    a.t2_requirement, a.t2_unknown
  FROM {{pool}} p LEFT JOIN analyses a ON a.posting_id = p.id)"""


def _csv(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, ','), lambda x: trim(x)), lambda x: x <> '')"


_VERDICT = """CASE WHEN {c} IN ('ENTRY', 'MIXED') THEN 'PASS_FULL' WHEN {c} = 'UNKNOWN' THEN 'PASS_PARTIAL' WHEN len(ls) = 0 THEN 'PASS_FULL'
  WHEN new_grad THEN CASE {c} WHEN 'NEW_GRAD' THEN 'PASS_FULL' WHEN 'JUNIOR' THEN 'PASS_PARTIAL' ELSE 'EXCLUDE' END
  WHEN len(list_filter(level_categories, lambda c: c = {c} OR c IN ('MIXED', 'UNKNOWN'))) > 0 THEN 'PASS_FULL' ELSE 'PASS_PARTIAL' END"""
_T = "replace(lower(trim(title)), ' ', '')"
_TITLE_LEVEL = f"CASE WHEN regexp_matches({_T}, '경력무관|경력불문|경력무방') THEN 'ENTRY' WHEN contains({_T}, '신입') AND contains({_T}, '경력') THEN 'MIXED' WHEN contains({_T}, '경력') THEN 'EXPERIENCED' ELSE 'UNKNOWN' END"
_ROLE = "CASE WHEN len(acceptable) = 0 THEN 'AMBIGUOUS' WHEN list_has_any(acceptable, groups) THEN 'MATCH' WHEN len(groups) = 0 THEN 'AMBIGUOUS' ELSE 'MISMATCH' END"
_IT = "['BACKEND', 'FRONTEND', 'FULLSTACK', 'DATA', 'AI_ML', 'MOBILE', 'DEVOPS_INFRA', 'GENERAL_IT', 'OTHER_IT']"


def _fit(accepts: str, years: str, requirement: str) -> str:
    return f"""CASE WHEN NOT new_grad THEN CASE WHEN {requirement} IN ('NONE', 'REQUIRED') THEN 'FULL' ELSE 'PARTIAL' END
      WHEN {accepts} = false THEN 'EXCLUDED' WHEN {requirement} = 'REQUIRED' AND {years} >= 1 THEN 'EXCLUDED' WHEN {requirement} = 'PREFERRED' THEN 'PARTIAL'
      WHEN {accepts} = true THEN 'FULL' WHEN {requirement} = 'NONE' THEN 'FULL' WHEN recruitment_type IN ('OPEN_HIRE', 'NEW_GRAD_HIRE') THEN 'FULL'
      WHEN {years} = 0 THEN 'FULL' ELSE 'PARTIAL' END"""


#: The rules restated over all pairs: keyword reason and score, analysis reason and score.
_S = f"""uu AS (SELECT u.*, x.rs, x.ls, x.acceptable, x.level_categories, x.new_grad, {_csv('u.skills')} AS u_skills, {_csv('u.companies')} AS u_companies,
    {_csv('u.locations')} AS u_locations, {_csv('u.employment_types')} AS u_employment, {_csv('u.industries')} AS u_industries, {_csv('u.company_sizes')} AS u_sizes
    FROM users u JOIN ({users_roles_sql()}) x USING (user_id)),
  v AS (SELECT fact.*, uu.user_id, uu.acceptable, uu.u_skills, uu.u_companies, uu.u_locations, uu.u_employment, uu.u_industries, uu.u_sizes, uu.new_grad, {_ROLE} AS rv,
    {_VERDICT.format(c='level_category')} AS score_exp,
    {_VERDICT.format(c=f"(CASE WHEN coalesce(trim(experience_level), '') = '' THEN {_TITLE_LEVEL} ELSE level_category END)")} AS filter_exp,
    len(u_employment) > 0 AND coalesce(employment_type, '') <> '' AND len(list_filter(u_employment, lambda x: lower(x) = lower(employment_type))) = 0 AS emp_bad,
    coalesce(status IN ('SUCCEEDED', 'FALLBACK'), false) AS done, len(acceptable) = 0 AS free,
    coalesce(n_tracks, 0) > 0 AND scope IS DISTINCT FROM 'ROLE_SPECIFIC' AS multi,
    {_fit('accepts_new_grad', 'min_years', 'requirement')} AS e1, {_fit('t2_accepts', 't2_min', 't2_requirement')} AS e2
    FROM fact, uu),
  w AS (SELECT *, done AND coalesce(job_domain = 'NON_IT', false) AS non_it, n_tracks > 1 AND NOT t2_unknown AS two,
    list_has_any(a_groups, CASE WHEN free THEN {_IT} ELSE acceptable END) AS d1, list_has_any(t2_list, CASE WHEN free THEN {_IT} ELSE acceptable END) AS d2,
    list_contains(a_groups, 'GENERAL_IT') AS b1, list_contains(t2_list, 'GENERAL_IT') AS b2 FROM v),
  m AS (SELECT *, CASE WHEN d1 AND e1 <> 'EXCLUDED' THEN 'd1' WHEN two AND d2 AND e2 <> 'EXCLUDED' THEN 'd2' WHEN free THEN 'none' WHEN d1 THEN 'x1' WHEN two AND d2 THEN 'x2'
      WHEN b1 AND e1 <> 'EXCLUDED' THEN 'b1' WHEN two AND b2 AND e2 <> 'EXCLUDED' THEN 'b2' WHEN b1 OR (two AND b2) THEN 'y' ELSE 'miss' END AS way FROM w),
  r0 AS (SELECT *, CASE WHEN non_it THEN 'MISMATCH' WHEN multi THEN CASE WHEN way IN ('b1', 'b2', 'y') THEN 'BROAD_IT_MATCH' WHEN way = 'miss' THEN 'MISMATCH' ELSE 'DIRECT_MATCH' END
      WHEN free OR d1 THEN 'DIRECT_MATCH' WHEN b1 THEN 'BROAD_IT_MATCH' ELSE 'MISMATCH' END AS role_match,
    NOT done OR (NOT non_it AND NOT multi AND NOT free AND coalesce(len(a_groups), 0) = 0) AS deferred FROM m),
  k AS (SELECT *, CASE WHEN role_match = 'MISMATCH' THEN 'UNKNOWN' WHEN NOT multi THEN e1 WHEN way IN ('d1', 'b1') THEN e1 WHEN way IN ('d2', 'b2') THEN e2 ELSE 'EXCLUDED' END AS class_exp,
    CASE WHEN expired THEN 'EXPIRED' WHEN rv = 'MISMATCH' THEN 'ROLE_MISMATCH' WHEN filter_exp = 'EXCLUDE' THEN 'EXPERIENCE_EXCLUDED' WHEN emp_bad THEN 'EMPLOYMENT_TYPE_MISMATCH' END AS keyword_reason,
    CASE WHEN rv = 'MATCH' THEN 30 ELSE 0 END AS s_role, CASE WHEN score_exp = 'PASS_FULL' THEN 15 ELSE 0 END AS s_exp,
    CASE WHEN len(list_filter(u_companies, lambda c: starts_with(lower(company), lower(c)) OR starts_with(lower(c), lower(company)))) > 0 THEN 15 ELSE 0 END
    + least(5 * len(list_filter(u_skills, lambda s: contains(lower(coalesce(skills_json, '')), lower(s)))), 25)
    + CASE WHEN len(list_filter(u_industries, lambda i: list_contains(list_transform(string_split(coalesce(industry_codes, ''), ','), lambda c: lower(trim(c))), lower(i)))) > 0 THEN 15 ELSE 0 END
    + CASE WHEN len(list_filter(u_locations, lambda p: contains(coalesce(location, ''), p) OR contains(p, coalesce(location, '')))) > 0 THEN 10 ELSE 0 END
    + CASE WHEN len(list_filter(u_employment, lambda x: lower(x) = lower(coalesce(employment_type, '')))) > 0 THEN 10 ELSE 0 END
    + CASE WHEN len(list_filter(u_sizes, lambda x: lower(x) = lower(coalesce(company_size, '')))) > 0 THEN 15 ELSE 0 END
    + CASE WHEN official THEN 5 ELSE 0 END AS s_rest FROM r0),
  s AS (SELECT *, s_role + s_exp + s_rest AS keyword_score,
    CASE WHEN expired THEN 'EXPIRED' WHEN deferred THEN 'ANALYSIS_DEFERRED' WHEN non_it THEN 'ANALYSIS_NON_IT' WHEN role_match = 'MISMATCH' THEN 'ANALYSIS_ROLE_MISMATCH'
         WHEN class_exp = 'EXCLUDED' THEN 'EXPERIENCE_EXCLUDED' WHEN emp_bad THEN 'EMPLOYMENT_TYPE_MISMATCH' END AS class_reason,
    CASE WHEN deferred THEN s_role + s_exp + s_rest ELSE s_rest + CASE role_match WHEN 'DIRECT_MATCH' THEN 30 WHEN 'BROAD_IT_MATCH' THEN 15 ELSE 0 END
      + CASE WHEN class_exp = 'FULL' THEN 15 ELSE 0 END
      + CASE WHEN non_it THEN 0 ELSE least(CASE WHEN scope = 'OPEN_RECRUITMENT' THEN 5 ELSE 0 END + CASE WHEN recruitment_type = 'NEW_GRAD_HIRE' AND new_grad THEN 5 ELSE 0 END, 5) END END AS class_score FROM k)"""
SCORED_SQL = f"{_F.replace('{pool}', 'postings')}, {_S}"
EXPOSED_SQL = f"""ex AS (SELECT user_id, canonical, CAST(max(o_orderdate) AS DATE) AS last_exposed
  FROM (SELECT c_nationkey * 10 + ascii(c_mktsegment) % 10 AS user_id, l_partkey, o_orderdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= DATE '{REF}' - {LOOKBACK_DAYS}) q
  JOIN (SELECT id, {_host_url('url')} AS canonical FROM postings) p ON p.id = q.l_partkey GROUP BY 1, 2)"""
PENALTY = "CASE WHEN d <= 1 THEN 30 WHEN d <= 3 THEN 25 WHEN d <= 6 THEN 10 ELSE 0 END"
#: The greedy selection restated with windows over a relation ``c`` (user_id, id, company, adjusted, ...).
SELECT_SQL = """r AS (SELECT *, lower(company) AS co, row_number() OVER (PARTITION BY user_id ORDER BY adjusted DESC, deadline ASC NULLS LAST, first_seen DESC NULLS LAST, id) AS r FROM c),
  u1 AS (SELECT *, coalesce(r = min(CASE WHEN is_urgent THEN r END) OVER (PARTITION BY user_id), false) AS p1 FROM r),
  n1 AS (SELECT *, 2 - max(CASE WHEN p1 AND is_new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS need,
    (is_new AND NOT p1) AND sum(CASE WHEN p1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, co)
      + sum(CASE WHEN is_new AND NOT p1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, co ORDER BY r) <= 2 AS ok FROM u1),
  n2 AS (SELECT *, ok AND sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY r) <= need AS p2 FROM n1),
  f1 AS (SELECT *, 7 - sum(CASE WHEN p1 OR p2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS fneed,
    NOT p1 AND NOT p2 AND sum(CASE WHEN p1 OR p2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, co)
      + sum(CASE WHEN NOT p1 AND NOT p2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, co ORDER BY r) <= 2 AS fok FROM n2),
  f2 AS (SELECT *, fok AND sum(CASE WHEN fok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY r) <= fneed AS p3 FROM f1),
  picked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN p1 THEN 1 WHEN p2 THEN 2 ELSE 3 END, r) AS rank FROM f2 WHERE p1 OR p2 OR p3)"""


def register(add) -> None:
    for mode, (reason, score) in MODES.items():
        add(
            "K24_top7_per_user" if mode == "ENFORCE" else f"K24_top7_{mode.lower()}",
            lambda spark, d, mode=mode: top_per_user(spark, d, mode),
            with_postings(f""", {_POOL}, {_F.replace('{pool}', 'pool')}, {_S}, {EXPOSED_SQL},
              c AS (SELECT s.*, {PENALTY} AS penalty, {score} - {PENALTY} AS adjusted FROM (
                SELECT s.*, date_diff('day', ex.last_exposed, DATE '{REF}') AS d FROM s LEFT JOIN ex USING (user_id, canonical) WHERE {reason} IS NULL) s),
              {SELECT_SQL} SELECT user_id, rank, id, company, adjusted, penalty, is_new, is_urgent FROM picked"""),
        )

    def all_scored(spark, d):
        return class_verdicts(facts(postings(spark, d), analyses(spark, d)), users(spark, d))

    add(
        "C05_C06_filter_reasons",
        lambda spark, d: reason_counts(facts(postings(spark, d), analyses(spark, d)), users(spark, d), ("keyword_reason", F.col("keyword_reason")), ("class_reason", F.col("class_reason"))).drop("eligible"),
        with_postings(f", {SCORED_SQL} SELECT user_id, keyword_reason, class_reason, count(*) AS n FROM s GROUP BY ALL"),
    )
    add(
        "K05_K06_K07_scores",
        lambda spark, d: all_scored(spark, d).groupBy("user_id").agg(
            F.sum(F.col("n") * F.col("keyword_score")).alias("keyword_total"), F.sum(F.col("n") * F.col("class_score")).alias("class_total"), F.max("class_score").alias("best"), F.sum(F.col("n") * F.col("parts.skill")).alias("skill_total")),
        with_postings(f", {SCORED_SQL} SELECT user_id, sum(keyword_score) AS keyword_total, sum(class_score) AS class_total, max(class_score) AS best, sum(least(5 * len(list_filter(u_skills, lambda z: contains(lower(coalesce(skills_json, '')), lower(z)))), 25)) AS skill_total FROM s GROUP BY 1"),
    )
    add(
        "K08_K12_eligibility",
        lambda spark, d: reason_counts(facts(postings(spark, d), analyses(spark, d)), users(spark, d), *[(k, F.col(f"match.{k}")) for k in ("deferred", "non_it", "role")]),
        with_postings(f", {SCORED_SQL} SELECT user_id, deferred, non_it, role_match AS role, count(*) AS n, count(*) FILTER (WHERE role_match <> 'MISMATCH' AND class_exp <> 'EXCLUDED' AND NOT non_it) AS eligible FROM s GROUP BY ALL"),
    )
    add(
        "K23_shadow_differences",
        lambda spark, d: all_scored(spark, d).filter(~F.col("keyword_reason").eqNullSafe(F.col("class_reason")) | (F.col("keyword_score") != F.col("class_score"))).groupBy("user_id").agg(
            F.sum("n").alias("n_differ"), F.sum(F.when(F.col("keyword_reason").isNull() & F.col("class_reason").isNotNull(), F.col("n")).otherwise(0)).alias("n_lost"), F.sum(F.col("n") * (F.col("class_score") - F.col("keyword_score"))).alias("score_shift")),
        with_postings(f", {SCORED_SQL} SELECT user_id, count(*) AS n_differ, count(*) FILTER (WHERE keyword_reason IS NULL AND class_reason IS NOT NULL) AS n_lost, sum(class_score - keyword_score) AS score_shift FROM s WHERE keyword_reason IS DISTINCT FROM class_reason OR keyword_score <> class_score GROUP BY 1"),
    )

    def exposed(spark, d):
        by_url = postings(spark, d).select("id", text.canonical_host_url(F.col("url")).alias("canonical"))
        return exposures(spark, d, by_url).withColumn("penalty", dates.exposure_penalty(F.datediff(ref_date(), F.col("last_exposed"))))

    add("E07_E08_D14_exposure", exposed,
        with_postings(f", {EXPOSED_SQL} SELECT user_id, canonical, last_exposed, {PENALTY} AS penalty FROM (SELECT *, date_diff('day', last_exposed, DATE '{REF}') AS d FROM ex) q"))
    add("C13_D01_eligible_pool", lambda spark, d: eligible_pool(postings(spark, d), provenance(spark, d), ref_date()).select("id", "company", "deadline"),
        with_postings(f", {_POOL} SELECT id, company, deadline FROM pool"))

    def selection(spark, d):
        f = facts(postings(spark, d), analyses(spark, d)).select((F.col("id") % 40).alias("user_id"), "id", "company", "deadline", "first_seen", "is_new", "is_urgent", (F.col("id") * 13 % 60).alias("adjusted"))
        return ranking.select_top(f).select("user_id", "rank", "id", "adjusted")

    add("F01_F02_F14_selector", selection,
        with_postings(f", {_F.replace('{pool}', 'postings')}, c AS (SELECT id % 40 AS user_id, id, company, deadline, first_seen, is_new, is_urgent, id * 13 % 60 AS adjusted FROM fact), {SELECT_SQL} SELECT user_id, rank, id, adjusted FROM picked"))
