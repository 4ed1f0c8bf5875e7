"""Registered queries of small operators: generated postings, JSON lists, gates, caps, claims and lookbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.functions import dates
from postmill.operators import state
from postmill.plans.relational import QUEUE_SQL, queue
from postmill.sources.fixtures import REF, postings, with_postings

# How many postings are generated at least and at most, and the steps of their attributes.
MIN_GENERATED, MAX_GENERATED, URL_STEP, URL_SPACE = 3, 5, 7919, 99_999
#: Broad categories that are no roles.
BROAD = ("전체", "개발", "기타")


def generated_postings(requests: DataFrame, limit: int) -> DataFrame:
    """Postings for each request (request, day, seed, roles, companies, skills, locations): as many as its keywords say.

    Attributes cycle through the request's lists; addresses step by a prime, deadlines by three days.
    """
    keywords = sum((F.size(c) for c in ("roles", "companies", "skills")), F.lit(0))
    n = F.least(F.lit(MIN_GENERATED) + keywords % (MAX_GENERATED - MIN_GENERATED + 1), F.lit(limit))
    rows = requests.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).filter(n > 0)
    cycle = lambda c, more=0: F.element_at(c, ((F.col("i") + more) % F.size(c) + 1).cast("int"))
    return rows.select(
        "request", "i",
        F.concat(cycle("companies"), F.lit(" — "), cycle("roles")).alias("title"),
        cycle("locations").alias("location"),
        F.array_distinct(F.array(cycle("skills"), cycle("skills", 1))).alias("skills"),
        F.concat(F.lit("https://fixture.local/jobs/"), F.lpad((F.pmod(F.col("seed") + F.col("i") * URL_STEP, F.lit(URL_SPACE))).cast("string"), 5, "0")).alias("url"),
        F.date_add("day", (F.col("i") * 3 + 7).cast("int")).alias("deadline"),
    )


def gate(rows: DataFrame, categories: list[str], wanted: str = "JOB_POSTING") -> DataFrame:
    """All rows if the category is among those asked for, else none."""
    return rows if wanted in categories else rows.limit(0)


def budgeted(rows: DataFrame, limit: int, *order) -> DataFrame:
    """The first ``limit`` rows with the number of rows cut off."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(*order).limit(limit).join(F.broadcast(total)).withColumn("truncated", F.greatest(F.col("total") - limit, F.lit(0))).drop("total")


def json_array(values) -> F.Column:
    """A list as JSON; an empty list is null."""
    return F.when(F.size(values) > 0, F.to_json(values))


def register(add) -> None:
    col = F.col
    t = lambda spark, d, name: spark.read.parquet(f"{d}/{name}.parquet")

    def generated(s: SparkSession, d: str) -> DataFrame:
        one = lambda *xs: F.array(*map(F.lit, xs))
        r = t(s, d, "supplier").select(
            col("s_suppkey").alias("request"), F.lit(REF).cast("date").alias("day"), (F.lit(730_000) + col("s_suppkey")).alias("seed"),
            F.when(col("s_suppkey") % 2 == 0, one("백엔드")).otherwise(one("백엔드", "데이터")).alias("roles"), one("A", "B").alias("companies"),
            F.when(col("s_suppkey") % 3 == 0, one("Java")).otherwise(one("Java", "SQL", "Go")).alias("skills"), one("서울", "판교").alias("locations"),
        )
        return generated_postings(r, 4).withColumn("skills", F.array_join("skills", ","))

    add("A01_generated_postings", generated, f"""WITH r AS (SELECT s_suppkey AS request, 730000 + s_suppkey AS seed, CASE WHEN s_suppkey % 2 = 0 THEN ['백엔드'] ELSE ['백엔드', '데이터'] END AS roles,
        CASE WHEN s_suppkey % 3 = 0 THEN ['Java'] ELSE ['Java', 'SQL', 'Go'] END AS skills FROM supplier),
      x AS (SELECT *, unnest(range(least(3 + (len(roles) + 2 + len(skills)) % 3, 4))) AS i FROM r)
      SELECT request, CAST(i AS INT) AS i, (['A', 'B'])[i % 2 + 1] || ' — ' || roles[i % len(roles) + 1] AS title, (['서울', '판교'])[i % 2 + 1] AS location,
        CASE WHEN len(skills) = 1 THEN 'Java' ELSE skills[i % 3 + 1] || ',' || skills[(i + 1) % 3 + 1] END AS skills,
        'https://fixture.local/jobs/' || lpad(CAST((seed + i * 7919) % 99999 AS VARCHAR), 5, '0') AS url, DATE '{REF}' + CAST(i * 3 + 7 AS INT) AS deadline FROM x""")

    add("C01_category_result", lambda s, d: gate(postings(s, d), ["NEWS", "JOB_POSTING"]).select("id", F.lit("open").alias("gate")).unionByName(gate(postings(s, d), ["NEWS"]).select("id", F.lit("closed").alias("gate"))),
        with_postings("SELECT id, 'open' AS gate FROM postings"))
    add("F08_truncated", lambda s, d: budgeted(postings(s, d), 50, col("deadline").desc_nulls_last(), col("id")).select("id", "truncated"),
        with_postings("SELECT id, greatest((SELECT count(*) FROM postings) - 50, 0) AS truncated FROM (SELECT * FROM postings ORDER BY deadline DESC NULLS LAST, id LIMIT 50) q"))

    def active(s, d):
        k = col("id")
        closed, main, real = F.when(k % 4 == 0, True).when(k % 4 == 1, False), F.when(k % 3 == 0, False).when(k % 3 == 1, True), F.concat(F.when(k % 5 == 0, "Q-").otherwise("P-"), k.cast("string"))
        keep = ~F.coalesce(closed, F.lit(False)) & F.coalesce(main, F.lit(True)) & F.startswith(real, F.lit("P-"))
        return postings(s, d).filter(keep).select("id")

    add("A24_active_items", active, with_postings("SELECT id FROM postings WHERE id % 4 <> 0 AND id % 3 <> 0 AND id % 5 <> 0"))

    def lists(s, d):
        skills = F.from_json("skills_json", "array<string>")
        quoted = F.array(F.concat(F.lit('a"'), col("company")), F.lit("b\\c"))
        records = F.array(F.struct(col("id").alias("n"), F.lit(None).cast("string").alias("x")), F.struct((col("id") + 1).alias("n"), col("source").alias("x")))
        back = F.from_json(F.to_json(records), "array<struct<n:bigint,x:string>>")
        roles = F.array("company", F.lit("개발"), F.lit("전체"), "company", "source")
        return postings(s, d).select(
            "id", json_array(F.coalesce(skills, F.array().cast("array<string>"))).alias("skills"), json_array(quoted).alias("quoted"),
            F.array_join(F.from_json(json_array(quoted), "array<string>"), "|").alias("again"), F.get(back, F.lit(1))["x"].alias("second"), F.get(back, F.lit(0))["x"].alias("first"),
            F.array_join(F.array_except(F.array_distinct(F.array_compact(roles)), F.array(*map(F.lit, BROAD))), "|").alias("roles"),
        )

    add("H65_H67_H71_H72_lists", lists, with_postings("""SELECT id, CASE WHEN skills_json <> '[]' THEN skills_json END AS skills, '["a\\"' || company || '","b\\\\c"]' AS quoted, 'a"' || company || '|b\\c' AS again, source AS second, CAST(NULL AS VARCHAR) AS first,
      company || '|' || source AS roles FROM postings"""))
    add("H44_H46_date_forms", lambda s, d: postings(s, d).select(
            "id", dates.range_end(F.concat(F.date_format("deadline", "yyyyMMdd"), F.lit("2359"))).alias("compact_end"), dates.iso_day(F.concat(col("deadline").cast("string"), F.lit("T23:59:59-04:00"))).alias("valid_through"),
            dates.local_time(F.concat(col("deadline").cast("string"), F.lit("T08:30:00+09:00"))).alias("local"), dates.local_time(F.concat(col("deadline").cast("string"), F.lit("T08:30:00Z"))).alias("utc"), dates.range_end(F.lit("soon")).alias("bad")),
        with_postings("SELECT id, deadline AS compact_end, deadline AS valid_through, deadline + INTERVAL '8:30:00' HOUR TO SECOND AS local, deadline + INTERVAL '8:30:00' HOUR TO SECOND AS utc, CAST(NULL AS DATE) AS bad FROM postings".replace("INTERVAL '8:30:00' HOUR TO SECOND", "to_minutes(510)")))

    q = f"WITH queue AS ({QUEUE_SQL}) "
    add("I07_I08_claim_failed", lambda s, d: state.compare_and_set(queue(s, d), "status", ["FAILED"], "PROCESSING", col("attempts") < 3).select("id", "status", "claimed"),
        q + "SELECT id, CASE WHEN status = 'FAILED' AND attempts < 3 THEN 'PROCESSING' ELSE status END AS status, status = 'FAILED' AND attempts < 3 AS claimed FROM queue")

    def created(s, d):
        e = t(s, d, "events").select("user_id", col("ts").cast("date").alias("day"), "event_type")
        old = e.filter("event_type = 'purchase'").groupBy("user_id", "day").agg(F.lit("old").alias("report"))
        return state.insert_missing(old, e.select("user_id", "day").distinct().withColumn("report", F.lit("new")), ["user_id", "day"])

    add("I10_I11_create_or_get", created, """SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 'old' ELSE 'new' END AS report FROM events GROUP BY 1, 2""")
    add("I12_lookback", lambda s, d: t(s, d, "orders").filter(col("o_orderdate").cast("date").between(F.date_sub(F.lit(REF).cast("date"), 7), F.lit(REF).cast("date"))).groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").cast("date").alias("last_shown")),
        f"SELECT o_custkey, count(*) AS n, CAST(max(o_orderdate) AS DATE) AS last_shown FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{REF}' - 7 AND DATE '{REF}' GROUP BY 1")

    def two_tabs(s, d):
        k = col("id")
        tab = lambda n: postings(s, d).select((F.floor(k / 2) * 3 + n * (k % 2)).alias("key"), (k * 2 + n).alias("seq"), "company", F.lit(n).alias("tab"))
        both = tab(0).unionByName(tab(1)).filter("company IN ('Brand#11', 'Brand#12')")
        first = both.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("seq"))).filter("r = 1").drop("r")
        details = postings(s, d).select((k * 3).alias("key"), "location")
        return first.orderBy("seq").limit(60).join(details, "key", "left").select("key", "seq", "company", "tab", "location")

    add("A29_two_tabs", two_tabs, with_postings("""SELECT f.*, p.location FROM (SELECT key, seq, company, tab FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS r FROM (
        SELECT id // 2 * 3 AS key, id * 2 AS seq, company, 0 AS tab FROM postings UNION ALL SELECT id // 2 * 3 + id % 2, id * 2 + 1, company, 1 FROM postings) u WHERE company IN ('Brand#11', 'Brand#12')) w WHERE r = 1 ORDER BY seq LIMIT 60) f
      LEFT JOIN postings p ON p.id * 3 = f.key"""))
