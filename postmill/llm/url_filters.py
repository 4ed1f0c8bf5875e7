"""URL filters over dated lists: validity intervals and a temporal join.

Dated list entries (add or remove a host at a time) become half-open validity intervals by looking
at the next entry of the same list and host. Each capture is looked up under its host and every
parent domain, among the intervals that hold at its fetch time: the as-of state of every list.

The join is an equi-join on (domain, month): an interval has a row for each month it touches, so
a capture meets only the few intervals of its own month however long a domain's history is, a hot
domain is spread over months, and adaptive execution splits what is still skewed. The lists are
broadcast if, and only if, Spark finds them small.

Captures are asked by (host, fetch time), so a busy host is one question a time however many captures it
has, and neither ids nor row numbers are needed: the answers join back on the same two columns.

Defined results: a null or unparsable address has no host and matches nothing; a null fetch time or
entry time matches nothing; entries of one list, host and time: removal wins; null and repeated ids are
judged by their own address and time, repeated captures get equal results; empty lists block nothing; other
columns pass through, and a result column replaces an input column of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more."""
    parts = F.split(host, r"\.")
    many = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    return F.when(host.isNotNull(), many)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, valid_from, valid_to) of entries (list, domain, action, at); action add or remove."""
    dated = entries.filter("at IS NOT NULL AND domain IS NOT NULL")
    # of the entries of one moment, removal wins
    states = dated.groupBy("list", "domain", "at").agg(F.bool_and(F.col("action") == "add").alias("active"))
    after = F.lead("at").over(Window.partitionBy("list", "domain").orderBy("at"))
    return (
        states.withColumn("valid_to", F.coalesce(after, F.lit(_FOREVER).cast("date")))
        .filter("active")
        .select("list", "domain", F.col("at").alias("valid_from"), "valid_to")
    )


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def active_matches(asked: DataFrame, intervals: DataFrame) -> DataFrame:
    """(host, fetched, list, domain, valid_from): entries active for distinct (host, fetched)."""
    horizon = asked.agg(F.min("fetched").alias("first"), F.max("fetched").alias("last"))  # one row
    spread = intervals.join(F.broadcast(horizon)).filter("valid_from <= last AND valid_to > first").select(
        "list",
        "domain",
        "valid_from",
        "valid_to",
        F.explode(F.sequence(_month(F.greatest("valid_from", "first")), _month(F.least("valid_to", "last")))).alias("month"),
    )
    places = asked.select("host", "fetched", _month(F.col("fetched")).alias("month"), F.explode(domains_of(F.col("host"))).alias("domain"))
    return (
        places.join(spread, ["domain", "month"])
        .filter((F.col("valid_from") <= F.col("fetched")) & (F.col("fetched") < F.col("valid_to")))
        .select("host", "fetched", "list", "domain", "valid_from")
    )


def filter_captures(captures: DataFrame, entries: DataFrame, url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """Captures with their host, the number of active entries, and the lists that block."""
    kept = [F.col(f"`{c}`") for c in captures.columns if c not in ("host", "n_active", "lists")]
    rows = captures.select(
        F.struct(*kept).alias("row"), host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{fetched_col}`").alias("fetched")
    )
    asked = rows.filter("host IS NOT NULL AND fetched IS NOT NULL").groupBy("host", "fetched").agg(F.lit(1).alias("one"))
    found = (
        active_matches(asked.select("host", "fetched"), validity_intervals(entries))
        .groupBy("host", "fetched")
        .agg(F.countDistinct("list", "domain", "valid_from").alias("n_active"), F.array_sort(F.collect_set("list")).alias("lists"))
    )
    return rows.join(found, ["host", "fetched"], "left").select(
        "row.*",
        "host",
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("lists", F.array().cast("array<string>")).alias("lists"),
    )


# --- the query's tables -------------------------------------------------------------------------


def _number(text: Column, modulus: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % modulus


def captures_of(pages: DataFrame) -> DataFrame:
    """Every page as a capture, fetched on a day of 2024 that its id determines."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    return pages.select(F.col("page_id").alias("id"), "url", day.alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Two dated lists over the hosts of all pages: on, off and, for some, on again."""
    hosts = pages.select(host_of(F.col("url")).alias("domain")).filter("domain IS NOT NULL").distinct()
    begin = F.date_add(F.lit("2024-01-15").cast("date"), _number(F.col("domain"), 200).cast("int"))
    kind = F.when(_number(F.col("domain"), 2) == 0, F.lit("malware")).otherwise(F.lit("spam"))
    listed = hosts.filter(_number(F.concat(F.lit("x"), F.col("domain")), 3) > 0).select(kind.alias("list"), "domain", begin.alias("b"))
    steps = F.array(
        F.struct(F.lit("add").alias("action"), F.col("b").alias("at")),
        F.struct(F.lit("remove").alias("action"), F.date_add("b", 60).alias("at")),
        F.struct(F.lit("add").alias("action"), F.date_add("b", 120).alias("at")),
    )
    return listed.select("list", "domain", F.explode(steps).alias("s")).select("list", "domain", "s.action", "s.at")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    found = filter_captures(captures_of(pages), entries_of(pages))
    return found.select(
        F.col("id").alias("page_id"),
        "host",
        "fetched",
        "n_active",
        F.array_join("lists", ",").alias("lists"),
        (F.col("n_active") > 0).alias("blocked"),
    )


OP5_SQL = r"""
WITH c AS (
  SELECT page_id, url, (DATE '2024-01-01' + (page_id * 37 % 366)::INT)::DATE AS fetched,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host
  FROM pages),
h AS (SELECT DISTINCT host AS domain FROM c WHERE host IS NOT NULL),
l AS (
  SELECT domain, CASE WHEN ('0x' || substr(md5(domain), 1, 8))::BIGINT % 2 = 0 THEN 'malware' ELSE 'spam' END AS list,
         (DATE '2024-01-15' + (('0x' || substr(md5(domain), 1, 8))::BIGINT % 200)::INT)::DATE AS b
  FROM h WHERE ('0x' || substr(md5('x' || domain), 1, 8))::BIGINT % 3 > 0),
i AS (
  SELECT list, domain, b AS valid_from, b + 60 AS valid_to FROM l
  UNION ALL SELECT list, domain, b + 120, DATE '9999-12-31' FROM l),
m AS (
  SELECT c.host, c.fetched, i.list, i.domain, i.valid_from
  FROM (SELECT DISTINCT host, fetched FROM c) c JOIN i ON (c.host = i.domain OR ends_with(c.host, '.' || i.domain))
    AND i.valid_from <= c.fetched AND c.fetched < i.valid_to),
n AS (
  SELECT host, fetched, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM m GROUP BY ALL)
SELECT c.page_id, c.host, c.fetched, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, n_active IS NOT NULL AS blocked
FROM c LEFT JOIN n ON c.host = n.host AND c.fetched = n.fetched
"""
