"""Listings of single sites as rows: JSON inside pages, paged lists, and identifiers in addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import dates, labels, text
from postmill.sources import parsers

# Employment codes of the openings' JSON.
OPENING_EMPLOYMENT = {"FULL_TIME_WORKER": "정규직", "CONTRACT_WORKER": "계약직", "INTERN": "인턴", "PART_TIME_WORKER": "파트타임", "FREELANCER": "프리랜서"}
_OPENING = (
    "struct<openingId:bigint,title:string,openDate:string,dueDate:string,openingJobPosition:struct<openingJobPositions:array<struct<workspaceJob:struct<job:string>,"
    "workspaceOccupation:struct<occupation:string>,workspacePlace:struct<location:string>,jobPositionCareer:struct<careerType:string,careerFrom:int>,jobPositionEmployment:struct<employmentType:string>>>>>"
)
_PAYLOAD = f"struct<props:struct<pageProps:struct<dehydratedState:struct<queries:array<struct<queryKey:array<string>,state:struct<data:array<{_OPENING}>>>>>>>>"
_RECRUITS = "struct<props:struct<pageProps:struct<recruits:array<struct<title:string,status:string,isPrivate:boolean,applyUrl:string,types:array<string>,deadline:string>>>>>"


def openings(pages: DataFrame, html: str) -> DataFrame:
    """Openings in a page's embedded query state, with what their first position says."""
    payload = F.from_json(parsers.embedded_json(F.col(html)), _PAYLOAD)
    queries = payload["props"]["pageProps"]["dehydratedState"]["queries"]
    mine = F.get(F.filter(queries, lambda q: F.get(q["queryKey"], F.lit(0)) == "openings"), F.lit(0))["state"]["data"]
    rows = pages.select(*[c for c in pages.columns if c != html], F.explode(mine).alias("o"))
    p = F.get(F.col("o.openingJobPosition.openingJobPositions"), F.lit(0))
    some = lambda c: F.nullif(c, F.lit(""))
    return rows.select(
        *[c for c in rows.columns if c != "o"],
        F.col("o.openingId").alias("opening_id"),
        text.clean(F.col("o.title")).alias("title"),
        F.coalesce(some(p["workspaceJob"]["job"]), some(p["workspaceOccupation"]["occupation"])).alias("role"),
        some(p["workspacePlace"]["location"]).alias("location"),
        labels.greeting_level(p["jobPositionCareer"]["careerType"], p["jobPositionCareer"]["careerFrom"]).alias("level"),
        labels.by_table(p["jobPositionEmployment"]["employmentType"], OPENING_EMPLOYMENT).alias("employment"),
        dates.iso_day(F.col("o.dueDate")).alias("deadline"),
    )


def inline_recruits(pages: DataFrame, html: str, order: str, max_items: int | None = None) -> DataFrame:
    """Open, public items of the list in a page's inline JSON; the first of each address key by ``order`` and position."""
    scripts = F.regexp_extract_all(F.col(html), F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))
    data = F.get(F.filter(scripts, lambda x: F.contains(x, F.lit('"recruits"')) & F.contains(x, F.lit('"pageProps"'))), F.lit(0))
    listed = F.from_json(data, _RECRUITS)["props"]["pageProps"]["recruits"]
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(listed).alias("pos", "r"))
    rows = rows.filter("r.status = 'in_progress' AND NOT coalesce(r.isPrivate, false)")
    key = F.nullif(F.regexp_extract("r.applyUrl", r"/job_posting/([^/?#]+)/*(?:[?#]|$)", 1), F.lit(""))
    rows = rows.withColumn("key", key).filter("key IS NOT NULL")
    first = rows.groupBy("key").agg(F.min_by(F.struct("r", *[c for c in pages.columns if c != html]), F.struct(order, "pos")).alias("f"), F.min(F.struct(order, "pos")).alias("at"))
    out = first.select(
        "key", text.clean(F.col("f.r.title")).alias("title"), labels.first_label(F.col("f.r.types"), labels.ABLY_EMPLOYMENT).alias("employment"), dates.iso_day(F.col("f.r.deadline")).alias("deadline"), "at",
    )
    out = out if max_items is None else out.orderBy("at").limit(max_items)
    return out.drop("at").filter("title IS NOT NULL")


def job_ids(df: DataFrame, url: str, parameter: str = "job_id") -> DataFrame:
    """Distinct ids of a query parameter in addresses."""
    found = F.regexp_extract(F.col(url), rf"[?&]{parameter}=([0-9]+)", 1)
    return df.select(found.cast("long").alias("job_id")).filter("job_id IS NOT NULL").distinct()


def paged(pages: DataFrame, size: int, listing: str = "listing", page: str = "page", items: str = "items", total: str = "total") -> DataFrame:
    """Items of paged lists: pages follow one another until the stated total is reached or a page is short.

    Pages after the last one that a reader would have asked for are left out.
    """
    before = Window.partitionBy(listing).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.size(items)).over(before), F.lit(0))
    short = F.coalesce(F.max((F.size(items) < size).cast("int")).over(before), F.lit(0))
    asked = pages.withColumn("seen", seen).withColumn("ended", short).filter(F.col("ended") == 0).filter((F.col("seen") < F.col(total)) | (F.col(page) == 1))
    return asked.select(listing, page, F.posexplode(items).alias("pos", "item"))


def guarded(rows: DataFrame, key: str, order: str, name: Column, expected: Column) -> DataFrame:
    """The first row of each id whose company is the expected one."""
    return rows.filter(name == expected).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("__n = 1").drop("__n")


def discovered(pages: DataFrame, limit: int, listing: str = "listing", page: str = "page", items: str = "items") -> DataFrame:
    """New items (listing, page, pos, item, nth) of paged searches, ``limit`` per listing.

    A reader asks for page after page until one is missing, is empty, or has only items that earlier pages had. An item is new on the first page that has it, so the
    number of new items is known for every page at once, and the first page without any ends its listing. Items of one page repeat without effect; pages count from one.
    """
    rows = pages.select(listing, page, F.posexplode(items).alias("pos", "item"))
    firsts = rows.groupBy(listing, "item").agg(F.min(F.struct(page, "pos")).alias("at")).select(listing, F.col(f"at.{page}").alias(page), F.col("at.pos").alias("pos"), "item")
    novel = firsts.groupBy(listing, page).agg(F.count("*").alias("n_new"))
    # of pages with news, those that follow one another from the first are asked for
    inner = Window.partitionBy(listing).orderBy(page)
    asked = novel.withColumn("__k", F.row_number().over(inner)).filter(F.col("__k") == F.col(page))
    asked = asked.withColumn("before", F.sum("n_new").over(inner) - F.col("n_new")).filter(F.col("before") < limit).select(listing, page, "before")
    within = Window.partitionBy(listing, page).orderBy("pos")
    met = firsts.join(asked, [listing, page]).withColumn("nth", F.col("before") + F.row_number().over(within))
    return met.filter(F.col("nth") <= limit).select(listing, page, "pos", "item", "nth")


_SEARCH = "struct<props:struct<pageProps:struct<dehydratedState:struct<queries:array<struct<queryKey:string,state:string>>>>>>"


def search_ids(markup: Column) -> Column:
    """Distinct (kind, id) of a search page in its order: from the job searches in its embedded data, else from links to postings.

    An id counts once, under the kind it has first.
    """
    data = F.from_json(parsers.embedded_json(markup), _SEARCH)["props"]["pageProps"]["dehydratedState"]["queries"]
    searches = F.filter(data, lambda q: F.contains(q["queryKey"], F.lit("jobSearch")))
    found = F.flatten(F.transform(searches, lambda q: F.from_json(q["state"], "struct<data:struct<data:array<struct<id:bigint,recruit_type:int>>>>")["data"]["data"]))
    kind = lambda p: F.when(F.coalesce(p["recruit_type"], F.lit(0)) == 0, "recruit").otherwise("intern")
    structured = F.transform(F.filter(found, lambda p: F.coalesce(p["id"], F.lit(0)) != 0), lambda p: F.concat(kind(p), F.lit("/"), p["id"].cast("string")))
    linked = F.regexp_extract_all(markup, F.lit(r'href="[^"]*/((?:recruit|intern)/[0-9]+)'), F.lit(1))
    chosen = F.when(F.size(F.coalesce(structured, F.array().cast("array<string>"))) > 0, structured).otherwise(linked)

    def firsts(xs: Column) -> Column:
        ids = F.transform(xs, lambda x: F.substring_index(x, "/", -1))
        return F.filter(xs, lambda x, i: F.array_position(ids, F.substring_index(x, "/", -1)) == i + 1)

    return F.transform(F.array(chosen), firsts)[0]
