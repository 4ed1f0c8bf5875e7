"""Parsers from scraped text columns to posting rows. Fetching is not part of the engine.

JSON, feeds and sitemaps are taken apart by Spark's typed JSON and XML readers: entities and CDATA come decoded, name spaces and
attributes don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import dates, text

# Employment words of postings, and endings that a page title drops.
EMPLOYMENT_WORDS = ("정규직", "계약직", "인턴", "파견직", "프리랜서")
TITLE_ENDS = (" | 채용", " - 채용", " | 채용공고", " | Jobs", " | Careers", " | 경력채용", " | 신입채용")
COMPANY_ICON = "기업 아이콘"
UNKNOWN_DAY = "0001-01-01"


def parser_key(config: Column) -> Column:
    """Struct (key, error): the upper-case key, or invalid_json, missing_key, empty_key; both null without config."""
    given = F.coalesce(F.trim(config), F.lit("")) != ""
    parsed = F.try_parse_json(config)
    raw = F.get_json_object(config, "$.parser_key")
    error = (
        F.when(~given, F.lit(None).cast("string"))
        .when(parsed.isNull(), "invalid_json")
        .when(raw.isNull(), "missing_key")
        .when(F.trim(raw) == "", "empty_key")
    )
    return F.struct(F.when(given & error.isNull(), F.upper(F.trim(raw))).alias("key"), error.alias("error"))


def config_number(config: Column, key: str, default: int) -> Column:
    return F.coalesce(F.get_json_object(config, f"$.{key}").try_cast("int"), F.lit(default))


def malformed(xml: Column) -> Column:
    """Whether a text isn't well-formed XML."""
    return F.coalesce(F.from_xml(xml, F.lit("_corrupt_record string, _x string"))["_corrupt_record"].isNotNull(), F.lit(False))


_XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
_SITEMAP = "url array<struct<loc:string,lastmod:string>>"
_ITEM = (
    "array<struct<title:struct<_VALUE:string,_type:string>,link:array<struct<_VALUE:string,_href:string>>,description:struct<_VALUE:string,_type:string>,"
    "summary:struct<_VALUE:string,_type:string>,content:struct<_VALUE:string,_type:string>,pubDate:string,published:string,updated:string>>"
)
_FEED = f"channel struct<item:{_ITEM}>, item {_ITEM}, entry {_ITEM}"
_ENTRIES = "array<struct<loc:string,lastmod:string>>"
#: How many entries of a source's sitemaps are fetched, and how many of a board's are looked at.
FETCHED, DISCOVERED = 20, 300


def given(c: Column) -> Column:
    """Text without white space around it, null if nothing is left."""
    return F.nullif(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))


def sitemap_entries(xml: Column) -> Column:
    """Array of (loc, lastmod text) of a sitemap; entries without an address are dropped, a malformed text has none."""
    read = F.from_xml(F.when(~malformed(xml), xml), F.lit(_SITEMAP), _XML)["url"]
    entries = F.transform(F.coalesce(read, F.array().cast(_ENTRIES)), lambda u: F.struct(given(u["loc"]).alias("loc"), given(u["lastmod"]).alias("lastmod")))
    return F.filter(entries, lambda e: e["loc"].isNotNull())


def parse_sitemap(df: DataFrame, xml: str, cutoff: Column, limit: int | None = None, strict: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Entries not older than ``cutoff`` or of unknown day, newest first; unknown days sort last.

    With ``keys``, the sitemaps that agree in these columns are one source: its addresses are distinct, the newest day of an address counts, and ``limit`` is
    per source. A text that isn't well-formed has no entries; if ``strict``, it fails the job.
    """
    stop = F.raise_error(F.lit("sitemap is not well-formed XML")).cast(_ENTRIES)
    entries = F.when(malformed(F.col(xml)), stop).otherwise(sitemap_entries(F.col(xml))) if strict else sitemap_entries(F.col(xml))
    rows = df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.loc", dates.iso_day(F.col("e.lastmod")).alias("lastmod"))
    kept = rows.filter(F.col("lastmod").isNull() | (F.col("lastmod") >= cutoff))
    kept = kept.withColumn("lastmod", F.coalesce("lastmod", F.lit(UNKNOWN_DAY).cast("date")))
    if not keys:
        return kept if limit is None else kept.orderBy(F.col("lastmod").desc(), "loc").limit(limit)
    kept = kept.groupBy(*keys, "loc").agg(F.max("lastmod").alias("lastmod"))
    if limit is None:
        return kept
    order = Window.partitionBy(*keys).orderBy(F.col("lastmod").desc(), "loc")  # a window group limit prunes before the shuffle
    return kept.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= limit)


def feed_items(xml: Column) -> Column:
    """Array of a feed's items: those of an RSS channel, beside it (RDF), or Atom entries."""
    read = F.from_xml(F.when(~malformed(xml), xml), F.lit(_FEED), _XML)
    row = lambda r, i: F.struct(
        i.alias("pos"),
        given(r["title"]["_VALUE"]).alias("title"),
        F.get(F.filter(F.transform(r["link"], lambda k: F.coalesce(given(k["_VALUE"]), given(k["_href"]))), lambda k: k.isNotNull()), F.lit(0)).alias("link"),
        F.coalesce(given(r["description"]["_VALUE"]), given(r["summary"]["_VALUE"]), given(r["content"]["_VALUE"])).alias("description"),
        F.coalesce(given(r["pubDate"]), given(r["published"]), given(r["updated"])).alias("stamp"),
    )
    return F.transform(F.coalesce(read["channel"]["item"], read["item"], read["entry"], F.array().cast(_ITEM)), row)


def parse_feed(df: DataFrame, xml: str, max_items: int = 50) -> DataFrame:
    """Of the first ``max_items`` items of each feed, those with title and link. A malformed feed has none."""
    usable = F.filter(F.slice(feed_items(F.col(xml)), 1, max_items), lambda r: r["title"].isNotNull() & r["link"].isNotNull())
    out = df.select(*[c for c in df.columns if c != xml], F.explode(usable).alias("r"))
    return out.select("*", "r.pos", "r.title", "r.link", "r.description", dates.feed_time(F.col("r.stamp")).alias("posted")).drop("r")


def visible(markup: Column) -> Column:
    return text.collapse(F.regexp_replace(F.regexp_replace(markup, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]+>", " "))


def employment_word(words: Column) -> Column:
    """The first employment word in the order of the list that a text has."""
    return F.coalesce(*[F.when(F.contains(words, F.lit(w)), w) for w in EMPLOYMENT_WORDS])


def without_ends(title: Column) -> Column:
    """A title less each of the usual endings, in their order."""
    for end in TITLE_ENDS:
        title = F.regexp_replace(title, rf"\Q{end}\E\z", "")
    return F.trim(title)


def parse_page(markup: Column) -> Column:
    """Struct (title, employment, deadline) of a posting page: first short h1, else the title element without the usual endings."""
    h1 = visible(F.regexp_extract(markup, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    title = without_ends(visible(F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    words = visible(markup)
    return F.struct(
        F.when((h1 != "") & (F.length(h1) < 200), h1).otherwise(F.nullif(title, F.lit(""))).alias("title"),
        employment_word(words).alias("employment"),
        dates.last_korean_date(words).alias("deadline"),
    )


def parse_posting(markup: Column) -> Column:
    """Struct (company, title, employment, deadline) of an aggregator's posting page, or null without company or title.

    The company is named by the alternative text of its icon; the title is the first h1 with text, else the first h2.
    """
    icon = F.get(F.filter(F.regexp_extract_all(markup, F.lit(r"(?is)<img[^>]*?\balt\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1)), lambda a: F.contains(a, F.lit(COMPANY_ICON))), F.lit(0))
    company = given(F.replace(icon, F.lit(COMPANY_ICON), F.lit("")))
    heading = lambda tag: F.nullif(visible(F.regexp_extract(markup, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)), F.lit(""))
    title = F.coalesce(heading("h1"), heading("h2"))
    words = visible(markup)
    row = F.struct(company.alias("company"), title.alias("title"), employment_word(words).alias("employment"), dates.last_korean_date(words).alias("deadline"))
    return F.when(company.isNotNull() & title.isNotNull(), row)


def page_links(markup: Column, include: str, base: Column | None = None, exclude: str | None = None, limit: int | None = None) -> Column:
    """Distinct link targets that match ``include`` and not ``exclude``, in page order, at most ``limit``.

    With ``base``, targets are made absolute against it, and those of another origin are left out.
    """
    links = F.regexp_extract_all(markup, F.lit(r'href="([^"]+)"'), F.lit(1))
    if base is not None:
        origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
        folder = F.regexp_replace(F.regexp_extract(base, r"^([^?#]*)", 1), r"(?<=[^/:])/[^/]*$", "")
        whole = lambda u: F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), u).when(F.startswith(u, F.lit("/")), F.concat(origin, u)).otherwise(F.concat(folder, F.lit("/"), u))
        links = F.filter(F.transform(links, whole), lambda u: (u == origin) | F.startswith(u, F.concat(origin, F.lit("/"))))
    kept = F.filter(links, lambda u: u.rlike(include) & (~u.rlike(exclude) if exclude else F.lit(True)))
    found = F.array_distinct(kept)
    return found if limit is None else F.slice(found, 1, limit)


def embedded_json(markup: Column, element_id: str = "__NEXT_DATA__") -> Column:
    return F.nullif(F.regexp_extract(markup, rf'(?s)<script[^>]*id="{element_id}"[^>]*>(.*?)</script>', 1), F.lit(""))


BOARD_SCHEMA = "struct<jobs:array<struct<id:bigint,title:string,absolute_url:string,content:string,metadata:array<struct<name:string,value:string>>>>>"


def parse_board(df: DataFrame, json: str, max_items: int = 100) -> DataFrame:
    """Rows of a board dump; metadata is looked up by name; rows without title or address are dropped."""
    jobs = F.slice(F.from_json(F.col(json), BOARD_SCHEMA)["jobs"], 1, max_items)
    rows = df.select(F.explode(jobs).alias("j"))
    meta = lambda name: F.get(F.filter(F.col("j.metadata"), lambda m: m["name"] == name), F.lit(0))["value"]
    return rows.select(
        F.col("j.id").alias("id"), text.clean(F.col("j.title")).alias("title"), F.col("j.absolute_url").alias("url"),
        meta("Corporate").alias("company"), dates.iso_day(meta("Valid Through")).alias("deadline"),
    ).filter("title IS NOT NULL AND coalesce(trim(url), '') <> ''")


def preflight(rows: DataFrame, required: list[str], adapter: Column, known: tuple[str, ...] = ("SITEMAP", "RSS", "CUSTOM")) -> DataFrame:
    """(adapter, code): why an adapter's collected rows can't be used, or null."""
    bad = F.lit(False)
    for c in required:
        bad = bad | (F.coalesce(F.trim(F.col(c)), F.lit("")) == "")
    g = rows.groupBy(adapter.alias("adapter")).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"))
    return g.select("adapter", F.when(~F.col("adapter").isin(*known), "UNSUPPORTED_ADAPTER").when(F.col("n_bad") > 0, "REQUIRED_FIELD_PARSE_FAILED").alias("code"))


# Parsers that can be named in a source's configuration and probed.
PROBED = ("GREETING", "GREENHOUSE", "DAANGN_CAREERS", "TOSS_CAREERS", "NAVER_CAREERS", "ABLY_CAREERS", "KAKAO_CAREERS", "SAMSUNG_CAREERS", "LG_CNS_CAREERS")
UNPROBED = ("LG_CAREERS", "SK_CAREERS", "HYUNDAI_CAREERS")
MAX_DISCOVER, MAX_SAMPLE = 5, 1


def probe(rows: DataFrame) -> DataFrame:
    """Sources (adapter, source_url, config, fetched, body, sample) with ``code``, ``discovered`` and ``sampled``.

    ``fetched`` is OK, TIMEOUT, SHELL (a page that only a browser can open) or an HTTP status; ``body`` is the sitemap, feed or list
    as fetched and ``sample`` the first item's page. The first rule that fails names the code; null means usable.
    """
    col = F.col
    kind = F.upper(F.trim(F.coalesce("adapter", F.lit(""))))
    sitemap = sitemap_entries(col("body"))
    usable = F.filter(feed_items(col("body")), lambda r: r["title"].isNotNull() & r["link"].isNotNull())
    jobs = F.coalesce(F.from_json("body", "struct<jobs:array<struct<title:string,absolute_url:string>>>")["jobs"], F.array().cast("array<struct<title:string,absolute_url:string>>"))
    complete = F.filter(jobs, lambda j: (F.coalesce(F.trim(j["title"]), F.lit("")) != "") & j["absolute_url"].isNotNull())
    titled = F.coalesce(parse_page(col("sample"))["title"], F.lit("")) != ""
    key = parser_key(col("config"))
    fetched = (
        F.when(F.coalesce(col("source_url"), F.lit("")) == "", "INVALID_CONFIG")
        .when(col("fetched") == "TIMEOUT", "TIMEOUT")
        .when(col("fetched") == "SHELL", "CLOUDFLARE_SHELL")
        .when(col("fetched") != "OK", "URL_UNREACHABLE")
    )
    xml = F.coalesce(fetched, F.when(malformed(col("body")), "REQUIRED_FIELD_PARSE_FAILED"))
    of_sitemap = F.coalesce(xml, F.when(F.size(sitemap) == 0, "NO_ITEMS_DISCOVERED").when(~titled, "REQUIRED_FIELD_PARSE_FAILED"))
    # items of a feed without title and link are dropped when it is parsed
    of_feed = F.coalesce(xml, F.when(F.size(usable) == 0, "NO_ITEMS_DISCOVERED"))
    of_board = F.coalesce(fetched, F.when(F.size(jobs) == 0, "NO_ITEMS_DISCOVERED").when(F.size(complete) == 0, "REQUIRED_FIELD_PARSE_FAILED"))
    custom = (
        F.when(key["error"].isin("missing_key", "empty_key") | (key["error"].isNull() & key["key"].isNull()), "MISSING_PARSER_KEY")
        .when(key["error"].isNotNull(), "INVALID_CONFIG")
        .when(~key["key"].isin(*PROBED, *UNPROBED), "UNKNOWN_PARSER")
        .when(key["key"].isin(*UNPROBED), "UNSUPPORTED_ADAPTER")
        .otherwise(of_board)
    )
    code = F.when(kind == "SITEMAP", of_sitemap).when(kind == "RSS", of_feed).when(kind == "CUSTOM", custom).otherwise("UNSUPPORTED_ADAPTER")
    found = F.when(kind == "SITEMAP", F.size(sitemap)).when(kind == "RSS", F.size(usable)).otherwise(F.size(jobs))
    out = rows.withColumn("code", code)
    return out.withColumn("discovered", F.when(col("code").isNull(), F.least(found, F.lit(MAX_DISCOVER))).otherwise(0)).withColumn(
        "sampled", F.when(col("code").isNull(), MAX_SAMPLE).otherwise(0)
    )


def search_queries(roles: Column, companies: Column, skills: Column, limit: int) -> Column:
    """Search queries of a user: roles, companies, then the first three roles with the first two skills; at most ``limit``.

    Queries with the same set of words are one, the first; blank ones are none.
    """
    pairs = F.flatten(F.transform(F.slice(roles, 1, 3), lambda r: F.transform(F.slice(skills, 1, 2), lambda s: F.concat_ws(" ", r, s))))
    wanted = F.transform(
        F.concat(roles, companies, pairs),
        lambda q: F.struct(q.alias("query"), F.array_sort(F.array_distinct(F.filter(F.split(F.lower(q), r"\s+"), lambda w: w != ""))).alias("words")),
    )
    told = F.filter(wanted, lambda q: F.size(q["words"]) > 0)

    def firsts(qs: Column) -> Column:
        keys = F.transform(qs, lambda q: F.array_join(q["words"], " "))
        first = lambda q, i: F.array_position(keys, F.array_join(q["words"], " ")) == i + 1
        return F.transform(F.filter(qs, first), lambda q: q["query"])

    return F.slice(F.transform(F.array(told), firsts)[0], 1, limit)
