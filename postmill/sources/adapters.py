"""Adapters: each source is routed to its parser, and a source that fails is a warning, never a failed job.

A source row has source_id, company_id, company, adapter, config, and ``body``, the list document as fetched (null: not reached). Bodies of sitemaps list
pages, which are looked up in a table of pages by address; feeds and boards hold their postings. Parsers by key are Column functions body -> array of
items; those written in Python run as a table function in which an exception ends one page and becomes a row of its own.

Counters (discovered, fetched, parsed, selected) are worked out beside the rows from the same arrays, so routing costs no pass of its own; totals come
from an observation on the rows that are written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions import dates
from postmill.operators.sinks import spill
from postmill.sources import parsers
from postmill.sources.parsers import given

ITEM = "struct<title:string,url:string,employment:string,deadline:date,posted:timestamp>"
_NONE = f"array<{ITEM}>"


def _item(title: Column, url: Column, employment: Column | None = None, deadline: Column | None = None, posted: Column | None = None) -> Column:
    empty = F.lit(None)
    values = {"title": title, "url": url, "employment": empty if employment is None else employment, "deadline": empty if deadline is None else deadline, "posted": empty if posted is None else posted}
    return F.struct(*[v.alias(k) for k, v in values.items()]).cast(ITEM)


def board_items(body: Column) -> Column:
    """Jobs of a board dump; the deadline is the metadata entry "Valid Through"."""
    jobs = F.from_json(body, parsers.BOARD_SCHEMA)["jobs"]
    until = lambda j: F.get(F.filter(j["metadata"], lambda m: m["name"] == "Valid Through"), F.lit(0))["value"]
    return F.transform(jobs, lambda j: _item(given(j["title"]), given(j["absolute_url"]), deadline=dates.iso_day(until(j))))


def recruit_items(body: Column) -> Column:
    """Recruits listed in a page's inline JSON while they are in progress."""
    inline = F.regexp_extract(body, r'(?s)"recruits":(\[.*?\])', 1)
    rows = F.from_json(inline, "array<struct<title:string,status:string,applyUrl:string,endDate:string>>")
    return F.transform(F.filter(rows, lambda r: r["status"] == "in_progress"), lambda r: _item(given(r["title"]), given(r["applyUrl"]), deadline=dates.iso_day(r["endDate"])))


def feed_postings(body: Column, max_items: int) -> Column:
    return F.transform(F.slice(parsers.feed_items(body), 1, max_items), lambda r: _item(r["title"], r["link"], posted=dates.feed_time(r["stamp"])))


#: Parsers by the key in a source's configuration.
BY_KEY: dict[str, Callable[[Column], Column]] = {"GREENHOUSE": board_items, "ABLY_CAREERS": recruit_items}
#: Parsers written in Python: page text -> rows of (title, url).
PYTHON_PARSERS: dict[str, Callable[[str], Iterator[tuple[str, str]]]] = {}


def route(sources: DataFrame, keys: tuple[str, ...] = tuple(BY_KEY), python_keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``route`` (SITEMAP, RSS, a parser key, or null) and ``warning``, why a source yields nothing."""
    kind = F.upper(F.coalesce("adapter", F.lit("")))
    key = parsers.parser_key(F.col("config"))
    custom = key["key"].isin(*keys, *python_keys)
    target = F.when(kind.isin("SITEMAP", "RSS"), kind).when((kind == "CUSTOM") & custom, key["key"])
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    of = text("company_id=", F.col("company_id"))
    refused = (
        F.when(~kind.isin("SITEMAP", "RSS", "CUSTOM"), text("unsupported adapterType='", F.col("adapter"), "' ", of))
        .when((kind == "CUSTOM") & (key["error"] == "invalid_json"), text("invalid config_json for ", of))
        .when((kind == "CUSTOM") & key["error"].isNotNull(), text("missing custom parser_key for ", of))
        .when((kind == "CUSTOM") & key["key"].isNotNull() & ~custom, text("no custom parser registered for parser_key=", key["key"], " (", of, ")"))
        .when((kind == "CUSTOM") & key["key"].isNull(), text("no custom parser registered for ", of))
    )
    malformed = F.when(kind.isin("SITEMAP", "RSS") & parsers.malformed(F.col("body")), text("unexpected error ", of, ": invalid XML"))
    broken = F.when((kind == "CUSTOM") & F.coalesce(F.try_parse_json("body"), F.lit(None)).isNull() & (key["key"] == "GREENHOUSE"), text("unexpected error ", of, ": invalid JSON"))
    unread = F.when(F.col("body").isNull(), text("not fetched ", of))
    return sources.withColumn("warning", F.coalesce(refused, unread, malformed, broken)).withColumn("route", F.when(F.col("warning").isNull(), target))


def dispatch(
    sources: DataFrame, pages: DataFrame, cutoff: Column, fetched: int = parsers.FETCHED, max_items: int = 50, selected: int = 100, keys: dict[str, Callable[[Column], Column]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(postings, report). Postings: source_id, pos, title, url, employment, deadline, posted. Report: a row per source with route, warning and counters.

    ``pages`` has url and html. A sitemap's newest ``fetched`` entries are looked up there; pages without a title are no postings.
    """
    keys = BY_KEY if keys is None else keys
    routed = route(sources, tuple(keys))
    listed = F.when(F.col("route") == "RSS", feed_postings(F.col("body"), max_items))
    for key, parse in keys.items():
        listed = listed.when(F.col("route") == key, parse(F.col("body")))
    of_lists = routed.filter("route IS DISTINCT FROM 'SITEMAP'").withColumn("items", F.coalesce(listed, F.array().cast(_NONE)))
    usable = F.filter("items", lambda r: (F.coalesce(r["title"], F.lit("")) != "") & (F.coalesce(r["url"], F.lit("")) != ""))
    of_lists = of_lists.withColumn("good", usable).select(
        "source_id", "route", "warning", F.size("items").alias("discovered"), F.size("items").alias("fetched"), F.size("good").alias("parsed"), F.slice("good", 1, selected).alias("rows")
    )
    # sitemaps: addresses meet pages by a join; counters are aggregates of the same join
    maps = routed.filter("route = 'SITEMAP'")
    entries = parsers.parse_sitemap(maps, "body", cutoff, None, keys=("source_id",))
    newest = parsers.parse_sitemap(maps, "body", cutoff, fetched, keys=("source_id",))
    html = pages.select(F.col("url").alias("loc"), "html").dropDuplicates(["loc"])
    met = newest.join(html, "loc", "left").withColumn("p", parsers.parse_page(F.col("html")))
    item = _item(F.col("p.title"), F.col("loc"), F.col("p.employment"), F.col("p.deadline"))
    got = met.groupBy("source_id").agg(
        F.count("html").alias("fetched"), F.count("p.title").alias("parsed"),
        F.array_sort(F.collect_list(F.when(F.col("p.title").isNotNull(), F.struct("pos", item.alias("item"))))).alias("rows"),  # FETCHED at most
    )
    of_maps = maps.select("source_id", "route", "warning").join(entries.groupBy("source_id").agg(F.count("*").alias("discovered")), "source_id", "left").join(got, "source_id", "left").select(
        "source_id", "route", "warning", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("discovered", "fetched", "parsed")],
        F.coalesce(F.slice(F.transform("rows", lambda r: r["item"]), 1, selected), F.array().cast(_NONE)).alias("rows"),
    )
    both = spill(of_lists.unionByName(of_maps), "dispatched")
    report = both.select("source_id", "route", "warning", "discovered", "fetched", "parsed", F.size("rows").alias("selected"))
    return both.select("source_id", F.posexplode("rows").alias("pos", "r")).select("source_id", "pos", "r.*"), report


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df`` with named counters filled by whatever action first runs it. A stage that is recomputed after a loss may count twice: use them for
    logs, and the written table where a decision hangs on the number."""
    seen = Observation(name)
    return df.observe(seen, *[v.alias(k) for k, v in counts.items()]), seen


def parse_in_python(pages: DataFrame, registry: dict[str, Callable[[str], Iterator[tuple[str, str]]]] | None = None) -> DataFrame:
    """Pages (page_id, parser_key, body) -> page_id, parser_key, pos, title, url, error: a table function over a parser per key.

    An exception gives one row with ``error`` (its class and message) after the rows the parser had given; unknown keys and null bodies are errors too.
    """
    parsers_of = dict(PYTHON_PARSERS if registry is None else registry)

    class Parse:
        def eval(self, parser_key, body):
            pos = 0
            try:
                if parser_key not in parsers_of:
                    raise KeyError(parser_key)
                if body is None:
                    raise ValueError("not fetched")
                for title, url in parsers_of[parser_key](body):
                    yield pos, title, url, None
                    pos += 1
            except Exception as error:  # the page's own failure: the others go on
                yield pos, None, None, f"{type(error).__name__}: {error}"

    rows = T.StructType([T.StructField("pos", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in ("title", "url", "error")])
    spark = pages.sparkSession
    parse = F.udtf(Parse, returnType=rows)
    spark.udtf.register("postmill_parse", parse)
    return spark.sql("SELECT p.page_id, p.parser_key, r.* FROM {pages} p, LATERAL postmill_parse(p.parser_key, p.body) r", pages=pages)
