"""Routing, error isolation and counters of the adapters."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from postmill.sources import adapters, parsers

SITEMAP = '<urlset xmlns="http://s">{}</urlset>'
URL = "<url><loc>{}</loc><lastmod>{}</lastmod></url>"
ROWS = [
    (1, 10, "a", "sitemap", None, SITEMAP.format(URL.format("https://a/1?x=1&amp;y=2", "2024-01-05") + URL.format("<![CDATA[https://a/2]]>", "2024-01-06") + URL.format("https://a/3", "2023-01-01") + URL.format("https://a/4", "2024-01-07"))),
    (2, 20, "b", "RSS", None, "<rss><channel><item rdf:about='1' xmlns:rdf='r'><title>R&amp;D</title><link>https://b/1</link></item><item><title>no link</title></item></channel></rss>"),
    (3, 30, "c", "CUSTOM", '{"parser_key":"greenhouse"}', '{"jobs":[{"id":1,"title":"T","absolute_url":"https://c/1","metadata":[{"name":"Valid Through","value":"2024-02-01T00:00"}]},{"id":2,"title":" "}]}'),
    (4, 40, "d", "FAX", None, "x"),
    (5, 50, "e", "CUSTOM", "{bad", "{}"),
    (6, 60, "f", "CUSTOM", '{"parser_key":" "}', "{}"),
    (7, 70, "g", "CUSTOM", '{"parser_key":"nobody"}', "{}"),
    (8, 80, "h", "CUSTOM", None, "{}"),
    (9, 90, "i", "RSS", None, "<rss><channel>"),
    (10, 100, "j", "SITEMAP", None, None),
    (11, 110, "k", "CUSTOM", '{"parser_key":"GREENHOUSE"}', "not json"),
    (12, 120, "l", "CUSTOM", '{"parser_key":"ABLY_CAREERS"}', '<script>{"recruits":[{"title":"X","status":"in_progress","applyUrl":"https://l/1"},{"title":"Y","status":"closed","applyUrl":"https://l/2"}]}</script>'),
    (13, 130, None, None, None, None),
]
PAGES = [("https://a/1?x=1&y=2", "<h1>Backend 정규직</h1>"), ("https://a/2", "<p>no title</p>"), ("https://a/3", "<h1>old</h1>"), ("https://a/4", "<title>Four</title> 2024년 3월 1일")]


@pytest.fixture(scope="module")
def result(spark):
    sources = spark.createDataFrame(ROWS, "source_id int, company_id int, company string, adapter string, config string, body string")
    return adapters.dispatch(sources, spark.createDataFrame(PAGES, "url string, html string"), F.lit("2024-01-01").cast("date"))


def test_rows_of_each_route(result):
    found = {(r["source_id"], r["pos"]): (r["title"], r["url"], r["employment"], r["deadline"]) for r in result[0].collect()}
    assert found == {
        (1, 0): ("Four", "https://a/4", None, datetime.date(2024, 3, 1)),
        (1, 1): ("Backend 정규직", "https://a/1?x=1&y=2", "정규직", None),
        (2, 0): ("R&D", "https://b/1", None, None),
        (3, 0): ("T", "https://c/1", None, datetime.date(2024, 2, 1)),
        (12, 0): ("X", "https://l/1", None, None),
    }


def test_a_broken_source_is_a_warning_and_counts_nothing(result):
    report = {r["source_id"]: r for r in result[1].collect()}
    assert set(report) == {r[0] for r in ROWS}
    counts = {k: tuple(r[c] for c in ("discovered", "fetched", "parsed", "selected")) for k, r in report.items()}
    assert {k: v for k, v in counts.items() if any(v)} == {1: (3, 3, 2, 2), 2: (2, 2, 1, 1), 3: (2, 2, 1, 1), 12: (1, 1, 1, 1)}
    warnings = {k: r["warning"] for k, r in report.items() if r["warning"]}
    assert warnings == {
        4: "unsupported adapterType='FAX' company_id=40", 5: "invalid config_json for company_id=50", 6: "missing custom parser_key for company_id=60",
        7: "no custom parser registered for parser_key=NOBODY (company_id=70)", 8: "no custom parser registered for company_id=80", 9: "unexpected error company_id=90: invalid XML",
        10: "not fetched company_id=100", 11: "unexpected error company_id=110: invalid JSON", 13: "unsupported adapterType='null' company_id=130",
    }


def test_python_parsers_fail_alone(spark):
    def links(body):
        yield from ((t, u) for u, t in re.findall(r'<a href="([^"]*)">([^<]*)</a>', body))

    def broken(body):
        yield "first", "u"
        raise RuntimeError("bad page")

    pages = spark.createDataFrame([(1, "LINKS", '<a href="x">X</a><a href="y">Y</a>'), (2, "BROKEN", "z"), (3, "NONE", ""), (4, "LINKS", None), (5, "LINKS", "")], "page_id int, parser_key string, body string")
    rows = sorted(tuple(r) for r in adapters.parse_in_python(pages, {"LINKS": links, "BROKEN": broken}).collect())
    assert rows == [
        (1, "LINKS", 0, "X", "x", None), (1, "LINKS", 1, "Y", "y", None), (2, "BROKEN", 0, "first", "u", None), (2, "BROKEN", 1, None, None, "RuntimeError: bad page"),
        (3, "NONE", 0, None, None, "KeyError: 'NONE'"), (4, "LINKS", 0, None, None, "ValueError: not fetched"),
    ]


def test_observed_counters(spark):
    df, seen = adapters.observed(spark.range(10), "n", rows=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
    df.collect()
    assert seen.get == {"rows": 10, "even": 5}


@pytest.mark.parametrize(
    ("xml", "want"),
    [
        ('<urlset><url><loc>https://a.example/x?a=1&amp;b=2</loc></url></urlset>', ["https://a.example/x?a=1&b=2"]),
        ("<urlset><url><loc><![CDATA[https://a.example/?q=<b>]]></loc></url></urlset>", ["https://a.example/?q=<b>"]),
        ('<s:urlset xmlns:s="http://s"><s:url><s:loc>\n https://a \n</s:loc></s:url></s:urlset>', ["https://a"]),
        ("<urlset><url><lastmod>2024-01-01</lastmod></url><url><loc> </loc></url></urlset>", []),
        ("<urlset><url>", []), ("", []), (None, []), ("<urlset/>", []),
    ],
)
def test_sitemap_addresses(spark, xml, want):
    df = spark.createDataFrame([(xml,)], "xml string")
    assert [e["loc"] for e in df.select(parsers.sitemap_entries(F.col("xml")).alias("e")).first()["e"]] == want


@pytest.mark.parametrize(
    ("xml", "want"),
    [
        ('<rss><channel><item rdf:about="1" xmlns:rdf="r"><title>R&amp;D</title><link>u?a=1&amp;b</link></item></channel></rss>', [("R&D", "u?a=1&b")]),
        ("<rss><channel><item><title><![CDATA[A <b>]]></title><link>u</link></item><item><title>x</title></item><item><link>y</link></item></channel></rss>", [("A <b>", "u")]),
        ("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>t</title><link href='u?a&amp;b'/></entry><entry><title>t2</title><link rel='self'/><link href='v'/></entry></feed>", [("t", "u?a&b"), ("t2", "v")]),
        ("<rss><channel>", []), (None, []), ("<html/>", []),
    ],
)
def test_feed_items(spark, xml, want):
    df = spark.createDataFrame([(xml,)], "xml string")
    assert [(r["title"], r["link"]) for r in parsers.parse_feed(df, "xml").orderBy("pos").collect()] == want


def test_caps_count_before_unusable_items_go(spark):
    items = "".join(f"<item><title>{'' if k < 3 else k}</title><link>u{k}</link></item>" for k in range(6))
    df = spark.createDataFrame([(f"<rss><channel>{items}</channel></rss>",)], "xml string")
    assert [r["link"] for r in parsers.parse_feed(df, "xml", 4).collect()] == ["u3"]
