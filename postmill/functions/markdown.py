"""Markdown of reports as HTML: headings, rules, lists, paragraphs, bold and links, in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The style sheet of the mail, and its footer.
STYLE = (
    "body{font-family:-apple-system,BlinkMacSystemFont,'Segoe UI',Helvetica,Arial,sans-serif;font-size:15px;line-height:1.7;color:#1a1a1a;max-width:680px;margin:0 auto;padding:24px 20px;}"
    "h1{font-size:22px;font-weight:700;margin-bottom:8px;}h2{font-size:17px;font-weight:600;margin-top:28px;margin-bottom:10px;}ul,ol{padding-left:20px;margin:8px 0;}li{margin:4px 0;}"
    "a{color:#2563eb;text-decoration:none;}a:hover{text-decoration:underline;}strong{font-weight:600;}p{margin:6px 0;}hr{border:none;border-top:1px solid #e5e7eb;margin:20px 0;}"
)
FOOTER = "오늘의 브리핑은 여기까지예요. 지난 브리핑 다시 보기와 브리핑 선호도·메일 수신 설정 변경은 "


def inline(line: Column) -> Column:
    """Escaped text with bold and links."""
    out = line
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    out = F.regexp_replace(out, r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    return F.regexp_replace(out, r"\[([^\]]*)\]\(([^)\s]+)\)", '<a href="$2">$1</a>')


def body(markdown: Column) -> Column:
    """Blocks are divided by empty lines, headings and rules; a block of list items is a list."""
    apart = F.regexp_replace(F.coalesce(markdown, F.lit("")), r"(?m)^(#{1,6} .*|---+)$", "\n\n$1\n\n")
    blocks = F.filter(F.transform(F.split(apart, r"\n\s*\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")

    def items(block: Column, mark: str) -> Column:
        lines = F.transform(F.split(block, "\n"), lambda x: F.concat(F.lit("<li>"), inline(F.regexp_replace(x, mark, "")), F.lit("</li>\n")))
        return F.array_join(lines, "")

    def block_html(b: Column) -> Column:
        level = F.length(F.regexp_extract(b, r"^(#{1,6}) ", 1)).cast("string")
        start = F.regexp_extract(b, r"^(\d+)\. ", 1)
        ordered = F.concat(F.when(start == "1", "<ol>\n").otherwise(F.concat(F.lit('<ol start="'), start, F.lit('">\n'))), items(b, r"^\d+\. "), F.lit("</ol>\n"))
        return (
            F.when(b.rlike("^#{1,6} "), F.concat(F.lit("<h"), level, F.lit(">"), inline(F.regexp_replace(b, "^#{1,6} ", "")), F.lit("</h"), level, F.lit(">\n")))
            .when(b.rlike("^---+$"), "<hr />\n")
            .when(b.rlike(r"^- .*(\n- .*)*$"), F.concat(F.lit("<ul>\n"), items(b, "^- "), F.lit("</ul>\n")))
            .when(b.rlike(r"^\d+\. .*(\n\d+\. .*)*$"), ordered)
            .otherwise(F.concat(F.lit("<p>"), inline(b), F.lit("</p>\n")))
        )

    return F.array_join(F.transform(blocks, block_html), "")


def mail(markdown: Column, base_url: Column | None = None, name: str = "Postmill") -> Column:
    """A whole HTML document; a base address adds a footer that links to it."""
    out = [F.lit(f'<!DOCTYPE html><html lang="ko"><head><meta charset="UTF-8"><style>{STYLE}</style></head><body>'), body(markdown)]
    if base_url is not None:
        url = F.regexp_replace(F.trim(base_url), "/$", "")
        footer = F.concat(F.lit(f'<hr/><p style="font-size:13px;color:#6b7280;margin-top:24px;">{FOOTER}<a href="'), url, F.lit(f'">{name}</a>에서 하실 수 있어요.</p>'))
        out.append(F.when(F.coalesce(F.trim(base_url), F.lit("")) != "", footer).otherwise(""))
    return F.concat(*out, F.lit("</body></html>"))
