"""Table functions for SQL: rows out of pages and indexes, one call a row, with LATERAL."""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_ANCHOR = re.compile(r"<a\b([^>]*)>(.*?)</a\s*>", re.I | re.S)
_HREF = re.compile(r"""\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TAG = re.compile(r"<[^>]*>")
_SKIPPED = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.I | re.S)


@udtf(returnType="position int, href string, label string")
class PageLinks:
    """page_links(html): position from 0, href as written and label of each anchor outside comments, scripts and styles. A null page has none."""

    def eval(self, html: str):
        for i, (attributes, inner) in enumerate(_ANCHOR.findall(_SKIPPED.sub(" ", html or ""))):
            href = _HREF.search(attributes)
            yield i, unescape(href[1].strip("\"'")) if href else None, " ".join(unescape(_TAG.sub(" ", inner)).split())


@udtf(returnType="position int, heading string, level int")
class Headings:
    """markdown_headings(text): position from 0, heading and level of each line of one to six hashes. A null text has none."""

    def eval(self, text: str):
        n = 0
        for line in (text or "").split("\n"):
            if m := re.fullmatch(r" {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*\s*", line):
                yield n, m[2], len(m[1])
                n += 1


def register(spark: SparkSession) -> None:
    """page_links and markdown_headings for a session's SQL."""
    spark.udtf.register("page_links", PageLinks)
    spark.udtf.register("markdown_headings", Headings)


__all__ = ["Headings", "PageLinks", "register"]
