"""Listing pages of enforcement actions, read with expressions over a column of HTML."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.functions.text import strip_html


def entries(pages: DataFrame, html: str) -> DataFrame:
    """pages plus one row an article block: filed_date, link, title, advertised (the page's own number of results)."""
    c = F.col(html)
    blocks = F.regexp_extract_all(c, F.lit(r"(?s)(<article\b.*?</article>)"), F.lit(1))
    advertised = F.regexp_extract(c, r"([\d,]+) results", 1)
    rows = pages.select(*pages.columns, F.regexp_replace(advertised, ",", "").try_cast("long").alias("advertised"), F.explode(blocks).alias("__a"))
    a = F.col("__a")
    return rows.select(
        *pages.columns, "advertised", F.substring(F.regexp_extract(a, r'datetime="([^"]+)"', 1), 1, 10).try_cast("date").alias("filed_date"),
        F.regexp_extract(a, r'href="([^"]+)"', 1).alias("link"), strip_html(F.regexp_extract(a, r"(?s)<a\b[^>]*>(.*?)</a>", 1)).alias("title"),
    ).drop(html)


def crawl(spark: SparkSession, fetch: Callable[[int], str | None], most: int = 1000) -> DataFrame:
    """(page, html) of listing pages 1, 2, ... until one brings no link that wasn't there before, or none comes; `most` guards against a site without end.

    Pages of one site come one after the other, since only the last tells whether there is another; they are few.
    """
    seen: set[str] = set()
    rows = []
    for page in range(1, most + 1):
        html = fetch(page)
        links = set(re.findall(r'<article\b.*?href="([^"]+)".*?</article>', html or "", re.S))
        if not links - seen:
            return spark.createDataFrame(rows, "page int, html string")
        seen |= links
        rows.append((page, html))
    raise RuntimeError(f"more than {most} pages")


def enough(found: DataFrame, share: float = 0.9) -> bool:
    """Whether the pages gave at least this share of what they advertise."""
    r = found.agg(F.count(F.lit(1)).alias("n"), F.max("advertised").alias("a")).first()
    return r["a"] is None or r["n"] >= share * r["a"]


def paragraphs(html, least: int = 60, most: int = 2400):
    """The text of the long paragraphs of a page, cut at `most` characters."""
    each = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<p\b[^>]*>(.*?)</p>"), F.lit(1)), strip_html)
    return F.substring(F.array_join(F.filter(each, lambda p: F.length(p) >= least), " "), 1, most)
