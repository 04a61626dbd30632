"""Addresses and pages."""

from __future__ import annotations

import html
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ADDRESS = r"https?://[^\s|]+"
#: Endings, parts and beginnings of official hosts.
OFFICIAL_HOST = r"(\.go\.jp|\.lg\.jp)$|\.pref\.|^(www\.)?(city|town|vill|pref)\."


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Text with character references resolved."""
    return text.map(html.unescape, na_action="ignore")


def addresses(text: Column) -> Column:
    """All web addresses in a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"({ADDRESS})"), F.lit(1))


def host(address: Column) -> Column:
    """Host of an address in lower case without port; null if there is none."""
    found = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def is_official(address: Column) -> Column:
    return F.coalesce(host(address).rlike(OFFICIAL_HOST), F.lit(False))


def without_fragment(address: Column) -> Column:
    return F.regexp_replace(address, "#.*$", "")


def strip_tags(page: Column, unescape: bool = True) -> Column:
    """Visible text of a page: scripts and styles dropped, tags as blanks, blanks collapsed."""
    text = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(text) if unescape else text, r"\s+", " "))


def links(page: Column) -> Column:
    """Targets of the anchors of a page, in order."""
    return F.regexp_extract_all(page, F.lit(r'(?i)<a\s[^>]*?href="([^"]+)"'), F.lit(1))


def excerpt(text: Column, needle: Column | str, before: int = 120, after: int = 160) -> Column:
    """What stands around the first occurrence of ``needle``; null where there is none."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    at = F.position(needle, text)
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(text, start, at + F.length(needle) + after - start))


def result_links(page: Column) -> Column:
    """The first address outside the page itself of each list item, without fragment; distinct, in order."""
    items = F.regexp_extract_all(page, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    firsts = F.transform(items, lambda i: without_fragment(F.regexp_extract(i, r'(?i)<a\s[^>]*?href="(https?://[^"]+)"', 1)))
    return F.array_distinct(F.filter(firsts, lambda u: u != ""))


def catalog_rows(page: Column) -> Column:
    """``array<struct<section, label, href>>``: rows with an anchor, each under the heading before it."""
    parts = F.regexp_extract_all(page, F.lit(r"(?is)(<h[1-6]\b.*?</h[1-6]>.*?(?=<h[1-6]\b|\z))"), F.lit(1))

    def rows(part: Column) -> Column:
        heading = F.trim(F.regexp_replace(F.regexp_extract(part, r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>", 1), "<[^>]*>", ""))
        cells = F.regexp_extract_all(part, F.lit(r"(?is)(<tr\b.*?</tr>|<li\b.*?</li>)"), F.lit(1))
        found = F.transform(cells, lambda c: F.struct(heading.alias("section"), F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " ")).alias("label"), F.regexp_extract(c, r'(?i)<a\s[^>]*?href="([^"]+)"', 1).alias("href")))
        return F.filter(found, lambda r: r["href"] != "")

    return F.flatten(F.transform(parts, rows))


@F.pandas_udf(StringType())
def joined_address(base: pd.Series, link: pd.Series) -> pd.Series:
    """``link`` of a page at ``base`` as a whole address; null where it can't be one."""

    def join(b: str | None, x: str | None) -> str | None:
        try:
            return urljoin(b, x) if b and x else None
        except ValueError:
            return None

    return pd.Series([join(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def document_links(pages: DataFrame, key: str, base: str, page: str, keyword: str, ending: str = ".pdf") -> DataFrame:
    """``(key, position, url)``: distinct addresses of linked documents whose address or label has ``keyword``, in order."""
    anchors = F.regexp_extract_all(page, F.lit(r'(?is)(<a\s[^>]*?href="[^"]+"[^>]*>.*?</a>)'), F.lit(1))
    rows = pages.select(key, F.col(base).alias("__base"), F.posexplode(anchors).alias("position", "__a"))
    rows = rows.select(key, "position", "__a", joined_address("__base", F.regexp_extract("__a", r'(?i)href="([^"]+)"', 1)).alias("url"))
    path = F.lower(F.regexp_replace("url", r"[?#].*$", ""))
    rows = rows.filter(F.endswith(path, F.lit(ending)) & F.col("__a").rlike(keyword)).withColumn("url", without_fragment(F.col("url")))
    return rows.groupBy(key, "url").agg(F.min("position").alias("position")).select(key, "position", "url")


def encoded(text: Column) -> Column:
    """Percent-encoded form of a text as part of an address."""
    out = F.url_encode(text)
    for off, on in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(off), F.lit(on))
    return out
