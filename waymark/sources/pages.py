"""Documents behind addresses: fetched with a cap, decoded, turned into text once and kept by the digest of the address."""

from __future__ import annotations

import re
import urllib.request
from collections.abc import Iterator
from contextlib import suppress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.web import strip_tags
from .files import new_only

#: Largest document in bytes, seconds to wait and attempts for each.
MOST_BYTES, TIMEOUT, ATTEMPTS = 25_000_000, 45, 2
#: Encodings to try after the one that the document or its header names.
ENCODINGS = ("utf-8", "shift_jis", "cp932")
_NAMED = re.compile(rb"""charset=["']?([A-Za-z0-9_.:-]+)""")


def decoded_bytes(content: bytes, header: str | None = None) -> str:
    """Text of ``content`` under the first encoding that fits: the header's, the document's own, then ``ENCODINGS``.

    Where none fits, what can't be read is replaced.
    """
    named = [m.group(1).decode("ascii") for m in (_NAMED.search((header or "").encode("ascii", "ignore")), _NAMED.search(content[:4096])) if m]
    for encoding in (*named, *ENCODINGS):
        with suppress(UnicodeDecodeError, LookupError):
            return content.decode(encoding)
    return content.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def decoded(content: pd.Series, header: pd.Series) -> pd.Series:
    """``decoded_bytes`` of a column; null for null."""
    return pd.Series([None if c is None else decoded_bytes(bytes(c), h if isinstance(h, str) else None) for c, h in zip(content, header, strict=True)], dtype=object)


def kind_of(content: Column, header: Column) -> Column:
    """``pdf``, ``html`` or ``text``; ``unreadable`` for empty documents and null."""
    head = F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    html = F.contains(F.lower(F.coalesce(header, F.lit(""))), F.lit("html")) | head.rlike(r"<(!doctype|html|body|head|div|p|a|table|ul)\b")
    return F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "unreadable").when(F.startswith(head, F.lit("%pdf")), "pdf").when(html, "html").otherwise("text")


def document_texts(documents: DataFrame) -> DataFrame:
    """``(key, url, kind, text)`` of fetched ``(url, content, header)``; a PDF's text is left to a reader and null here."""
    text = decoded(F.col("content"), F.col("header"))
    df = documents.select(F.sha2("url", 256).alias("key"), "url", kind_of(F.col("content"), F.col("header")).alias("kind"), F.when(~kind_of(F.col("content"), F.col("header")).isin("pdf", "unreadable"), text).alias("raw"))
    return df.select("key", "url", "kind", F.when(F.col("kind") == "html", strip_tags(F.col("raw"))).otherwise(F.col("raw")).alias("text"))


def _fetch(url: str, mirrors: list[str], most_bytes: int, timeout: float, attempts: int) -> tuple[bytes | None, str | None, str | None]:
    error = None
    for _ in range(attempts):
        for address in [url.replace(mirrors[0], m, 1) for m in mirrors] if mirrors and url.startswith(mirrors[0]) else [url]:
            try:
                with urllib.request.urlopen(urllib.request.Request(address), timeout=timeout) as answer:  # noqa: S310
                    content = answer.read(most_bytes + 1)
                    if len(content) > most_bytes:
                        return None, None, f"more than {most_bytes} bytes"
                    return content, answer.headers.get("Content-Type"), None
            except (OSError, ValueError) as fault:
                error = f"{type(fault).__name__}: {fault}"
    return None, None, error


def fetched(wanted: DataFrame, mirrors: list[str] | None = None, most_bytes: int = MOST_BYTES, timeout: float = TIMEOUT, attempts: int = ATTEMPTS) -> DataFrame:
    """``(url, content, header, error)`` of each ``url``; what can't be fetched is a row with its error.

    ``mirrors`` are beginnings of addresses that stand for each other, the first one being that of ``wanted``; they are tried in
    turn. How many are fetched at once is the number of partitions of ``wanted``.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url in batch["url"]:
                # One document at a time, so memory is bounded by the cap.
                yield pd.DataFrame([(url, *_fetch(url, mirrors or [], most_bytes, timeout, attempts))], columns=["url", "content", "header", "error"])

    return wanted.filter("url IS NOT NULL").select("url").mapInPandas(read, "url string, content binary, header string, error string")


def still_wanted(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``url`` of ``wanted`` whose digest the cache lacks; a cached error counts as an answer."""
    keyed = wanted.filter("url IS NOT NULL").select("url", F.sha2("url", 256).alias("key")).distinct()
    return new_only(keyed, cache, "key").select("url")


def in_chunks(ids: DataFrame, key: str, size: int = 150) -> DataFrame:
    """``(key, chunk)``: distinct keys in order, in chunks of ``size``; each chunk can be asked for and kept on its own."""
    from ..operators.rank import numbered

    rows = numbered(ids.filter(F.col(key).isNotNull()).select(key).distinct(), F.col(key), name="position")
    return rows.select(key, F.floor((F.col("position") - 1) / size).alias("chunk"))


def way_query(box: tuple[float, float, float, float], conditions: list[str]) -> str:
    """Text of a query to a map server for the ways in a box (south, west, north, east) under any of ``conditions``."""
    south, west, north, east = box
    parts = "".join(f"way{c}({south},{west},{north},{east});" for c in conditions)
    return f"[out:json][timeout:150];({parts});out tags center;"


def tiles(box: tuple[float, float, float, float], rows: int = 2, columns: int = 2) -> list[tuple[float, float, float, float]]:
    """``box`` in tiles, so that each can be asked for by a task of its own."""
    south, west, north, east = box
    ys = [south + (north - south) * k / rows for k in range(rows + 1)]
    xs = [west + (east - west) * k / columns for k in range(columns + 1)]
    return [(a, c, b, d) for a, b in zip(ys, ys[1:], strict=False) for c, d in zip(xs, xs[1:], strict=False)]
