"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows, so there are fewer than ``1 / HOT_SHARE`` hot keys.
HOT_SHARE = 0.01
#: Keys with at most so many rows are never hot.
HOT_ROWS = 10_000


def hot_values(rows: DataFrame, key: str, share: float = HOT_SHARE, least: int = HOT_ROWS) -> list:
    """Values of ``key`` that hold more than ``share`` of ``rows``; fewer than ``1 / share``."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    large = counts.filter(F.col("n") > least)
    total = rows.count() if not large.isEmpty() else 0
    return [r[0] for r in large.filter(F.col("n") > share * total).select(key).collect()]


def join_to_lookup(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined to ``lookup``, which has at most one row per ``key``.

    The hot keys' lookup rows, fewer than ``1 / share``, are broadcast, so their rows aren't shuffled; the others meet
    by a shuffled join.
    """
    hot = hot_values(rows, key, share, least)
    if not hot:
        return rows.join(lookup, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(lookup.filter(F.col(key).isin(hot)))
    return rows.filter(~is_hot).join(lookup.filter(~is_hot), key, how).unionByName(rows.filter(is_hot).join(few, key, how))
