"""Constraints as queries: every violation is a row ``(rule, key)``, so all show at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import LATITUDES, LONGITUDES


def violated(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Rows of ``df`` that break a rule; a rule is a condition that must not hold (null counts as not holding)."""
    names = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    return df.select(F.col(key).cast("string").alias("key"), F.explode(F.filter(names, lambda n: n.isNotNull())).alias("rule")).select("rule", "key")


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def repeated(df: DataFrame, key: str, rule: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), "key")


def missing(df: DataFrame, column: str, key: str, known: DataFrame, known_key: str, rule: str) -> DataFrame:
    """Rows whose non-null reference isn't among the known keys."""
    keys = known.select(F.col(known_key).alias(column)).distinct()
    return df.filter(F.col(column).isNotNull()).join(keys, column, "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def bad_coordinates(lat: Column, lon: Column) -> dict[str, Column]:
    """Rules for a pair of coordinates given as texts."""
    y, x = lat.try_cast("double"), lon.try_cast("double")
    return {
        "coordinate alone": is_blank(lat) != is_blank(lon),
        "coordinate not a number": (~is_blank(lat) & y.isNull()) | (~is_blank(lon) & x.isNull()),
        "coordinate out of range": ~y.between(*LATITUDES) | ~x.between(*LONGITUDES),
    }


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(rule, key)``: columns that ``df`` lacks."""
    lacking = [(f"column {c} is missing", c) for c in columns if c not in df.columns]
    return df.sparkSession.createDataFrame(lacking, "rule string, key string")


def not_among(column: str, allowed: list[str]) -> Column:
    """Whether a value isn't one of ``allowed``; null isn't."""
    return ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))


def too_few(df: DataFrame, condition: Column, least: int, rule: str) -> DataFrame:
    """One violation, with the number found as its key, if fewer than ``least`` rows meet ``condition``."""
    return df.agg(F.count_if(condition).alias("n")).filter(F.col("n") < least).select(F.lit(rule).alias("rule"), F.col("n").cast("string").alias("key"))


def capped(violations: DataFrame, most: int = 100) -> DataFrame:
    """The first ``most`` violations by rule and key, and a row that tells how many more there are; the cap is the report's."""
    shown = violations.orderBy("rule", "key").limit(most)
    more = violations.agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.lit("more").alias("rule"), (F.col("n") - most).cast("string").alias("key"))
    return shown.unionByName(more)
