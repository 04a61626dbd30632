"""Evidence on candidates: which of it counts, what it adds up to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(cls: Column, confidence: Column, url: Column) -> Column:
    """Independent evidence: not of the class it is to confirm, not ambiguous, with an address. Null classes count."""
    return ~cls.eqNullSafe("osm") & ~confidence.eqNullSafe("ambiguous-same-name") & url.isNotNull() & (url != "")


def ambiguous(df: DataFrame, name: str, within: list[str]) -> DataFrame:
    """``df`` with ``confidence``: ambiguous where several rows share a name within a place and document.

    Names are counted by an aggregation and joined back, so a name on very many rows is no hot window.
    """
    counts = df.groupBy(*within, name).agg(F.count("*").alias("__n"))
    return df.join(counts, [*within, name]).withColumn("confidence", F.when(F.col("__n") > 1, "ambiguous-same-name").otherwise("exact-direct")).drop("__n")


def occurs(text: Column, needle: Column, raw: Column, context: Column, shortest: int = 4) -> Column:
    """Whether a name stands in a text; a short one must stand there in its raw form and in context."""
    return F.when(needle == "", False).when(F.length(needle) < shortest, F.contains(text, raw) & context).otherwise(F.contains(text, needle))


@dataclass(frozen=True)
class Grades:
    """How much evidence the grades take."""

    attributes: int = 2
    official: int = 1
    domains: int = 2


def graded(candidates: DataFrame, evidence: DataFrame, key: str, grades: Grades = Grades()) -> DataFrame:  # noqa: B008
    """``(key, evidence, official, domains, attributes, level)`` of each candidate.

    ``candidates`` has ``key, placed`` (whether its position is known), ``evidence`` has ``key, cls, conf, url, dom,
    direct, attribute``. One pass over the evidence with map-side combine, then one join.
    """
    usable = is_usable(F.col("cls"), F.col("conf"), F.col("url"))
    direct = usable & F.col("direct")
    sums = evidence.groupBy(key).agg(
        F.count_if(usable).alias("evidence"),
        F.count_if(direct & (F.col("cls") == "official")).alias("official"),
        F.count_distinct(F.when(direct, F.col("dom"))).alias("domains"),
        F.count_distinct(F.when(usable, F.col("attribute"))).alias("attributes"),
    )
    df = candidates.join(sums, key, "left").fillna(0, ["evidence", "official", "domains", "attributes"])
    basic = F.col("placed") | (F.col("official") > 0)
    first = (F.col("evidence") > 0) & basic
    second = first & F.col("placed") & (F.col("attributes") >= grades.attributes) & ((F.col("official") >= grades.official) | (F.col("domains") >= grades.domains))
    return df.withColumn("level", F.when(second, "Lv2").when(first, "Lv1").otherwise("Lv0"))


def weighted(rules: dict[str, tuple[Column, int]]) -> Column:
    """Sum of the weights of the conditions that hold."""
    total = F.lit(0)
    for condition, weight in rules.values():
        total = total + F.when(condition, weight).otherwise(0)
    return total


def sentences(*parts: Column, end: str = "。") -> Column:
    """The sentences that aren't null, each ended."""
    present = F.filter(F.array(*parts), lambda p: p.isNotNull())
    return F.when(F.size(present) > 0, F.concat(F.array_join(present, end), F.lit(end))).otherwise("")


def evidence_row(text: Column, attributes: Column, most: int = 500) -> Column:
    """``struct<excerpt, attributes>``: blanks collapsed and cut to ``most`` signs; distinct attributes in order, no empty ones."""
    excerpt = F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(most))
    kept = F.array_distinct(F.filter(attributes, lambda a: a.isNotNull() & (a != "")))
    return F.struct(excerpt.alias("excerpt"), kept.alias("attributes"))
