"""Normal forms of road names and parts of names."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import fold_width, trim_blanks


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form; the one normal form that Spark has no expression for."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@dataclass(frozen=True)
class NameRules:
    """What a normal form drops and replaces, in this order."""

    replace: tuple[tuple[str, str], ...]
    drop: str
    last: str | None = None
    trim: bool = True


#: The four normal forms in use; they are not interchangeable.
VARIANTS = {
    "a": NameRules((("林道", ""), ("澤", "沢"), ("ヶ", "ケ"), ("ヵ", "カ")), r"[\s・･]", "線$"),
    "b": NameRules((("（", "("), ("）", ")"), ("林道", ""), ("澤", "沢"), ("ヶ", "ケ"), ("ヵ", "カ")), r"[\s・･·]", "線$"),
    "c": NameRules((("林道", ""), ("線", ""), ("支", ""), ("澤", "沢"), ("ヶ", "ケ"), ("ガ", "カ")), r"[\s・･]", "[0-9]+号$"),
    "d": NameRules((("林道", ""), ("澤", "沢"), ("ヶ", "ケ"), ("ガ", "カ")), " ", None, trim=False),
}


def normal_name(name: Column, variant: str = "a", fold=nfkc) -> Column:
    """Normal form ``variant`` of a name; ``fold`` makes characters alike first."""
    rules = VARIANTS[variant]
    text = fold(name)
    if rules.trim:
        text = F.trim(text)
    for off, on in rules.replace:
        text = F.replace(text, F.lit(off), F.lit(on))
    text = F.regexp_replace(text, rules.drop, "")
    return F.regexp_replace(text, rules.last, "") if rules.last else text


def width_name(name: Column, variant: str = "a") -> Column:
    """As ``normal_name`` with only the width of signs folded; stays in the JVM."""
    return normal_name(name, variant, fold_width)


def aliases(name: Column) -> Column:
    """Distinct spellings to look a name up under: as it is, without parentheses, without prefix and suffix."""
    bare = F.regexp_replace(name, "[（(][^（）()]*[）)]", "")
    short = F.regexp_replace(F.regexp_replace(bare, "^林道", ""), "線$", "")
    return F.array_distinct(F.filter(F.transform(F.array(name, bare, short), lambda x: trim_blanks(x)), lambda x: x != ""))


def stem_and_flag(name: Column, prefix: str = "林道", suffix: str = "ほか") -> Column:
    """``struct<stem, others>`` of a name with a fixed prefix and, if there are others, a suffix; null without prefix."""
    text = F.regexp_replace(name, r"\s", "")
    rest = F.substring(text, len(prefix) + 1, 1_000_000)
    others = F.endswith(rest, F.lit(suffix))
    stem = F.when(others, F.left(rest, F.length(rest) - len(suffix))).otherwise(rest)
    return F.when(F.startswith(text, F.lit(prefix)), F.struct(stem.alias("stem"), others.alias("others")))


def name_likeness(a: Column, b: Column) -> Column:
    """100 for equal names, 80 where the first holds the second, 60 the other way, else -1."""
    return F.when(a == b, 100).when(F.contains(a, b), 80).when(F.contains(b, a), 60).otherwise(-1)


def bracketed_name(text: Column, prefix: str = "林道", suffix: str = "ほか", reject: str | None = None) -> Column:
    """``struct<stem, others>``: the name in parentheses that begins with ``prefix``, else the text as such a name.

    Null where neither is one, or where ``reject`` matches the text.
    """
    inside = F.regexp_extract(text, f"[（(]({prefix}[^（）()]*)[）)]", 1)
    found = F.coalesce(stem_and_flag(F.when(inside != "", inside), prefix, suffix), stem_and_flag(text, prefix, suffix))
    return F.when(~F.coalesce(text.rlike(reject), F.lit(False)), found) if reject else found


def first_contained(text: Column, literals: list[str], default: str | None = None) -> Column:
    """The first of ``literals`` that stands in ``text``, else ``default``."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(x)), F.lit(x)) for x in literals], F.lit(default))
