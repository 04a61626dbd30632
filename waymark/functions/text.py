"""Text expressions on columns; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms of the printable ASCII signs, by their fixed distance.
WIDE_ASCII = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
NARROW_ASCII = "".join(chr(c) for c in range(0x21, 0x7F))

#: Blanks other than U+0020 that Unicode calls spaces.
OTHER_BLANKS = "  " + "".join(chr(c) for c in range(0x2000, 0x200B)) + "  　"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_width(text: Column) -> Column:
    """Full-width ASCII signs as half-width ones and any space as U+0020."""
    return F.translate(text, WIDE_ASCII + OTHER_BLANKS, NARROW_ASCII + " " * len(OTHER_BLANKS))


def trim_blanks(text: Column) -> Column:
    """``text`` without any white space, including the ideographic one, around it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    """Null for null, empty and all-blank texts, else the text as it is."""
    return F.when(text.rlike(r"(?U)\S"), text)


def reference_key(text: Column) -> Column:
    """Key under which IDs that differ in width, case or blanks around them are one; null for none."""
    key = F.upper(trim_blanks(fold_width(text)))
    return F.when(key != "", key)
