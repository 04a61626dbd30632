"""Records that are copies of each other but for their formatting.

Method: Merkle-style bottom-up hashing. Leaves are normalised, the digests of children are sorted at unordered
nodes (the parts of a cell, the parts within parentheses at any depth), columns are an ordered node, and records with the
same root digest are confirmed by comparing their whole normalised structure.

A leaf is its text without blanks, punctuation and letter case, in the skeleton of ``lookalikes``. A cell is
parted at separators; a thousands comma isn't one, nor is anything within parentheses, whose own parts are children
of theirs; an address (URL) is a part; a generic word before or after a name is the same part.

Roots are counted first, and only records whose root occurs again are compared. Groups are aggregated with
map-side combine and joined back, hot groups by broadcast, so a group that holds a third of all records never meets
in one task.

Defined results: a null cell equals an empty or blank one; repeated parts count as often as they occur; exact
copies count; ``first`` is the smallest row key; an empty table has no copies.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.skew import join_to_lookup
from ..session import cut_lineage
from .lookalikes import TWIN_KANA, TWIN_KANJI, plain

#: In the plain form; separators part a cell, but not within parentheses.
SEPARATORS = r"[|/、,;\n\r\t・]"
ADDRESS = r"https?:[^\s|、;「『]+"
#: Signs between children, parts and columns of a written structure, and around children within children; no leaf holds
#: them, as control signs are formatting.
CHILD, PART, COLUMN = "\x1f", "\x1e", "\x1d"
OPEN, CLOSE, INNER_OPEN, INNER_CLOSE, INNER_CHILD = "\x01", "\x02", "\x03", "\x04", "\x05"
#: Formatting that structure is read from; all other formatting is dropped before.
STRUCTURE = " \n\r\t、・「」『』" + string.punctuation
THOUSANDS, DIGITS = r"(?<![0-9,])[0-9]{1,3}(?:,[0-9]{3})+(?![0-9])", r"[0-9]+|[^0-9]+"
GENERIC = "林道"


@dataclass(frozen=True)
class Layout:
    """How the columns of a table are to be read; others are plain lists of parts."""

    row: str
    columns: tuple[str, ...]
    names: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    blank_lists: tuple[str, ...] = ()
    #: Cells of one text and addresses: apart from these they have no parts.
    sources: tuple[str, ...] = ()


CANDIDATES = Layout("cand_row", ("ID", "林道名", "取得元"), names=("林道名",), sources=("取得元",))
PLAN = Layout("plan_row", ("林道名", "関係市町村", "事業型", "事業内容", "工期", "総事業費千円", "ほか表記", "資料ページ", "行政出典", "確認日"), names=("林道名",), numbers=("総事業費千円",), blank_lists=("関係市町村",), sources=("行政出典",))


@cache
def _dropped() -> str:
    """Blanks, punctuation, symbols and control signs but those of ``STRUCTURE``."""
    kinds = ("P", "S", "Z", "Cc")
    return "".join(chr(c) for c in range(0x20000) if chr(c) not in STRUCTURE and unicodedata.category(chr(c)).startswith(kinds))


def cell_text(cell: Column) -> Column:
    """Cell in the form that leaves are read from: skeleton without letter case and without formatting that says nothing."""
    return F.lower(F.translate(plain(F.coalesce(cell, F.lit(""))), TWIN_KANJI + _dropped(), TWIN_KANA))


def leaf(text: Column) -> Column:
    """A piece of ``cell_text`` without anything that formatting adds or takes."""
    return F.regexp_replace(text, f"[{re.escape(STRUCTURE)}]+", "")


def _parts(text: Column, separators: str) -> Column:
    return F.filter(F.split(text, separators), lambda p: leaf(p) != "")


def _node(part: Column) -> Column:
    """``struct<digest, form>`` of a part: its own text, and the sorted children of its collapsed parentheses."""
    marked = f"{OPEN}([^{OPEN}{CLOSE}]*){CLOSE}"
    forms = F.filter(F.flatten(F.transform(F.regexp_extract_all(part, F.lit(marked), F.lit(1)), lambda g: F.split(g, CHILD))), lambda c: c != "")
    ordered = F.sort_array(F.transform(forms, lambda c: F.struct(F.xxhash64(c).alias("digest"), c.alias("form"))))

    def node(n: Column) -> Column:
        inner = F.concat(F.lit(INNER_OPEN), F.array_join(F.transform(n["c"], lambda c: c["form"]), INNER_CHILD), F.lit(INNER_CLOSE))
        return F.struct(F.xxhash64(n["h"], F.transform(n["c"], lambda c: c["digest"])).alias("digest"), F.concat(n["h"], inner).alias("form"))

    alone = lambda h: F.struct(F.xxhash64(h).alias("digest"), h.alias("form"))
    return F.when(F.contains(part, F.lit(OPEN)), let(F.struct(leaf(F.regexp_replace(part, marked, "")).alias("h"), ordered.alias("c")), node)).otherwise(let(leaf(part), alone))


def _collapsed(text: Column) -> Column:
    """``text`` with the parentheses that hold none replaced by the written structure of what they hold."""

    def group(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
        forms = F.filter(F.transform(_parts(inner, SEPARATORS), lambda p: _node(p)["form"]), lambda f: f != "")
        return F.concat(F.lit(OPEN), F.array_join(forms, CHILD), F.lit(CLOSE))

    pieces = F.regexp_extract_all(text, F.lit(r"(\([^()]*\)|[^()]+|[()])"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\(.*\)$"), group(p)).otherwise(p)), "")


def _without_parentheses(text: Column) -> Column:
    """``text`` with all closed parentheses collapsed, from the innermost outwards; open ones are ordinary signs."""
    closed = r"\([^()]*\)"

    def collapse(t: Column) -> Column:
        levels = F.sequence(F.lit(1), F.length(t) - F.length(F.replace(t, F.lit("("), F.lit(""))))
        return F.aggregate(levels, t, lambda now, _: F.when(now.rlike(closed), _collapsed(now)).otherwise(now))

    return let(text, lambda t: F.when(t.rlike(closed), collapse(t)).otherwise(t))


def _plain_numbers(text: Column) -> Column:
    """``text`` without the commas within numbers."""
    pieces = F.regexp_extract_all(text, F.lit(f"({THOUSANDS}|{DIGITS})"), F.lit(1))
    joined = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{THOUSANDS}$"), F.replace(p, F.lit(","), F.lit(""))).otherwise(p)), "")
    return F.when(F.contains(text, F.lit(",")), joined).otherwise(text)


def cell_tree(text: Column, name: bool = False, number: bool = False, blank_list: bool = False, source: bool = False) -> Column:
    """``array<struct<digest, form>>`` of a ``cell_text``: digest and written structure of each part, ordered by digest."""
    outside = rf"(?:{SEPARATORS}| +)" if blank_list else SEPARATORS

    def parts(text: Column) -> Column:
        present = lambda p: F.filter(F.array(p), lambda x: x != "")
        if name:
            return present(F.regexp_replace(leaf(text), f"^{GENERIC}(.+)$", f"$1{GENERIC}"))
        if source:
            return F.concat(_addresses(text), present(leaf(F.regexp_replace(text, ADDRESS, ""))))
        if number:
            return _parts(_without_parentheses(_plain_numbers(text)), outside)
        apart = F.when(F.contains(text, F.lit("http")), F.regexp_replace(text, ADDRESS, "|")).otherwise(text)
        return F.concat(_addresses(text), _parts(_without_parentheses(apart), outside))

    return F.sort_array(F.transform(parts(text), _node))


def _addresses(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({ADDRESS})"), F.lit(1))
    return F.when(F.contains(text, F.lit("http")), found).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))


def _kind(layout: Layout, column: str) -> tuple[bool, bool, bool, bool]:
    return column in layout.names, column in layout.numbers, column in layout.blank_lists, column in layout.sources


def _tree_of(kind: tuple[bool, bool, bool, bool]) -> Callable[[Column], Column]:
    return lambda text: cell_tree(text, *kind)


def record_columns(layout: Layout) -> tuple[Column, Column, Column]:
    """``texts`` of a record's cells, and from them its ``root`` and its written structure ``tree``.

    One expression for the signs of all cells and one for the trees of all columns of a kind, so that neither stands in the
    plan, nor is built, once per column.
    """
    kinds: dict[tuple, list[str]] = {}
    for c in layout.columns:
        kinds.setdefault(_kind(layout, c), []).append(c)
    ordered = [c for columns in kinds.values() for c in columns]
    texts = F.transform(F.array(*[F.col(f"`{c}`").cast("string") for c in ordered]), cell_text)
    cells, at = [], 1
    for kind, columns in kinds.items():
        cells.append(F.transform(F.slice("texts", at, len(columns)), _tree_of(kind)))
        at += len(columns)
    trees = F.concat(*cells)
    root = F.xxhash64(F.transform(F.col("trees"), lambda cell: F.xxhash64(F.transform(cell, lambda n: n["digest"]))))
    tree = F.array_join(F.transform(F.col("trees"), lambda cell: F.array_join(F.transform(cell, lambda n: n["form"]), PART)), COLUMN)
    return texts, trees, F.struct(root.alias("root"), tree.alias("tree"))


@lru_cache(maxsize=8)
def _columns_of(layout: Layout, session: SparkSession) -> tuple[Column, Column, Column]:
    """``record_columns``, built once per session: thousands of calls to the JVM."""
    return record_columns(layout)


def record_trees(df: DataFrame, layout: Layout) -> DataFrame:
    """``(row, root, tree)`` of each record: the digest of its columns' digests, and its written structure."""
    texts, trees, record = _columns_of(layout, df.sparkSession)
    wide = df.select(F.col(layout.row).alias("row"), texts.alias("texts")).select("row", trees.alias("trees"))
    return wide.select("row", record.alias("r")).select("row", "r.root", "r.tree")


def repeated_groups(df: DataFrame, layout: Layout) -> DataFrame:
    """``(row, first)`` of the records that have copies."""
    roots = cut_lineage(record_trees(df, layout).select("row", "root"))
    shared = roots.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    # Only the records whose root occurs again are written out and compared.
    rows = join_to_lookup(roots, shared, "root").select(F.col("row").alias(layout.row)).distinct()
    again = cut_lineage(record_trees(df.join(rows, layout.row, "left_semi"), layout))
    groups = again.groupBy("root", "tree").agg(F.min("row").alias("first"))
    per_root = groups.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("kinds"))
    marked = join_to_lookup(again.select("row", "root"), per_root.filter("kinds = 1").select("root", "first"), "root").select("row", "first")
    # Roots that met by chance: their structures decide.
    collided = again.join(per_root.filter("kinds > 1").select("root"), "root", "left_semi")
    apart = collided.join(groups, ["root", "tree"]).select("row", "first")
    return marked.unionByName(apart)


def copies(df: DataFrame, layout: Layout) -> DataFrame:
    """``(first_row, copy_row)``: each record that has a copy with a smaller row key."""
    return repeated_groups(df, layout).filter("row > first").select(F.col("first").alias("first_row"), F.col("row").alias("copy_row"))


def collapsed(df: DataFrame, layout: Layout) -> DataFrame:
    """``df`` with one record per group of copies and ``n_copies``, the number of records it stands for."""
    counts = copies(df, layout)
    dropped = counts.select(F.col("copy_row").alias(layout.row))
    n = counts.groupBy("first_row").agg((F.count("*") + 1).alias("n_copies")).withColumnRenamed("first_row", layout.row)
    return df.join(dropped, layout.row, "left_anti").join(n, layout.row, "left").withColumn("n_copies", F.coalesce("n_copies", F.lit(1)).cast("long"))
