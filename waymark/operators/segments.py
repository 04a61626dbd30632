"""Cells that hold several values, as one row per value.

Method: dictionary-guided segmentation. The dictionary holds whole values that contain a separator sign
themselves (names of kinds of work); it is learned from all cells. A multi-pattern automaton finds them in a
cell, dynamic programming picks the cover of non-overlapping known values that covers most, and separators
inside the cover, inside parentheses and inside quotes don't separate.

A dictionary of up to ``BLOCK_TERMS`` terms is one automaton in a broadcast; a larger one is taken in
blocks, one pass over the cells each, before the cover is picked, so its size has no bound.
The work per cell is independent: nothing is shuffled but the learning of the dictionary, which is a
partial aggregation per term.

Defined results:

* null, empty and blank cells and cells with one value yield no row;
* empty pieces count for the position and yield no row;
* blanks separate only in columns declared so, and only where no other separator is beside them;
* a comma between a digit and exactly three digits is part of a number, in columns declared so;
* a quote or parenthesis that is never closed is an ordinary sign;
* repeated rows yield their values each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contains import automaton

BLOCK_TERMS = 50_000
#: A term with separators is known when it begins such a share of the pieces that begin with a term, and so many of them.
SUPPORT_SHARE, MIN_SUPPORT = 1e-4, 3

#: Signs that separate, openers with their closers, quotes with theirs.
SEPARATORS = "|｜／/、､,，・･;；\n\r\t"
#: Of these the ones that never stand inside a value's name, to cut cells before anything is known.
HARD_SEPARATORS = "|｜;；\n\r\t"
BRACKETS = {"（": "）", "(": ")", "［": "］", "[": "]", "〔": "〕", "【": "】"}
QUOTES = {'"': '"', "“": "”", "＂": "＂"}
BLANKS = " 　 "
THOUSANDS = re.compile(r"(?<![0-9０-９,，])[0-9０-９]{1,3}(?:[,，][0-9０-９]{3})+(?![0-9０-９])")


@dataclass(frozen=True)
class Field:
    """A column with packed cells."""

    name: str
    blanks_separate: bool = False
    thousands: bool = False
    dictionary: bool = False


PLAN_FIELDS = (Field("事業内容", dictionary=True), Field("総事業費千円", thousands=True), Field("資料ページ"), Field("関係市町村", blanks_separate=True))


def _closers(cell: str) -> dict[int, int]:
    """For each bracket that is closed the place of its closer; other kinds of brackets between don't matter."""
    ends: dict[int, int] = {}
    for sign, closer in BRACKETS.items():
        if sign in cell and closer in cell:
            open_at: list[int] = []
            for k, c in enumerate(cell):
                if c == sign:
                    open_at.append(k)
                elif c == closer and open_at:
                    ends[open_at.pop()] = k
    return ends


def _quote_end(cell: str, at: int, last: dict[str, int]) -> int:
    """Place of the quote that closes the one at ``at``, doubled ones inside skipped; -1 for none."""
    closer = QUOTES[cell[at]]
    end = cell.find(closer, at + 1) if at < last.setdefault(closer, cell.rfind(closer)) else -1
    while end >= 0 and closer == cell[at] and cell[end + 1 : end + 2] == closer:
        end = cell.find(closer, end + 2)
    return end


def shielded(cell: str) -> bytearray:
    """1 for each sign of ``cell`` that lies in closed quotes or parentheses, these included."""
    mask, at, n = bytearray(len(cell)), 0, len(cell)
    ends, last = _closers(cell), {}
    while at < n:
        end = _quote_end(cell, at, last) if cell[at] in QUOTES else ends.get(at, -1)
        if end > at:
            mask[at : end + 1] = b"\x01" * (end + 1 - at)
            at = end
        at += 1
    return mask


def best_cover(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Non-overlapping spans with the largest sum of squared lengths (so one long value beats its parts)."""
    ending: dict[int, list[int]] = {}
    for a, b in spans:
        ending.setdefault(b, []).append(a)
    best, choice = [0] * (length + 1), [-1] * (length + 1)
    for i in range(1, length + 1):
        best[i] = best[i - 1]
        for a in ending.get(i, ()):
            if best[a] + (i - a) ** 2 > best[i]:
                best[i], choice[i] = best[a] + (i - a) ** 2, a
    cover, i = [], length
    while i > 0:
        if choice[i] >= 0:
            cover.append((choice[i], i))
            i = choice[i]
        else:
            i -= 1
    return cover


def _unquoted(piece: str) -> str:
    piece = piece.strip()
    if len(piece) > 1 and piece[0] in QUOTES and piece[-1] == QUOTES[piece[0]] and all(shielded(piece)):
        quote, inner = piece[0], piece[1:-1]
        return (inner.replace(quote * 2, quote) if QUOTES[quote] == quote else inner).strip()
    return piece


def split_cell(cell: str, field: Field, spans: list[tuple[int, int]] = ()) -> list[str]:
    """Values of a cell in order, empty pieces included; ``spans`` are the known values in it."""
    mask = shielded(cell)
    edge = lambda k: k < 0 or k >= len(cell) or cell[k] in SEPARATORS or cell[k] in BLANKS or cell[k] in BRACKETS or cell[k] in QUOTES
    whole = [(a, b) for a, b in spans if not mask[a] and edge(a - 1) and edge(b)]
    if field.thousands:
        whole += [m.span() for m in THOUSANDS.finditer(cell)]
    for a, b in best_cover(whole, len(cell)):
        mask[a:b] = b"\x01" * (b - a)
    pieces, start, at, n = [], 0, 0, len(cell)
    while at < n:
        if not mask[at] and cell[at] in SEPARATORS:
            pieces.append(cell[start:at])
            if cell[at : at + 2] == "\r\n":
                at += 1
            start = at + 1
        elif field.blanks_separate and not mask[at] and cell[at] in BLANKS:
            end = at
            while end < n and cell[end] in BLANKS:
                end += 1
            if cell[start:at].strip() and end < n and not (cell[end] in SEPARATORS and not mask[end]):
                pieces.append(cell[start:at])
                start = end
            at = end - 1
        at += 1
    pieces.append(cell[start:])
    return [_unquoted(p) for p in pieces]


def learn_terms(cells: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Names with separators in them that begin a share of ``SUPPORT_SHARE`` of the hard-separated pieces that begin
    with a name, ``min_support`` of them being the least evidence on small tables.

    A name whose parts all are names of their own is a list of names, not a name.
    ``cells`` has one column ``cell``.
    """
    brackets = "".join(re.escape(b) for b in BRACKETS)
    hard, soft = "[" + re.escape(HARD_SEPARATORS) + "]", "[" + re.escape("".join(s for s in SEPARATORS if s not in HARD_SEPARATORS)) + "]"
    heads = cells.select(F.explode(F.split("cell", hard)).alias("piece")).select(F.regexp_extract("piece", rf'(?U)^\s*([^{brackets}"“”]*?)\s*[{brackets}]', 1).alias("term")).filter("term <> ''")
    counts = heads.groupBy("term").agg(F.count("*").alias("n"))
    plain = counts.filter(~F.col("term").rlike(soft)).select("term")
    least = counts.agg(F.greatest(F.lit(min_support), F.sum("n") * SUPPORT_SHARE).alias("least"))
    packed = counts.filter(F.col("term").rlike(soft)).join(F.broadcast(least), F.col("n") >= F.col("least")).select("term")
    parts = packed.select("term", F.explode(F.split("term", soft)).alias("part")).withColumn("part", F.trim("part"))
    unknown = parts.filter("part <> ''").join(plain.withColumnRenamed("term", "part"), "part", "left_anti").select("term").distinct()
    return packed.join(unknown, "term", "left_semi").select("term")


def _blocks(terms: Iterator[str], size: int) -> Iterator[list[str]]:
    while block := list(islice(terms, size)):
        yield block


def split_cells(df: DataFrame, row: str, fields: tuple[Field, ...] = PLAN_FIELDS, min_support: int = MIN_SUPPORT, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(row, field, pos, item)`` of all values of the cells that hold at least two."""
    spark = df.sparkSession
    # Row keys travel as texts, lest pandas makes numbers of whole numbers with nulls.
    cells = df.select(F.col(row).cast("string").alias("row_no"), F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"`{f.name}`").cast("string").alias("cell")) for k, f in enumerate(fields)])).alias("c")).select("row_no", "c.f", "c.cell")
    cells = cells.filter("cell IS NOT NULL").withColumn("spans", F.expr("CAST(array() AS ARRAY<ARRAY<INT>>)"))
    guided = [k for k, f in enumerate(fields) if f.dictionary]
    terms = learn_terms(cells.filter(F.col("f").isin(guided)).select("cell"), min_support) if guided else None
    for block in _blocks((r.term for r in terms.toLocalIterator()), block_terms) if guided else ():
        shared, name = spark.sparkContext.broadcast(block), uuid4().hex

        def find(batches: Iterator[pd.DataFrame], shared=shared, name=name) -> Iterator[pd.DataFrame]:
            words = shared.value
            known = automaton(name, words)
            for batch in batches:
                found = []
                for f, cell, spans in zip(batch["f"], batch["cell"], batch["spans"], strict=True):
                    more = [[end + 1 - len(words[k]), end + 1] for end, k in known.iter(cell)] if f in guided else []
                    found.append([list(s) for s in spans] + more)
                yield pd.DataFrame({"row_no": batch["row_no"].astype(object), "f": batch["f"], "cell": batch["cell"].astype(object), "spans": found})

        cells = cells.mapInPandas(find, cells.schema)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {"row_no": [], "field": [], "pos": [], "item": []}
            for row_no, f, cell, spans in zip(batch["row_no"], batch["f"], batch["cell"], batch["spans"], strict=True):
                items = split_cell(cell, fields[f], [(int(a), int(b)) for a, b in spans])
                if sum(map(bool, items)) > 1:
                    for pos, item in enumerate(items, 1):
                        if item:
                            for name, value in zip(out, (row_no, fields[f].name, pos, item), strict=True):
                                out[name].append(value)
            yield pd.DataFrame(out, dtype=object)

    found = cells.mapInPandas(split, "row_no string, field string, pos int, item string")
    return found.select(F.col("row_no").cast(df.schema[row].dataType).alias(row), "field", "pos", "item")
