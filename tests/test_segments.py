"""Packed cells: separators, quotes, parentheses, numbers and known values."""

from __future__ import annotations

import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st

from waymark.operators import segments as s

WORK, COST, PAGE, PLACE = s.PLAN_FIELDS
NAME = "点検診断・保全整備"


def split(cell, field, *terms):
    spans = [(k, k + len(t)) for t in terms for k in range(len(cell)) if cell.startswith(t, k)]
    return s.split_cell(cell, field, spans)


@pytest.mark.parametrize(
    ("cell", "field", "items"),
    [
        ("a | b", WORK, ["a", "b"]),
        ("a || b", WORK, ["a", "", "b"]),
        ("a（x、y）、b(1,2)", WORK, ["a（x、y）", "b(1,2)"]),
        ('"a, b"\n"橋梁 ""29号橋"" 補修、塗装"', WORK, ["a, b", '橋梁 "29号橋" 補修、塗装']),
        ("“a／b”／c", WORK, ["a／b", "c"]),
        ("a（b、c", WORK, ["a（b", "c"]),
        ('a"b、c', WORK, ['a"b', "c"]),
        (f"{NAME}（x）・改良（y）", WORK, [f"{NAME}（x）", "改良（y）"]),
        ("123,173", COST, ["123,173"]),
        ("89596,168584,143453", COST, ["89596", "168584", "143453"]),
        ('"127,495",87572', COST, ["127,495", "87572"]),
        ("64,150 | 81382", COST, ["64,150", "81382"]),
        ("140,973・56482", COST, ["140,973", "56482"]),
        (" | 122915 | 50880", COST, ["", "122915", "50880"]),
        ("10-11 | 57", PAGE, ["10-11", "57"]),
        ("p.21・22頁", PAGE, ["p.21", "22頁"]),
        ("虹谷町 西椿郡杉滝町", PLACE, ["虹谷町", "西椿郡杉滝町"]),
        (" 朱岳市 ・ 樺見市 ", PLACE, ["朱岳市", "樺見市"]),
        ("亀雲村\n\n霧嶺市", PLACE, ["亀雲村", "", "霧嶺市"]),
        ("雷沢市 | 熊楢村・樺見市", PLACE, ["雷沢市", "熊楢村", "樺見市"]),
        ('"椿丘市" 鴨岩町', PLACE, ["椿丘市", "鴨岩町"]),
        ("a\r\nb", WORK, ["a", "b"]),
        ("", WORK, [""]),
        ("　", PLACE, [""]),
    ],
)
def test_split(cell, field, items):
    assert split(cell, field, NAME) == items


def test_best_cover_prefers_the_longest():
    assert s.best_cover([(0, 4), (5, 9), (0, 9)], 9) == [(0, 9)]
    assert s.best_cover([(0, 5), (4, 9)], 9) in ([(0, 5)], [(4, 9)])
    assert s.best_cover([], 5) == []


@given(st.lists(st.text("あ漢ab12", min_size=1, max_size=6), min_size=2, max_size=6), st.sampled_from(["|", " | ", "／", "、", ";", "\n"]))
def test_round_trip(items, separator):
    assert s.split_cell(separator.join(items), WORK) == items


@given(st.text(max_size=40))
def test_any_text(cell):
    for field in s.PLAN_FIELDS:
        s.split_cell(cell, field)


def table(spark, cells):
    data = [(k, c, None, None, None, "x") for k, c in enumerate(cells)]
    return spark.createDataFrame(data, "plan_row long, `事業内容` string, `総事業費千円` string, `資料ページ` string, `関係市町村` string, item string")


@pytest.mark.parametrize("block", [50_000, 1])
def test_learned_names(spark, block):
    cells = [f"{NAME}（a）"] * 3 + ["調査・測量（b）"] * 3 + ["改良（a）"] * 3 + ["改良・舗装（a）"] * 3 + ["舗装（a）"] * 3 + [f"{NAME}（x）・改良（y）・調査・測量（z）・改良・舗装（a）", None, "", "  ", "a|", "長い値" * 5000 + "|b"]
    df = table(spark, cells)
    got = rows(s.split_cells(df, "plan_row", block_terms=block).filter("plan_row = 15"), "pos", "item")
    assert got == [(1, f"{NAME}（x）"), (2, "改良（y）"), (3, "調査・測量（z）"), (4, "改良"), (5, "舗装（a）")]
    assert {r.plan_row for r in s.split_cells(df, "plan_row").collect()} == {9, 10, 11, 15, 20}


def test_empty_table(spark):
    assert s.split_cells(table(spark, []), "plan_row").count() == 0
