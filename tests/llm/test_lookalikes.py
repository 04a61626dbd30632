"""Look-alike names: characters one by one, twins in context, and whole classes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from waymark.llm import lookalikes as a

#: Enough names for words of kana and isolated twins to be learned.
BACKGROUND = [f"カラマツ{x}口線" for x in "山川谷沢森林"] + [f"タカネ{x}八線" for x in "山川谷沢森林"] + [f"ロクロ{x}夕二線" for x in "山川谷沢森林"] + [f"ゴーロ{x}一号線" for x in "山川谷沢森林"]


def forms(spark, names):
    data = [(k, n, "x", "y") for k, n in enumerate([*BACKGROUND, *names])]
    df = spark.createDataFrame(data, "row long, name string, canonical string, usual string")
    got = {r.row: r.canonical for r in a.in_one_form(df, "name").collect()}
    return [got[k] for k in range(len(BACKGROUND), len(data))]


def test_forms(spark):
    cases = {
        "林道　山線": "林道 山線",
        "Ａ１山線": "A1山線",
        "ｶﾗﾏﾂ山口線": "カラマツ山口線",
        "ｶﾞﾚ山": "ガレ山",
        "ガレ": "ガレ",
        "山​線️": "山線",
        "⼭⾕⻑線": "山谷長線",
        "金線": "金線",
        "Α山Т線": "A山T線",
        "κ山т線": "k山t線",
        "（山）": "(山)",
        "山･川": "山・川",
        "力ラマツ山口線": "カラマツ山口線",
        "タ力ネ山八線": "タカネ山八線",
        "山ロ線": "山口線",
        "ハ山線": "八山線",
        "カラマツタ口線": "カラマツ夕口線",
        "ゴ一ロ山線": "ゴーロ山線",
        "口クロ山線": "ロクロ山線",
        "カ-ラマツ山ロ線": "カ-ラマツ山口線",
    }
    assert dict(zip(cases, forms(spark, list(cases)), strict=True)) == cases


def test_kept(spark):
    kept = ["澤嶽線", "山ヶ谷", "山ケ谷", "山が谷", "山ガ谷", "山ノ谷", "m線", "M線", "  山 線 ", "「山」線。", "山・川", "é", "ゴーロ川一号線", "カラマツ森口線", "", None]
    assert forms(spark, kept) == kept


def test_a_misprint_is_no_word_however_common(spark):
    right = [f"{x}{run}{y}線" for run in ("ノ口", "ヶ八", "コロ") for x in "桑梅桃" for y in "東西南北"]
    wrong = [f"{x}{run}線" for run in ("ノロ", "ヶハ", "コ口") for x in "杉松桧楢樺栗"]
    usual = {"ノロ": "ノ口", "ヶハ": "ヶ八", "コ口": "コロ"}
    assert forms(spark, right + wrong) == right + [w[0] + usual[w[1:3]] + w[3:] for w in wrong]


def test_class_has_one_form(spark):
    got = forms(spark, ["ｶﾗﾏﾂ谷線", "カラマツ谷線", "力ラマツ谷線", "カラマツ‍谷線"] * 2)
    assert set(got) == {"カラマツ谷線"}


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "row long, name string")
    assert a.in_one_form(empty, "name").count() == 0
    assert forms(spark, ["Ｂ" + "山" * 20_000]) == ["B" + "山" * 20_000]


@pytest.mark.parametrize(("text", "whole"), [("ハ\u3099ヒ\u3099", "バビ"), ("ハ\u309aヒ\u3099x", "パビx"), ("か\u3099", "が"), ("ﾊﾟﾋﾞ", "パビ"), ("ハ", "ハ"), ("カ゛", "ガ")])
def test_marks(spark, text, whole):
    assert spark.range(1).select(a.plain(F.lit(text))).first()[0] == whole
