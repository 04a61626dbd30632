"""Copies that differ in formatting only, against a plain comparison of normal forms."""

from __future__ import annotations

from waymark.llm import copies as c

COLUMNS = [*c.PLAN.columns]
BASE = ("林道 山線", "甲市 | 乙町", "改良", "改良（法面L=1m／側溝L=2m） | 点検（x）", "R7～R8", "123,456 | 7890", None, "p.1 | 2-3", "県『計画』 https://x.example/A.pdf", "2026-06-10")


def plan(spark, *records):
    fields = "plan_row long, " + ", ".join(f"`{x}` string" for x in COLUMNS) + ", root string, tree string, row string"
    return spark.createDataFrame([(k, *r, "a", "b", "c") for k, r in enumerate(records, 1)], fields)


def changed(**cells):
    return tuple(cells.get(n, v) for n, v in zip(COLUMNS, BASE, strict=True))


def found(spark, *records):
    return sorted((r.first_row, r.copy_row) for r in c.copies(plan(spark, *records), c.PLAN).collect())


COPIES = [
    BASE,
    changed(林道名="林道　山 線。"),
    changed(林道名="山線 林道"),
    changed(林道名="「林道山線」​"),
    changed(関係市町村="乙町、、甲市"),
    changed(関係市町村="乙町 甲市"),
    changed(事業内容="点検（x）\n改良（側溝L=2m／法面L=1m）"),
    changed(総事業費千円='7890、"123456"'),
    changed(総事業費千円="7890/123,456"),
    changed(工期="r7～r8"),
    changed(資料ページ="2-3;Ｐ.1"),
    changed(行政出典="HTTPS://x.example/a.PDF / 県「計画」"),
    changed(ほか表記=" "),
]
NESTED = "舗装(東、(西、南(い;ろ))北) | 点検"
NESTED_COPIES = [NESTED, "点検、舗装（北（（ろ／い）南・西）、東）", "点検、舗装（北（西、（い、ろ）南）、東）", "舗装(東、((い;ろ)南、西)北) | 点検"]
NESTED_OTHERS = ["舗装(東、(西、南)北(い;ろ)) | 点検", "舗装(東、西、南(い;ろ)北) | 点検", "舗装(東、(西、南(い)(は))北) | 点検", "舗装(東、(西、南(い;ろ))北 | 点検"]
NUMBERS = ["1,234,567,890 | 5", "5、1234567890", "1234567890|5"]
OTHER_NUMBERS = ["1,234,567,89 | 5", "1,234,567 | 890 | 5", "12345,678901 | 5", "1,234 | 567,890 | 5"]
OTHERS = [
    changed(林道名="林道 川線"),
    changed(林道名="林道 山2線"),
    changed(総事業費千円="123457 | 7890"),
    changed(総事業費千円="123456"),
    changed(総事業費千円="123456 | 7890 | 7890"),
    changed(事業内容="改良（x） | 点検（法面L=1m／側溝L=2m）"),
    changed(行政出典="県『計画』 https://x.example/B.pdf"),
    changed(ほか表記="あり"),
]


def test_copies(spark):
    assert found(spark, *COPIES) == [(1, k) for k in range(2, len(COPIES) + 1)]


def test_others(spark):
    assert found(spark, BASE, *OTHERS) == []
    assert found(spark, *OTHERS, *OTHERS) == [(k, k + len(OTHERS)) for k in range(1, len(OTHERS) + 1)]


def test_parentheses_within_parentheses(spark):
    cells = [changed(事業内容=x) for x in NESTED_COPIES + NESTED_OTHERS]
    assert found(spark, *cells) == [(1, k) for k in range(2, len(NESTED_COPIES) + 1)]


def test_long_numbers(spark):
    cells = [changed(総事業費千円=x) for x in NUMBERS + OTHER_NUMBERS]
    assert found(spark, *cells) == [(1, k) for k in range(2, len(NUMBERS) + 1)]


def test_null_records(spark):
    nothing = (None,) * len(COLUMNS)
    blank = ("",) * len(COLUMNS)
    assert found(spark, nothing, BASE, blank, nothing) == [(1, 3), (1, 4)]
    assert found(spark) == []


def test_collapsed(spark):
    got = c.collapsed(plan(spark, BASE, OTHERS[0], *COPIES), c.PLAN)
    assert sorted((r.plan_row, r.n_copies) for r in got.collect()) == [(1, 1 + len(COPIES)), (2, 1)]


def test_colliding_digests_stay_apart(spark, monkeypatch):
    real = c.record_trees
    from pyspark.sql import functions as F

    monkeypatch.setattr(c, "record_trees", lambda df, layout: real(df, layout).withColumn("root", F.lit(1).cast("long")))
    assert found(spark, BASE, OTHERS[0], BASE, OTHERS[0], OTHERS[1]) == [(1, 3), (2, 4)]


def test_hot_group(spark):
    from waymark.operators import skew

    least = skew.join_to_lookup.__defaults__
    try:
        skew.join_to_lookup.__defaults__ = (*least[:1], 0.1, 5)
        assert found(spark, *[BASE] * 30, *OTHERS) == [(1, k) for k in range(2, 31)]
    finally:
        skew.join_to_lookup.__defaults__ = least


def test_long_cell(spark):
    long = changed(事業内容=" | ".join(f"改良（L={k}m）" for k in range(2000)))
    turned = changed(事業内容=" / ".join(f"改良(L={k}m)" for k in reversed(range(2000))))
    assert found(spark, long, turned) == [(1, 2)]
