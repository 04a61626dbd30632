"""Linkage: parts of names, edits, and links that must and must not be."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from waymark.llm import linkage as k

PLAN = "plan_row long, name string, municipalities string, stem string, road string"
MAP = "map_row long, road string, name string, municipality string, source string, entity string"


@pytest.mark.parametrize(
    ("name", "parts"),
    [
        ("林道 亀低霧柳嶽線", ("亀低霧柳岳", "")),
        ("亀低霧柳岳線(林道)", ("亀低霧柳岳", "")),
        ("右ヶ桂田一号線", ("右ガ桂田", "1")),
        ("右が桂田第１線", ("右ガ桂田", "1")),
        ("山谷第十二支線", ("山谷", "12/支")),
        ("山谷7号支線", ("山谷", "7/支")),
        ("山谷支", ("山谷", "支")),
        ("山谷Ａ線", ("山谷", "A")),
        ("山谷a線", ("山谷", "A")),
        ("山之谷", ("山ノ谷", "")),
        ("山二十号線", ("山", "20")),
        ("", ("", "")),
    ],
)
def test_parts(spark, name, parts):
    got = spark.range(1).select(k.name_parts(F.lit(name)).alias("p")).first().p
    assert (got.stem, got.tail.strip("/").replace("//", "/")) == parts


@pytest.mark.parametrize(("a", "b", "n"), [("abcde", "abcde", 0), ("abcde", "abde", 1), ("abcde", "abdce", 1), ("abcde", "abXde", 1), ("abcde", "bacXe", 2), ("abc", "", 3), ("aab", "aba", 1), ("abc", "cab", 2), ("ca", "abc", 3), ("", "", 0)])
def test_edits(spark, a, b, n):
    assert spark.range(1).select(k.edits(F.lit(a), F.lit(b))).first()[0] == n
    assert edits(a, b) == n


def edits(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if min(i, j) > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edits_like_a_plain_table(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 8)))
    pairs = [(word(), word()) for _ in range(300)] + [("abcdef", "fedcba")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(k.edits(F.col("a"), F.col("b"))).collect()] == [edits(a, b) for a, b in pairs]


@pytest.mark.parametrize(("text", "key"), [("樺嶺県東雁郡鶴霜村", "鶴霜"), ("鶴霜", "鶴霜"), ("\"椿丘市\"", "椿丘"), ("樺嶺県椿丘市 ", "椿丘"), ("", None), ("　", None)])
def test_municipality(spark, text, key):
    assert spark.range(1).select(k.municipality_key(F.lit(text))).first()[0] == key


ROADS = [
    (1, "R1", "林道山川谷沢森線", "甲山市", None),
    (2, "R1", "山川谷森沢線", "甲山市", None),
    (3, "R2", "山川谷沢森1号線", "甲山市", None),
    (4, "R3", "山川谷沢森支線", "甲山市", None),
    (5, "R4", "山川谷沢森線", "乙川町", None),
    (6, "R5", "月星雲霧露線", None, "丙谷村「計画」 https://x.example"),
    (7, "R6", "虹雷雨雪風線", None, None),
    (8, "R7", None, "甲山市", None),
    (9, None, "桃栗柿梨桜線", "甲山市", None),
]


def link(spark, plan, roads=ROADS):
    p = spark.createDataFrame([(i, n, m, "x", "y") for i, (n, m) in enumerate(plan, 1)], PLAN)
    m = spark.createDataFrame([(*r, "x") for r in roads], MAP)
    return sorted((r.plan_row, r.map_row) for r in k.link(p, m).collect())


CASES = [
    ("山川谷沢森", "甲山市", [1, 2]),
    ("山川谷沢森線", "甲山", [1, 2]),
    ("山川谷沢第1線", "甲山市", [3]),
    ("山川谷沢第2線", "甲山市", []),
    ("山川谷沢森第１線", "丁田村 | 甲山市", [3]),
    ("山川谷沢森一号線", "甲山市", [3]),
    ("山川谷沢森支線", "東郡甲山市", [4]),
    ("山川谷沢森線", "乙川町", [5]),
    ("山川谷沢森線", "戊森村", []),
    ("山川沢谷森線", "甲山市", [1, 2]),
    ("月星雲霧露", "丙谷村", [6]),
    ("虹雷雨雪風線", "丙谷村", [7]),
    ("虹雷雨雪風2号線", "丙谷村", []),
    ("桃栗柿梨桜", "甲山市", [9]),
    ("空海島岬浜線", "甲山市", []),
    (None, "甲山市", []),
    ("", "甲山市", []),
    ("月星雲霧露線", None, [6]),
]


def test_links(spark):
    got = link(spark, [(name, place) for name, place, _ in CASES])
    assert got == [(i, m) for i, (_, _, found) in enumerate(CASES, 1) for m in found]


def test_copies_and_empty(spark):
    assert link(spark, [("山川谷沢森", "甲山市")] * 3) == [(i, m) for i in (1, 2, 3) for m in (1, 2)]
    assert link(spark, []) == []
    assert link(spark, [("山川谷沢森", "甲山市")], []) == []


def test_scores_go_on_over_neighbours(spark):
    # Each spelling is one edit from the one before; only the first two are links of their own.
    road, signs = list("甲乙丙丁戊己庚"), "子丑寅卯辰巳午未申酉"
    chain = []
    for i, sign in enumerate(signs):
        road[i % 7] = sign
        chain.append("".join(road))
    roads = [(1, "R1", "甲乙丙丁戊己庚線", "甲山市", None), (2, "R2", "山川谷沢森線", "甲山市", None)]
    assert link(spark, [(n, "甲山市") for n in chain], roads) == [(i, 1) for i in range(1, 11)]
    # Without the ones between, in another municipality and with another number nothing is passed on.
    assert link(spark, [(chain[-1], "甲山市"), (chain[0], "乙川町"), (chain[0] + "2号線", "甲山市")], roads) == []
    # Short names pass nothing on: one edit of four signs isn't sure.
    short = [(1, "R1", "甲乙丙丁線", "甲山市", None)]
    assert link(spark, [("甲乙丙戊", "甲山市"), ("甲乙己戊", "甲山市")], short) == [(1, 1)]


def test_a_neighbour_speaks_for_its_own_road(spark):
    roads = [(1, "R1", "甲乙丙丁戊己線", "甲山市", None), (2, "R2", "子丑丙丁寅卯線", "甲山市", None)]
    # The last is two edits from the first road and three from the second, whose spelling it is one edit from.
    plan = [("子丑丙丁戊卯", "甲山市"), ("子丑丙丁戊己", "甲山市")]
    assert link(spark, plan, roads) == [(1, 2), (2, 2)]


def test_confidence(spark):
    p = spark.createDataFrame([(1, "山川谷沢森", "甲山市"), (2, "山川谷沢木", "甲山市")], "plan_row long, name string, municipalities string")
    m = spark.createDataFrame(ROADS, "map_row long, road string, name string, municipality string, source string")
    got = {r.plan_row: r.confidence for r in k.link(p, m).collect()}
    assert got[1] == 1.0
    assert 0.6 <= got[2] < 1.0


def alike(a, b):
    return 1.0 if a == b else 1 - edits(a, b) / min(max(len(a), len(b)), k.FULL_LENGTH)


def test_no_link_is_missed(spark):
    rnd = random.Random(5)
    name = lambda n: "".join(rnd.choice("甲乙丙丁戊己庚辛壬癸子丑") for _ in range(n))
    roads = sorted({name(rnd.randrange(1, 9)) for _ in range(300)})
    plan = [name(rnd.randrange(1, 7)) for _ in range(40)]
    for road in rnd.sample([r for r in roads if len(r) > 4], 80):
        at = rnd.sample(range(len(road)), 2)
        plan.append("".join(rnd.choice("寅卯辰") if i in at else c for i, c in enumerate(road)))
        plan.append(road[1] + road[0] + road[2:-2] + road[-1] + road[-2])
    best = [max(alike(p, r) for r in roads) for p in plan]
    p = spark.createDataFrame([(i, n + "線", "山田村") for i, n in enumerate(plan)], "plan_row long, name string, municipalities string")
    m = spark.createDataFrame([(i, f"R{i}", n + "線", "山田村", None) for i, n in enumerate(roads)], "map_row long, road string, name string, municipality string, source string")
    got = {r.plan_row: r for r in k.link(p, m).collect()}
    direct = {i: b for i, b in enumerate(best) if b >= k.LINK - 1e-9}
    assert direct.keys() <= got.keys()
    # What isn't linked for a neighbour's sake is linked to the most alike road.
    own = {i: r for i, r in got.items() if abs(r.confidence - direct.get(i, 0)) < 1e-4}
    assert {i: round(alike(plan[i], roads[r.map_row]), 4) for i, r in own.items()} == {i: round(direct[i], 4) for i in own}
    assert all(r.confidence > direct.get(i, 0) for i, r in got.items() if i not in own)
