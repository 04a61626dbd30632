"""Ranking, components, claims, polygons, skewed joins, terms in texts, constraints."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from waymark.functions import names, web
from waymark.operators import assign, contains, evidence, graph, quality, rank, skew, spatial


def test_first_last_mode(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "w"), ("a", 2, "y"), ("b", 3, "z")], "k string, n int, v string")
    assert rows(rank.first_by(df, ["k"], F.col("n"), F.col("v")), "k", "v") == [("a", "w"), ("b", "z")]
    assert rows(rank.last_by(df, ["k"], F.col("n"), F.col("v")), "k", "v") == [("a", "y"), ("b", "z")]
    assert rank.first_by(df.limit(0), ["k"], F.col("n")).count() == 0
    votes = spark.createDataFrame([("g", "b", 2), ("g", "a", 1), ("g", "b", 4), ("g", "a", 5), ("h", "c", 1)], "g string, v string, at int")
    assert rows(rank.mode_first(votes, ["g"], "v", "at")) == [("g", "a", 2), ("h", "c", 1)]
    texts = spark.createDataFrame([("g", "b", 3), ("g", "a", 1), ("g", "b", 2), ("g", None, 0), ("g", "", 0)], "g string, v string, at int")
    assert texts.groupBy("g").agg(rank.ordered_distinct("v", "at").alias("v")).first().v == ["a", "b"]


def test_numbered_and_minted(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(7)
    assert rows(rank.numbered(df, F.desc("x")), "position", "x") == sorted(((k + 1, 999 - k) for k in range(1000)), key=repr)
    assert rank.numbered(df.limit(0), F.desc("x")).count() == 0
    assert rows(rank.minted(spark.createDataFrame([("b",), ("a",)], "n string"), 7, "NGN", F.col("n"))) == [("a", "NGN-000008"), ("b", "NGN-000009")]


def test_top_per_group_is_the_greedy_walk(spark):
    data = [(f"i{k:02}", "ab"[k % 3 > 0], -k // 2) for k in range(30)]
    taken, per = [], {}
    for i, g, s in sorted(data, key=lambda r: (-r[2], r[0])):
        if per.get(g, 0) < 6 and len(taken) < 9:
            per[g] = per.get(g, 0) + 1
            taken.append((i, len(taken) + 1))
    df = spark.createDataFrame(data, "i string, g string, s int")
    assert rows(rank.top_per_group(df, "g", 6, 9, F.desc("s"), F.asc("i")), "i", "position") == sorted(taken, key=repr)


def test_best_two_only_and_pages(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 1), ("a", 2), ("b", 5), (None, 7)], "k string, v int")
    assert rows(rank.best_two(df, "k", F.col("v"), "v"))[:2] == [("a", 1, 2), ("b", 5, None)]
    assert rows(rank.only_of(df, ["k"])) == [("b", 5), (None, 7)]
    assert rows(rank.paged(df, ["k"], "v", 2), "k", "page", "values") == [("a", 0, [1, 1]), ("a", 1, [2, 3]), ("b", 0, [5]), (None, 0, [7])]
    assert rank.paged(df.limit(0), ["k"], "v", 2).count() == 0


def test_only_match(spark):
    pairs = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "p int, o string")
    assert rows(rank.only_match(pairs, ["p"])) == [(1, "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)]
    parent = {v: v for v in [*range(80), *range(100, 161)]}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    vertices = spark.createDataFrame([(v,) for v in parent], "v long")
    got = graph.components(vertices, spark.createDataFrame(edges, "a long, b long"))
    assert rows(got) == sorted(((v, find(v)) for v in parent), key=repr)


def test_components_without_edges(spark):
    assert rows(graph.components(spark.range(2).toDF("v"), spark.createDataFrame([], "a long, b long"))) == [(0, 0), (1, 1)]


def test_greedy_claims(spark):
    claims = [(1, 10, 1, 0), (2, 10, 2, 0), (2, 11, 2, 1), (3, 11, 3, 0), (4, 20, 4, 0)]
    df = spark.createDataFrame(claims, "new long, old long, order int, preference int")
    assert rows(assign.greedy_claims(df)) == [(1, 10), (2, 11), (4, 20)]


def test_rings_and_polygons(spark):
    square = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]
    pieces = [[square[0], square[1]], [square[2], square[1]], [square[2], square[3]], [square[0], square[3]]]
    ring = spatial.stitched(pieces)[0]
    assert ring[0] == ring[-1]
    assert set(ring) == set(square)
    with pytest.raises(ValueError, match="close"):
        spatial.stitched(pieces[:3])
    # Two rings that touch in one place, pieces in any order, and a ring of one piece.
    other = [[(4.0, 4.0), (8.0, 4.0)], [(8.0, 8.0), (8.0, 4.0)], [(4.0, 4.0), (8.0, 8.0)]]
    whole = [(20.0, 20.0), (20.0, 21.0), (21.0, 21.0), (20.0, 20.0)]
    many = spatial.stitched([whole, *other, *pieces[::-1]])
    assert all(r[0] == r[-1] for r in many)
    edge = lambda lines: sorted(tuple(sorted(e)) for line in lines for e in zip(line, line[1:], strict=False))
    assert edge(many) == edge([whole, *other, *pieces])
    assert spatial.stitched([]) == []
    assert spatial.stitched([[]]) == []
    hole = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]
    rings = spark.createDataFrame([(1, "outer", 1, ring), (1, "inner", 2, hole)], "polygon int, role string, ring int, points array<struct<lat: double, lon: double>>")
    points = spark.createDataFrame([("in", 3.0, 3.0), ("hole", 1.5, 1.5), ("out", 5.0, 1.0), ("none", None, 1.0)], "point string, lat double, lon double")
    for limit in (100, 0):
        assert rows(spatial.points_in_polygons(points, rings, limit)) == [("in", 1)]


def test_smallest_box_and_gaps(spark):
    points = spark.createDataFrame([("p", 36.0, 138.0), ("q", 30.0, 130.0)], "point string, lat double, lon double")
    boxes = spark.createDataFrame([("b", 35.0, 137.0, 37.0, 139.0, 4), ("c", 35.5, 137.5, 36.5, 138.5, 1), ("a", 35.4, 137.4, 36.4, 138.4, 1)], "name string, south double, west double, north double, east double, area int")
    assert rows(spatial.smallest_box(points, boxes), "point", "name") == [("p", "a"), ("q", None)]
    numbers = spark.createDataFrame([(1,), (2,), (5,), (99_999,), (100_000,), (100_002,), (300_000,)], "n long")
    assert sorted(rows(spatial.runs(numbers, "n"))) == [(2, 5), (5, 99_999), (100_000, 100_002), (100_002, 300_000)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join(spark, how):
    data = [("hot", k) for k in range(50)] + [("x", 1), ("y", 2), (None, 3)]
    df = spark.createDataFrame(data, "k string, v int")
    lookup = spark.createDataFrame([("hot", 1), ("x", 2)], "k string, w int")
    plain = rows(df.join(lookup, "k", how))
    assert rows(skew.join_to_lookup(df, lookup, "k", how, share=0.3, least=5)) == plain
    assert skew.hot_values(df, "k", share=0.3, least=5) == ["hot"]
    assert skew.join_to_lookup(df.limit(0), lookup, "k", how).count() == 0


@pytest.mark.parametrize("block", [100, 1])
def test_terms_in_texts(spark, block):
    texts = spark.createDataFrame([(1, "林道と地図と林道"), (None, "地図"), (3, None), (4, "")], "k long, t string")
    terms = spark.createDataFrame([("林道",), ("地図",), (None,), ("",), ("林道",)], "w string")
    assert rows(contains.terms_in_texts(texts, "k", "t", terms, "w", block)) == sorted([(1, "林道"), (1, "地図"), (None, "地図")], key=repr)
    assert contains.terms_in_texts(texts, "k", "t", terms.limit(0), "w").count() == 0


def test_names(spark):
    df = spark.createDataFrame([("林道　大澤ヶ入・線",), ("ｶﾗﾏﾂ線",), (None,), ("",)], "n string")
    assert [r[0] for r in df.select(names.normal_name(F.col("n"), "a")).collect()] == ["大沢ケ入", "カラマツ", None, ""]
    assert [r[0] for r in df.select(names.normal_name(F.lit("林道ガレ支線3号"), "c")).collect()][0] == "カレ"
    parsed = spark.createDataFrame([("林道 西山ほか",), ("西山",), (None,)], "n string").select(names.stem_and_flag(F.col("n")).alias("p")).collect()
    assert parsed[0].p == ("西山", True)
    assert parsed[1].p is None


def test_web(spark):
    page = '<p>a&amp;b</p><script>x</script> <A class="c" href="https://www.Town.x.example:80/a#s">t</a>'
    df = spark.createDataFrame([(page,)], "p string")
    got = df.select(web.strip_tags(F.col("p")).alias("t"), web.links(F.col("p")).alias("l"), web.host(F.lit("https://u@City.Example:80/a")).alias("h"), web.host(F.lit("no")).alias("n"), web.is_official(F.lit("https://www.city.x.example/")).alias("o")).first()
    assert got == ("a&b t", ["https://www.Town.x.example:80/a#s"], "city.example", None, True)
    cut = df.select(web.excerpt(F.lit("0123456789"), "5", 2, 2).alias("a"), web.excerpt(F.lit("x"), "5").alias("b")).first()
    assert cut == ("34567", None)


def test_evidence(spark):
    ev = spark.createDataFrame([(1, None, "exact", "u", "d", True, "a"), (1, "official", "exact", "u", "e", True, "b"), (1, "osm", "exact", "u", "f", True, "c"), (2, "official", "ambiguous-same-name", "u", "d", True, "a"), (3, "official", "exact", "", "d", True, "a")], "k int, cls string, conf string, url string, dom string, direct boolean, attribute string")
    cands = spark.createDataFrame([(1, True), (2, True), (3, True), (4, True), (5, False)], "k int, placed boolean")
    assert rows(evidence.graded(cands, ev, "k"), "k", "level") == [(1, "Lv2"), (2, "Lv0"), (3, "Lv0"), (4, "Lv0"), (5, "Lv0")]
    text = spark.range(1).select(evidence.sentences(F.lit("a"), F.lit(None).cast("string"), F.lit("b")).alias("s"), evidence.sentences(F.lit(None).cast("string")).alias("n")).first()
    assert text == ("a。b。", "")


def test_quality(spark):
    df = spark.createDataFrame([(1, "36", "138"), (2, "36", ""), (3, "x", "138"), (4, "99", "138"), (5, None, None)], "k int, y string, x string")
    got = rows(quality.violated(df, "k", quality.bad_coordinates(F.col("y"), F.col("x"))))
    assert got == [("coordinate alone", "2"), ("coordinate not a number", "3"), ("coordinate out of range", "4")]
    assert rows(quality.repeated(df.select(F.lit("a").alias("id")), "id", "r")) == [("r", "a")]
    assert rows(quality.missing(df, "y", "k", df.filter("k = 1"), "y", "m")) == [("m", "3"), ("m", "4")]
