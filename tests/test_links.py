"""Near places put together, against all pairs."""

from __future__ import annotations

import math
import random

import pytest
from conftest import rows

from waymark.operators import graph, links, registry

NAN = float("nan")
MEMBER = "v long, name string, lat double, lon double"


def metres(p, q):
    a = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(a))


def is_place(p):
    return None not in p and 20 <= p[0] <= 50 and 120 <= p[1] <= 155


def plain(members, radius):
    parent = {m[0]: m[0] for m in members}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, (v, name, *p) in enumerate(members):
        for w, other, *q in members[i:]:
            if name == other and is_place(p) and is_place(q) and metres(p, q) <= radius:
                a, b = sorted((top(v), top(w)))
                parent[b] = a
    return sorted(((v, top(v)) for v in parent), key=repr)


def found(spark, members, radius, most_pairs):
    df = spark.createDataFrame(members, MEMBER)
    return rows(graph.components(df.select("v"), links.near_edges(df, "name", radius, most_pairs)), "v", "component")


def discs(rnd, n, gap_m):
    """Places in two discs of 4 km, one northeast of the other, and one place beside each; only these two are ``gap_m`` apart."""
    at = lambda north, east: (35 + math.degrees(north / 6_371_000), 138 + math.degrees(east / 6_371_000 / math.cos(math.radians(35 + math.degrees(gap_m / 9.01e6 / 2)))))
    half = math.sqrt(0.5)
    out = [at(0, 0), at(gap_m * half, gap_m * half)]
    for middle in (-4100 * half, (gap_m + 4100) * half):
        for _ in range(n):
            r, a = 4000 * math.sqrt(rnd.random()), rnd.random() * 2 * math.pi
            out.append(at(middle + r * math.cos(a), middle + r * math.sin(a)))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("spread, most_pairs", [(0.2, 10**6), (1.5, 0), (4.0, 10**6), (4.0, 30)])
def test_like_all_pairs(spark, spread, most_pairs):
    rnd = random.Random(3)
    place = lambda: (rnd.choice([20.0, 36.0, 50 - spread]) + rnd.random() * spread, 138 + rnd.random() * spread)
    members = [(k % 260, f"n{k % 130 % 3}", *place()) for k in range(360)]
    odd = [(900, "n1", None, 138.0), (901, "n1", NAN, 138.0), (902, "n1", 19.9, 138.0), (903, "n1", 19.9, 138.0), (904, None, *members[0][2:])]
    assert found(spark, members + odd, 12_000.0, most_pairs) == plain(members + odd, 12_000.0)


@pytest.mark.parametrize("gap_m, one", [(4999.9, True), (5000.1, False)])
@pytest.mark.parametrize("most_pairs", [10**6, 0])
def test_dense_places_just_in_and_out_of_reach(spark, gap_m, one, most_pairs):
    members = [(k, "a", *p) for k, p in enumerate(discs(random.Random(5), 150, gap_m))]
    got = found(spark, members, 5000.0, most_pairs)
    assert got == plain(members, 5000.0)
    assert (len({c for _, c in got}) == 1) == one


def test_no_places(spark):
    assert links.near_edges(spark.createDataFrame([], MEMBER), "name", 30.0).count() == 0


def test_dense_ways_form_few_edges(spark):
    rnd = random.Random(7)
    ends = lambda: [(36 + rnd.random() * 0.03, 138 + rnd.random() * 0.03) for _ in range(2)]
    ways = spark.createDataFrame([(k, "a", [f"x{k}"], ends()) for k in range(500)], "way long, name string, nodes array<string>, ends array<struct<lat: double, lon: double>>")
    edges = registry.way_edges(ways, 5000.0)
    assert edges.count() <= 1500
    assert {c for _, c in rows(graph.components(ways.selectExpr("way AS v"), edges))} == {0}


def test_neighbours_each_once_from_few_copies(spark):
    rnd = random.Random(9)
    at = sorted({(rnd.choice("gh"), rnd.randrange(-20, 20), rnd.randrange(-20, 20)) for _ in range(500)})
    cells = spark.createDataFrame(at, "g string, cy long, cx long")
    got = rows(links._neighbours(cells, 2, 3).select("a.g", "a.cy", "a.cx", "b.g", "b.cy", "b.cx"))
    assert got == sorted(((*p, *q) for p in at for q in at if p[0] == q[0] and 0 <= q[1] - p[1] <= 2 and abs(q[2] - p[2]) <= 3 and (q[1:] > p[1:])), key=repr)


@pytest.mark.parametrize("few", [0, 10**6])
def test_shuffled_or_broadcast_and_labelled(spark, monkeypatch, few):
    monkeypatch.setattr(links, "FEW_CELLS", few)
    monkeypatch.setattr(graph, "FEW_GROUPS", few)
    rnd = random.Random(11)
    ends = lambda: [(35 + rnd.random(), 138 + rnd.random()) if rnd.random() < 0.8 else (0.0, float(rnd.randrange(3))) for _ in range(rnd.randrange(4))]
    ways = [(k, rnd.choice(["a", "b", None]), [str(rnd.randrange(60))], ends()) for k in range(150)]
    df = spark.createDataFrame(ways, "way long, name string, nodes array<string>, ends array<struct<lat: double, lon: double>>")
    got = rows(registry.way_components(df, 5000.0), "way", "component")
    assert got == rows(graph.components(df.selectExpr("way AS v"), registry.way_edges(df, 5000.0)), "v", "component")
    parent = {w[0]: w[0] for w in ways}
    for _ in ways:
        for x in ways:
            for y in ways:
                if x[1] and x[1] == y[1] and parent[x[0]] > parent[y[0]] and (set(x[2]) & set(y[2]) or any(p == q or is_place(p) and is_place(q) and metres(p, q) <= 5000 for p in x[3] for q in y[3])):
                    parent[x[0]] = parent[y[0]]
    assert got == sorted(parent.items(), key=repr)
