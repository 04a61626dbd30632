"""The registry after a scan, against a plain walk over the same ways."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from waymark.operators import registry

WAY = "way long, name string, nodes array<string>, ends array<struct<lat: double, lon: double>>, weak boolean"
KNOWN = "id string, name string, way long"


def metres(p, q):
    a = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(a))


def plain(ways, known):
    """Components, then IDs by shared ways in the order of components, then by names that occur once on both sides."""
    parent = {w[0]: w[0] for w in ways}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for x in ways:
        for y in ways:
            near = any(metres(p, q) <= 5000 for p in x[3] for q in y[3])
            if x[1] == y[1] and x[0] < y[0] and (set(x[2]) & set(y[2]) or near):
                a, b = sorted((top(x[0]), top(y[0])))
                parent[b] = a
    groups = defaultdict(list)
    for w in ways:
        groups[top(w[0])].append(w)
    taken = {}
    for c in sorted(groups):
        for i in sorted({i for i, _, way in known if way in {w[0] for w in groups[c]}}):
            if i not in taken.values():
                taken[c] = i
                break
    once = lambda pairs: {n: k for k, n in pairs if Counter(m for _, m in pairs)[n] == 1}
    mine = once([(c, g[0][1]) for c, g in groups.items() if c not in taken])
    theirs = once(sorted({(i, n) for i, n, _ in known if i not in taken.values()}))
    taken |= {c: theirs[n] for n, c in mine.items() if n in theirs}
    matched = sorted((i, groups[c][0][1], len(groups[c]), "matched") for c, i in taken.items())
    unmatched = sorted({(i, min(n for j, n, _ in known if j == i), 0, "unmatched") for i, _, _ in known if i not in taken.values()})
    fresh = sorted((groups[c][0][1], len(groups[c])) for c in groups if c not in taken)
    return matched, unmatched, fresh


@pytest.mark.parametrize("seed", [1, 2])
def test_like_a_plain_walk(spark, seed):
    rnd = random.Random(seed)
    place = lambda: (35 + rnd.randrange(30) / 20, 138 + rnd.randrange(30) / 20)
    ways = [(k, f"n{rnd.randrange(6)}", [str(rnd.randrange(60))], [place(), place()], False) for k in range(40)]
    known = [(f"NGN-{i:06}", f"n{rnd.randrange(8)}", rnd.choice([None, rnd.randrange(50)])) for i in range(1, 15)]
    weak = [(100, "n1", ["1"], [place()], True)]
    got = rows(registry.merged(spark.createDataFrame(ways + weak, WAY), spark.createDataFrame(known, KNOWN), ~F.col("weak")), "id", "name", "n_ways", "origin")
    matched, unmatched, fresh = plain(ways, known)
    assert [r for r in got if r[3] == "matched"] == matched
    assert [r for r in got if r[3] == "unmatched"] == unmatched
    new = [r for r in got if r[3] == "new"]
    assert sorted((n, w) for _, n, w, _ in new) == fresh
    assert sorted(i for i, *_ in new) == [f"NGN-{k:06}" for k in range(15, 15 + len(new))]


def test_empty_tables(spark):
    none = spark.createDataFrame([], WAY)
    assert registry.merged(none, spark.createDataFrame([], KNOWN), F.lit(True)).count() == 0
    only = spark.createDataFrame([("NGN-000003", "a", None)], KNOWN)
    assert rows(registry.merged(none, only, F.lit(True)), "id", "origin") == [("NGN-000003", "unmatched")]
    one = spark.createDataFrame([(7, "a", None, None, False)], WAY)
    assert rows(registry.merged(one, only, F.lit(True)), "id", "origin") == [("NGN-000003", "matched")]
