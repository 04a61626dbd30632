"""Mixes: shares, caps, the inverse of the distribution, and a stable draw."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.llm import mixing as m

FIELDS = "doc_id long, text string, source string, u double, tokens int"
TARGETS = "source string, target_share double, max_repeats int"


def documents(spark, **sizes):
    rnd = random.Random(5)
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            k += 1
            rows.append((k, "road " * rnd.randrange(1, 30), None if source == "none" else source, 0.5, 1))
    return spark.createDataFrame(rows, FIELDS)


def test_poisson_steps():
    steps = m.poisson_steps(1.5, 4)
    chances = [math.exp(-1.5) * 1.5**k / math.factorial(k) for k in range(4)]
    assert steps == pytest.approx([sum(chances[: k + 1]) for k in range(4)])
    assert m.poisson_steps(math.inf, 3) == [0.0, 0.0, 0.0]
    assert m.poisson_steps(0.0, 2) == [1.0, 1.0]


def test_poisson_steps_of_large_means():
    for mean, most in ((900.0, 2000), (5000.0, 6000), (1e-9, 5)):
        steps = m.poisson_steps(mean, most)
        assert steps == sorted(steps)
        assert steps[-1] == pytest.approx(1.0)
        middle = sum(u <= 0.5 for u in steps)
        assert abs(middle - mean) < 2


def test_shares_of_many_repeats(spark):
    docs = documents(spark, a=400, b=400)
    targets = spark.createDataFrame([("a", 0.5, 1000), ("b", 0.5, 2000)], TARGETS)
    reached = {r.source: r.actual_share for r in m.shares(m.uses(docs, targets), targets).collect()}
    assert reached["a"] == pytest.approx(0.5, abs=0.005)
    with pytest.raises(ValueError, match="repeats"):
        m.uses(docs, spark.createDataFrame([("a", 0.5, 2_000_000_000)], TARGETS))


def test_uniform(spark):
    u = [r.u for r in spark.range(20_000).select(m.uniform(F.col("id"), 1).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1
    counts = [sum(k / 10 <= x < (k + 1) / 10 for x in u) for k in range(10)]
    assert all(abs(c - 2000) < 250 for c in counts)


def test_shares(spark):
    docs = documents(spark, big=3000, middle=600, small=100, other=50, none=20)
    targets = spark.createDataFrame([("big", 0.5, 1), ("middle", 0.3, 2), ("small", 0.2, 5), ("absent", 0.1, 2), (None, 0.5, 1), ("zero", 0.0, 1)], TARGETS)
    used = m.uses(docs, targets).cache()
    assert used.count() == docs.count()
    most = {"big": 1, "middle": 2, "small": 5}
    rows = used.collect()
    assert all(r.uses <= most.get(r.source, 0) for r in rows)
    tokens = {s: sum(r.tokens * r.uses for r in rows if r.source == s) for s in most}
    total = sum(tokens.values())
    for source, share in (("big", 0.5), ("middle", 0.3), ("small", 0.2)):
        assert tokens[source] / total == pytest.approx(share, abs=0.01)
    # One source is used as often as it may be: the mix is as large as can be.
    assert any(all(r.uses == most[s] for r in rows if r.source == s) for s in most)
    assert sorted(map(tuple, m.uses(docs, targets).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert m.uses(docs, targets, seed=7).collect() != rows
    shares = {r.source: r for r in m.shares(used, targets).collect()}
    assert shares["absent"].actual_share == 0
    assert shares["middle"].actual_share == pytest.approx(0.3, abs=0.01)
    copies = m.mixed(used)
    assert copies.count() == sum(r.uses for r in rows)
    assert copies.select("doc_id", "copy").distinct().count() == copies.count()
    order = [r.shuffle_key for r in copies.collect()]
    assert order == sorted(order)


def test_no_documents(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    used = m.uses(documents(spark), targets)
    assert used.collect() == []
    assert m.shares(used, targets).first().actual_share == 0
    assert m.uses(documents(spark, b=3), targets.limit(0)).filter("uses > 0").count() == 0


def test_texts_without_tokens(spark):
    docs = spark.createDataFrame([(1, None, "a", 0.0, 0), (2, "", "a", 0.0, 0)], FIELDS)
    assert [r.uses for r in m.uses(docs, spark.createDataFrame([("a", 1.0, 2)], TARGETS)).collect()] == [0, 0]
