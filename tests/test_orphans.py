"""Orphan references, by the plain split and by each way of the hot one."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from waymark.operators import orphans

REFS = "ref_row long, ID string, at timestamp, key string, slice string"
REGISTER = "ID string, loaded_at timestamp, withdrawn_at timestamp, key string, a string"
START = datetime(2025, 1, 30)


def day(n):
    return None if n is None else START + timedelta(days=n)


def run(spark, refs, register, **how):
    r = spark.createDataFrame([(k, i, day(t), "x", "x") for k, (i, t) in enumerate(refs)], REFS)
    g = spark.createDataFrame([(i, day(a), day(b), "x", "x") for i, a, b in register], REGISTER)
    return rows(orphans.orphan_references(orphans.references(r, "t", "ID", "ref_row", "at"), g, **how), "ref_row", "period")


def brute(refs, register):
    key = lambda i: (i or "").translate({0xFF21: "A", 0xFF22: "B", 0x3000: " "}).strip().upper()
    out = []
    for k, (i, t) in enumerate(refs):
        if key(i) and t is not None and not any(key(j) == key(i) and a is not None and a <= t and (b is None or b > t) for j, a, b in register):
            out.append((k, day(t).strftime("%Y-%m")))
    return sorted(out, key=repr)


WAYS = [{}, {"hot_share": 0.0, "hot_rows": 0}, {"hot_share": 0.0, "hot_rows": 0, "broadcast_rows": 0}, {"hot_share": 0.0, "hot_rows": 3}]


@pytest.mark.parametrize("how", WAYS)
def test_cases(spark, how):
    register = [("A", 0, 10), ("a", 20, None), ("B", 5, 5), ("B", None, 9), (None, 0, None), ("A", 0, 10), ("C", 0, 40), ("C", 3, 90)]
    refs = [("A", -1), ("Ａ", 0), (" a　", 9), ("A", 10), ("A", 19), ("A", 20), ("B", 6), (None, 1), ("", 1), ("  ", 1), ("A", None), ("C", 60), ("C", 90), ("A", 10)]
    assert run(spark, refs, register, **how) == brute(refs, register)


@pytest.mark.parametrize("how", WAYS)
def test_empty_tables(spark, how):
    assert run(spark, [], [("A", 0, None)], **how) == []
    assert run(spark, [("A", 1), ("A", 1)], [], **how) == [(0, "2025-01"), (1, "2025-01")]


ids = st.sampled_from(["A", "a ", "B", None, ""])
times = st.integers(0, 70)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(ids, times), max_size=12), st.lists(st.tuples(ids, times, st.none() | times), max_size=10), st.sampled_from(WAYS))
def test_like_brute_force(spark, refs, register, how):
    assert run(spark, refs, register, **how) == brute(refs, register)


def test_report(spark):
    r = spark.createDataFrame([(1, "A", day(0)), (2, "A", day(1)), (3, "Z", day(5))], "ref_row long, ID string, at timestamp")
    g = spark.createDataFrame([("A", day(1), None)], "ID string, loaded_at timestamp, withdrawn_at timestamp")
    report = orphans.orphan_report(orphans.references(r, "t", "ID", "ref_row", "at"), g)
    assert rows(report) == [("t", "2025-01", 2, 1), ("t", "2025-02", 1, 1)]
