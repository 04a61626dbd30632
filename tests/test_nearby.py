"""Nearby points and boxes against all pairs."""

from __future__ import annotations

import math
import random

import pytest
from conftest import rows

from waymark.operators import nearby

NAN = float("nan")


def metres(a, b):
    y, x, v, u = map(math.radians, (*a, *b))
    h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def is_place(p):
    return None not in p and not any(map(math.isnan, p)) and 20 <= p[0] <= 50 and 120 <= p[1] <= 155


def test_like_all_pairs(spark):
    rnd = random.Random(1)
    left = [(rnd.choice([21.0, 36.0, 49.99]) + rnd.random() * 0.004, 138 + rnd.random() * 0.004) for _ in range(250)]
    right = [(rnd.choice([21.0, 36.0, 49.99]) + rnd.random() * 0.004, 138 + rnd.random() * 0.004) for _ in range(250)]
    odd = [(None, 138.0), (36.0, None), (NAN, 138.0), (138.0, 36.0), (19.9, 138.0), (36.0, 155.1), (0.0, 0.0)]
    left, right = left + left[:5] + odd, right + left[:5] + odd
    a = spark.createDataFrame([(k, *p, "x") for k, p in enumerate(left)], "a long, lat double, lon double, metres string")
    b = spark.createDataFrame([(k, *p, "y") for k, p in enumerate(right)], "b long, lat double, lon double, metres string")
    expected = [(i, j) for i, p in enumerate(left) for j, q in enumerate(right) if is_place(p) and is_place(q) and metres(p, q) <= 30]
    got = nearby.near_rows(a, b, 30.0)
    assert rows(got, "a", "b") == sorted(expected, key=repr)
    assert {"metres", "left_metres", "right_metres"} <= set(got.columns)


def test_empty(spark):
    a = spark.createDataFrame([], "a long, lat double, lon double")
    b = spark.createDataFrame([(1, 36.0, 138.0)], "b long, lat double, lon double")
    assert nearby.near_rows(a, b, 30.0).count() == 0
    assert nearby.near_rows(b.withColumnRenamed("b", "c"), a, 30.0).count() == 0


@pytest.mark.parametrize("limit", [10, 0])
def test_boxes(spark, limit):
    points = spark.createDataFrame([(1, 36.0, 138.0), (2, 36.5, 138.5), (3, None, 138.0), (4, 40.0, 140.0)], "p long, lat double, lon double")
    boxes = spark.createDataFrame([("a", 36.0, 36.5, 138.0, 138.5), ("b", 35.0, 36.2, 137.0, 139.0), ("flipped", 37.0, 35.0, 137.0, 139.0), ("none", None, 37.0, 137.0, 139.0)], "name string, south double, north double, west double, east double")
    assert rows(nearby.boxes_around(points, boxes, limit), "p", "name") == [(1, "a"), (1, "b"), (2, "a")]
    assert nearby.boxes_around(points, boxes.limit(0), limit).count() == 0


def test_entrance_points(spark):
    df = spark.createDataFrame([(1, [None, {"lat": 36.0, "lon": 138.0}, {"lat": None, "lon": 1.0}]), (2, None), (3, [])], "record_no long, entrances array<struct<lat: double, lon: double>>")
    assert rows(nearby.entrance_points(df)) == [(1, 2, 36.0, 138.0)]


def test_bands_and_boxes_by_grid_or_broadcast(spark):
    points = spark.createDataFrame([(k, 20.0 + k * 0.7, 120.0 + k * 0.8) for k in range(40)] + [(99, 60.0, 130.0), (98, None, 130.0)], "p int, lat double, lon double")
    boxes = spark.createDataFrame([("world", -90.0, -180.0, 90.0, 180.0), ("band", 30.0, 125.0, 31.0, 126.0), ("line", 20.7, 120.0, 20.7, 121.0), ("turned", 31.0, 120.0, 30.0, 121.0), ("none", None, 1.0, 2.0, 3.0)], "b string, south double, west double, north double, east double")
    few, many = (rows(nearby.bands_around(points, boxes, limit), "p", "b") for limit in (10, 0))
    assert few == many
    assert (15, "band") in few
    assert sum(b == "world" for _, b in few) == 40
    assert rows(nearby.boxes_around(points, boxes, 10), "p", "b") == rows(nearby.boxes_around(points, boxes, 0), "p", "b")
