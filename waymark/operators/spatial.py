"""Polygons, rings and boxes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ring edges are broadcast up to this number and joined by latitude bands beyond it.
BROADCAST_EDGES = 300
BAND = 0.05


def stitched(pieces: Iterable[Sequence[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings from pieces in any order and direction; raises if an end is left open.

    Each place where pieces end is a node and each piece an edge between two nodes. Rings exist if and only if an
    even number of pieces ends at each node, and then a walk along unused pieces can only end where it began.
    """
    lines = [list(p) for p in pieces if p]
    at_node: dict[tuple[float, float], set[int]] = defaultdict(set)
    for k, line in enumerate(lines):
        if line[0] != line[-1]:
            at_node[line[0]].add(k)
            at_node[line[-1]].add(k)
    if loose := [node for node, held in at_node.items() if len(held) % 2]:
        raise ValueError(f"the pieces don't close at {len(loose)} places, as {loose[0]}")
    rings = [line for line in lines if line[0] == line[-1]]
    for start, held in at_node.items():
        while held:
            ring, node = [start], start
            while len(ring) == 1 or node != start:
                k = min(at_node[node])
                line = lines[k] if lines[k][0] == node else lines[k][::-1]
                node = line[-1]
                ring += line[1:]
                at_node[line[0]].discard(k)
                at_node[node].discard(k)
            rings.append(ring)
    return rings


def stitched_rings(pieces: DataFrame) -> DataFrame:
    """``(polygon, role, ring, points)`` from pieces ``(polygon, role, points)``, arrays of (lat, lon).

    The pieces of one outline, which is one row of points afterwards, meet in one task; outlines are independent.
    """
    point = "array<struct<lat: double, lon: double>>"

    def join(group: pd.DataFrame) -> pd.DataFrame:
        rings = stitched([[(p["lat"], p["lon"]) for p in line] for line in group["points"] if line is not None])
        return pd.DataFrame({"polygon": [group["polygon"].iloc[0]] * len(rings), "role": [group["role"].iloc[0]] * len(rings), "ring": range(1, len(rings) + 1), "points": [[{"lat": y, "lon": x} for y, x in ring] for ring in rings]})

    kinds = dict(pieces.dtypes)
    return pieces.groupBy("polygon", "role").applyInPandas(join, f"polygon {kinds['polygon']}, role string, ring int, points {point}")


def ring_edges(rings: DataFrame) -> DataFrame:
    """Edges ``(polygon, role, y1, x1, y2, x2)`` of rings with ``polygon, role, ring, points`` (array of lat, lon)."""
    pairs = F.expr("transform(sequence(0, size(points) - 2), k -> struct(points[k] AS p, points[k + 1] AS q))")
    edges = rings.filter(F.size("points") > 1).select("polygon", "role", F.explode(pairs).alias("e"))
    return edges.select("polygon", "role", F.col("e.p.lat").alias("y1"), F.col("e.p.lon").alias("x1"), F.col("e.q.lat").alias("y2"), F.col("e.q.lon").alias("x2")).filter("y1 <> y2")


def points_in_polygons(points: DataFrame, rings: DataFrame, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """``(point, polygon)``: points (``point, lat, lon``) inside an outer ring and in no inner one.

    Even-odd rule with half-open crossings, counted by an aggregation over the edges that a ray from the point may cross.
    """
    edges = ring_edges(rings)
    crosses = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    if edges.limit(broadcast_edges + 1).count() <= broadcast_edges:
        hits = points.join(F.broadcast(edges), crosses)
    else:
        band = lambda c: F.floor(c / BAND).cast("long")
        banded = edges.withColumn("band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
        hits = points.withColumn("band", band(F.col("lat"))).join(banded, "band").filter(crosses)
    counted = hits.groupBy("point", "polygon").agg(F.count_if(F.col("role") == "outer").alias("outer"), F.count_if(F.col("role") == "inner").alias("inner"))
    return counted.filter("outer % 2 = 1 AND inner % 2 = 0").select("point", "polygon")


def smallest_box(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """``points`` with the name of the smallest box around each, by name where boxes are of one size; null for none.

    ``boxes`` has ``name, south, west, north, east`` and a sortable ``area``.
    """
    from .nearby import boxes_around

    around = boxes_around(points, boxes).groupBy("point").agg(F.min_by("name", F.struct("area", "name")).alias("name"))
    return points.join(around, "point", "left")


def runs(df: DataFrame, key: str) -> DataFrame:
    """Gaps in numbering: ``(after, before)`` of neighbours that differ by more than 1.

    Neighbours are found within ranges of numbers and between the ends of ranges, so no task sees all rows.
    """
    block = F.floor(F.col(key) / 100_000)
    w = Window.partitionBy("__b").orderBy(key)
    inner = df.select(key).distinct().withColumn("__b", block).withColumn("__n", F.lead(key).over(w))
    within = inner.filter(F.col("__n") - F.col(key) > 1).select(F.col(key).alias("after"), F.col("__n").alias("before"))
    ends = inner.groupBy("__b").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    following = ends.withColumn("next", F.lead("lo").over(Window.orderBy("__b")))
    return within.unionByName(following.filter("next - hi > 1").select(F.col("hi").alias("after"), F.col("next").alias("before")))
