"""Near places of one group put together, by far fewer edges than there are near pairs.

Method: grid cells whose diagonal is below the radius, so all places of a cell belong together. Neighbouring cells whose
witnesses (one place each) are near are linked, and components of cells are found. Only cells of different components are
looked at further: pairs whose boxes are too far apart go, the others are split into quarters until few pairs of places are
left, which are all tested. Dense places are thus never paired with each other, and no link is missed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, LATITUDES, great_circle_m, is_place
from ..session import cut_lineage
from .graph import components

#: Up to so many pairs of places are tested one by one; with more, their cells are split.
MOST_PAIRS = 20_000_000
#: Cells aren't split further than this, to 2^-20 of the first side; what is left is tested one by one.
LAST_LEVEL = 20
#: Neighbours are looked for in blocks of 2^3 by 2^3 cells and the cells around them.
BLOCK_BITS = 3
#: Up to so many cells are broadcast to the places (some 10 MB), with more both are shuffled.
FEW_CELLS = 100_000


def near_edges(members: DataFrame, group: str, radius_m: float, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Edges ``(a, b)`` between ``v``: components are those of all pairs of one ``group`` at most ``radius_m`` apart.

    ``members`` has ``v``, ``group``, ``lat`` and ``lon``, with several rows per ``v``; rows that are no places give no edge.
    """
    labels, edges = near_labels(members, group, radius_m, most_pairs)
    return labels.filter("v <> c").select(F.col("v").alias("a"), F.col("c").alias("b")).unionByName(edges)


def near_labels(members: DataFrame, group: str, radius_m: float, most_pairs: int = MOST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """The edges of ``near_edges`` in two parts: ``(v, c)``, of each ``v`` with a place one smaller or equal ``v`` that it belongs
    to, and edges ``(a, b)`` between these ``c`` only, of which there are few.
    """
    side_lat, side_lon, reach_y, reach_x = _grid(radius_m)
    at = members.filter(is_place(F.col("lat"), F.col("lon")) & F.col(group).isNotNull()).select("v", F.col(group).alias("g"), "lat", "lon")
    cell = lambda level: {"cy": _cell("lat", side_lat, level), "cx": _cell("lon", side_lon, level)}
    cells = cut_lineage(_boxes(at.withColumns(cell(0)), F.min(F.struct("v", "lat", "lon"))))
    cells = cells.withColumn("v", F.col("w.v"))
    seen = cells.select("g", "cy", "cx", "v", F.struct("w.lat", "w.lon").alias("w"))
    linked = _neighbours(seen, reach_y, reach_x).filter(_witnesses_near(radius_m)).select(F.col("a.v").alias("a"), F.col("b.v").alias("b"))
    found = components(cells.select("v"), linked).withColumnsRenamed({"v": "__v", "component": "c"})
    cells = cut_lineage(cells.join(found, F.col("v") == F.col("__v")).select("g", "cy", "cx", "south", "north", "west", "east", "c"))
    named = cells.select("g", "cy", "cx", "c")
    inside = at.withColumns(cell(0)).join(F.broadcast(named) if cells.count() <= FEW_CELLS else named, ["g", "cy", "cx"])
    labelled = cut_lineage(inside.groupBy("v").agg(F.sort_array(F.collect_set("c")).alias("cs")))
    labels = labelled.select("v", F.get("cs", F.lit(0)).alias("c"))
    edges = labelled.filter(F.size("cs") > 1).select(F.explode("cs").alias("a"), F.get("cs", F.lit(0)).alias("b")).filter("a <> b").distinct()
    if cells.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("top")).filter("low < top").isEmpty():
        return labels, edges

    # Between components: (g, ay, ax, by, bx, ca, cb), cells of one level in which near places may lie.
    open_ = _neighbours(cells, reach_y, reach_x).filter("a.c <> b.c").filter(_boxes_near(radius_m) & ~_both_single())
    open_ = cut_lineage(open_.select("a.g", F.col("a.cy").alias("ay"), F.col("a.cx").alias("ax"), F.col("b.cy").alias("by"), F.col("b.cx").alias("bx"), F.col("a.c").alias("ca"), F.col("b.c").alias("cb")))
    if open_.isEmpty():
        return labels, edges
    touched = open_.select("g", F.col("ay").alias("cy"), F.col("ax").alias("cx")).unionByName(open_.select("g", F.col("by").alias("cy"), F.col("bx").alias("cx"))).distinct()
    points = cut_lineage(at.withColumns(cell(0)).join(touched, ["g", "cy", "cx"], "left_semi").select("g", "lat", "lon").distinct())
    sides = lambda rows, end: rows.select(F.col("g"), F.col("cy").alias(f"{end}y"), F.col("cx").alias(f"{end}x"), F.struct(*[c for c in rows.columns if c not in ("g", "cy", "cx")]).alias(end))
    both = lambda pairs, rows: pairs.join(sides(rows, "a"), ["g", "ay", "ax"]).join(sides(rows, "b"), ["g", "by", "bx"])
    level = 0
    while True:
        placed = points.withColumns(cell(level))
        tests = both(open_, placed.groupBy("g", "cy", "cx").agg(F.count("*").alias("n"))).agg(F.sum(F.col("a.n").cast("double") * F.col("b.n"))).first()[0] or 0
        if tests <= most_pairs or level == LAST_LEVEL:
            near = both(open_, placed).filter(great_circle_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= radius_m)
            return labels, edges.unionByName(near.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        level += 1
        quarters = _boxes(points.withColumns(cell(level)), F.min(F.struct("lat", "lon")))
        # A quarter goes by the cell that it is part of until both sides are found.
        parts = quarters.withColumns({"y": F.col("cy"), "x": F.col("cx"), "cy": F.shiftright("cy", 1), "cx": F.shiftright("cx", 1)})
        tried = both(open_, parts).filter(_boxes_near(radius_m)).withColumn("near", _witnesses_near(radius_m))
        tried = cut_lineage(tried.filter(F.col("near") | ~_both_single()).select("g", F.col("a.y").alias("ay"), F.col("a.x").alias("ax"), F.col("b.y").alias("by"), F.col("b.x").alias("bx"), "ca", "cb", "near"))
        joined = tried.filter("near").select("ca", "cb").distinct()
        edges = edges.unionByName(joined.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        joined = joined.unionByName(joined.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
        open_ = cut_lineage(tried.filter("NOT near").drop("near").join(joined.distinct(), ["ca", "cb"], "left_anti"))


def _grid(radius_m: float) -> tuple[float, float, int, int]:
    """Sides of a cell in degrees, its diagonal a little below the radius at any latitude; cells that a circle may reach."""
    half = math.sin(min(math.pi, radius_m / EARTH_RADIUS_M) / 2) ** 2
    arc = lambda x: math.degrees(2 * math.asin(min(1.0, math.sqrt(x))))
    low, top = (math.cos(math.radians(x)) ** 2 for x in LATITUDES)
    sides = arc(0.499 * half), arc(0.499 * half / low)
    reach = arc(half * 1.0001), arc(half * 1.0001 / top)
    return *sides, *(math.ceil(r / s) for r, s in zip(reach, sides, strict=True))


def _cell(column: str, side: float, level: int) -> Column:
    """Cells of a level are halves of those before: scaling by a power of two is exact."""
    return F.floor(F.col(column) / side * 2.0**level).cast("long")


def _boxes(placed: DataFrame, witness: Column) -> DataFrame:
    """``(g, cy, cx)`` with the bounds of what is in the cell and a witness ``w``."""
    return placed.groupBy("g", "cy", "cx").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), witness.alias("w"))


def _neighbours(cells: DataFrame, reach_y: int, reach_x: int) -> DataFrame:
    """Pairs ``a, b`` of cells within reach, each pair once.

    Cells are shuffled to their block and to the few blocks whose cells reach them, not once for each neighbour they may have.
    """
    block = lambda c, off=0: F.shiftright(F.col(c) + F.lit(off).cast("long"), BLOCK_BITS)
    sent = cells.select("g", F.struct("*").alias("b"), "cx", F.explode(F.sequence(block("cy", -reach_y), block("cy"))).alias("__y"))
    sent = sent.select("g", "__y", F.explode(F.sequence(block("cx", -reach_x), block("cx", reach_x))).alias("__x"), "b")
    blocks = sent.groupBy("g", "__y", "__x").agg(F.collect_list("b").alias("bs"))
    first = blocks.select("bs", "__y", "__x", F.explode("bs").alias("a")).filter((block("a.cy") == F.col("__y")) & (block("a.cx") == F.col("__x")))
    step_y, step_x = F.col("b.cy") - F.col("a.cy"), F.col("b.cx") - F.col("a.cx")
    return first.select("a", F.explode("bs").alias("b")).filter(step_y.between(0, reach_y) & step_x.between(-reach_x, reach_x) & ((step_y > 0) | (step_x > 0)))


def _witnesses_near(radius_m: float) -> Column:
    return great_circle_m(F.col("a.w.lat"), F.col("a.w.lon"), F.col("b.w.lat"), F.col("b.w.lon")) <= radius_m


def _both_single() -> Column:
    """Both hold one place each, so their witnesses tell all."""
    one = lambda s: (F.col(f"{s}.south") == F.col(f"{s}.north")) & (F.col(f"{s}.west") == F.col(f"{s}.east"))
    return one("a") & one("b")


def _boxes_near(radius_m: float) -> Column:
    """Places of both boxes may be near: a bound from below by the gaps between the boxes, where a degree of longitude is shortest."""
    gap = lambda low, high: F.radians(F.greatest(F.lit(0.0), F.col(f"b.{low}") - F.col(f"a.{high}"), F.col(f"a.{low}") - F.col(f"b.{high}")))
    square = lambda x: x * x
    shrink = F.cos(F.radians("a.north")) * F.cos(F.radians("b.north"))
    least = square(F.sin(gap("south", "north") / 2)) + shrink * square(F.sin(gap("west", "east") / 2))
    return least <= math.sin(min(math.pi, radius_m / EARTH_RADIUS_M) / 2) ** 2 * (1 + 1e-9) + 1e-18
