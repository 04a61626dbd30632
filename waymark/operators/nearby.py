"""Points near other points, and the boxes around points.

Method: points are hashed to grid cells sized by the radius, one side is repeated for the cells that the box
around its circle touches, the cells are joined and the exact great-circle distance decides.

Rows at the same coordinates are first put together, so that the grid join sees each place once; a place that
holds a third of all rows is one row there. The rows come back by an equi-join on the exact coordinates of the
places that have a partner, which adaptive execution splits where a place is hot.

Defined results: null, NaN and impossible coordinates are no places and yield no row; rows at the same place are
at distance 0; repeated rows count each; an empty side yields no row; box bounds belong to the box, and boxes
whose south lies north of their north (or west east of east) or with missing bounds hold nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, LATITUDES, LONGITUDES, great_circle_m, is_place

#: Above this number of boxes they are joined through the grid instead of being broadcast.
BROADCAST_BOXES = 300
#: Side of the grid cells of that join, in degrees.
BOX_CELL = 0.1


def _degrees(radius_m: float) -> tuple[float, float]:
    """Degrees of latitude and, at the highest latitude, of longitude that a circle may reach, a little enlarged."""
    lat = math.degrees(radius_m / EARTH_RADIUS_M) * 1.0001
    top = math.radians(min(89.0, LATITUDES[1] + lat))
    half = math.degrees(2 * math.asin(min(1.0, math.sin(radius_m / EARTH_RADIUS_M / 2) / math.cos(top)))) * 1.0001
    return lat, half


def places(points: DataFrame) -> DataFrame:
    """Distinct ``(lat, lon)`` of the rows of ``points`` that are places."""
    return points.filter(is_place(F.col("lat"), F.col("lon"))).select("lat", "lon").distinct()


def near_places(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Pairs ``(lat, lon, lat2, lon2, metres)`` of places at most ``radius_m`` apart."""
    reach_lat, reach_lon = _degrees(radius_m)
    cell_lat, cell_lon = 2 * reach_lat, 2 * reach_lon
    cell = lambda x, size: F.floor(x / size).cast("long")
    a = places(left).select("lat", "lon", cell(F.col("lat"), cell_lat).alias("cy"), cell(F.col("lon"), cell_lon).alias("cx"))
    b = places(right).select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    span = lambda x, reach, size: F.sequence(cell(x - reach, size), cell(x + reach, size))
    b = b.withColumn("cy", F.explode(span(F.col("lat2"), reach_lat, cell_lat))).withColumn("cx", F.explode(span(F.col("lon2"), reach_lon, cell_lon)))
    close = a.join(b, ["cy", "cx"]).filter((F.abs(F.col("lat") - F.col("lat2")) <= reach_lat) & (F.abs(F.col("lon") - F.col("lon2")) <= reach_lon))
    return close.withColumn("metres", great_circle_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).filter(F.col("metres") <= radius_m).select("lat", "lon", "lat2", "lon2", "metres")


def near_rows(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Every pair of a row of ``left`` and a row of ``right`` at most ``radius_m`` apart.

    Both have ``lat`` and ``lon``, which aren't in the result. ``metres`` is added; other columns of ``right`` whose names
    occur in ``left`` too, or are ``metres``, begin with ``right_``.
    """
    pairs = near_places(left, right, radius_m).withColumnsRenamed({c: "__" + c for c in ("lat", "lon", "lat2", "lon2", "metres")})
    mine = left.withColumnsRenamed({"lat": "__lat", "lon": "__lon", "metres": "left_metres"})
    clash = {c: "right_" + c for c in right.columns if c not in ("lat", "lon") and (c in left.columns or c == "metres")}
    other = right.withColumnsRenamed(clash | {"lat": "__lat2", "lon": "__lon2"})
    both = pairs.join(mine, ["__lat", "__lon"]).join(other, ["__lat2", "__lon2"])
    return both.drop("__lat", "__lon", "__lat2", "__lon2").withColumnRenamed("__metres", "metres")


def boxes_around(points: DataFrame, boxes: DataFrame, broadcast_boxes: int = BROADCAST_BOXES) -> DataFrame:
    """Rows of ``points`` (``lat``, ``lon``) with each row of ``boxes`` (south, west, north, east) around them."""
    points = points.filter(is_place(F.col("lat"), F.col("lon")))
    boxes = boxes.filter("south <= north AND west <= east")
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    if boxes.limit(broadcast_boxes + 1).count() <= broadcast_boxes:
        return points.join(F.broadcast(boxes), inside)
    gridded = boxes.withColumn("cy", F.explode(_cells("south", "north", LATITUDES))).withColumn("cx", F.explode(_cells("west", "east", LONGITUDES)))
    return points.withColumns({"cy": _cell(F.col("lat")), "cx": _cell(F.col("lon"))}).join(gridded, ["cy", "cx"]).filter(inside).drop("cy", "cx")


def _cell(x: Column) -> Column:
    return F.floor(x / BOX_CELL).cast("long")


def _cells(low: str, high: str, places: tuple[float, float]) -> Column:
    """Cells between two bounds, as far as there can be places."""
    first, last = _cell(F.greatest(F.col(low), F.lit(places[0]))), _cell(F.least(F.col(high), F.lit(places[1])))
    return F.when(first <= last, F.sequence(first, last))


def bands_around(points: DataFrame, boxes: DataFrame, broadcast_boxes: int = BROADCAST_BOXES) -> DataFrame:
    """Rows of ``points`` with each row of ``boxes`` whose south and north lie around them, wherever it ends east and west."""
    points = points.filter(is_place(F.col("lat"), F.col("lon")))
    boxes, inside = boxes.filter("south <= north"), F.col("lat").between(F.col("south"), F.col("north"))
    if boxes.limit(broadcast_boxes + 1).count() <= broadcast_boxes:
        return points.join(F.broadcast(boxes), inside)
    banded = boxes.withColumn("cy", F.explode(_cells("south", "north", LATITUDES)))
    return points.withColumn("cy", _cell(F.col("lat"))).join(banded, "cy").filter(inside).drop("cy")


def entrance_points(entrances: DataFrame) -> DataFrame:
    """``(record_no, entrance_pos, lat, lon)`` of the entrances of all records, null elements skipped but counted."""
    row = "named_struct('entrance_pos', i + 1, 'lat', e.lat, 'lon', e.lon)"
    return entrances.select("record_no", F.expr(f"inline(transform(entrances, (e, i) -> {row}))")).filter("lat IS NOT NULL AND lon IS NOT NULL")
