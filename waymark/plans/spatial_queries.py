"""Boxes, polygons, distances, components and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import great_circle_m
from ..operators import assign, graph, nearby, rank, spatial
from ..sources.tables import load
from . import views
from .registry import Registry

query = Registry()

#: Components join roads of one name that lie at most so far apart.
NEAR_M = 20_000.0

#: An outer ring with a hole, as (lat, lon).
OUTER = [(35.3, 137.4), (36.9, 137.5), (36.6, 138.8), (35.5, 138.6), (35.3, 137.4)]
HOLE = [(35.9, 137.9), (36.3, 137.9), (36.3, 138.3), (35.9, 138.3), (35.9, 137.9)]


@query(views.sql("road", "box") + " SELECT id, box.name AS municipality FROM road JOIN box ON lat BETWEEN south - 0.015 AND north + 0.015 AND lon BETWEEN west - 0.015 AND east + 0.015")
def bbox_margin(spark, folder):
    wider = views.box(spark, folder).select(F.col("name").alias("municipality"), (F.col("south") - 0.015).alias("south"), (F.col("north") + 0.015).alias("north"), (F.col("west") - 0.015).alias("west"), (F.col("east") + 0.015).alias("east"))
    return nearby.boxes_around(views.road(spark, folder).select("id", "lat", "lon"), wider).select("id", "municipality")


@query(views.sql("road", "box") + " SELECT id, count(*) FILTER (ok) AS verified, count(*) FILTER (NOT ok) AS rejected FROM (SELECT id, lon BETWEEN west AND east AS ok FROM road JOIN box ON lat BETWEEN south AND north) GROUP BY 1")
def match_reject_counts(spark, folder):
    # The join is on one axis, the other decides.
    boxes = views.box(spark, folder).select("south", "north", "west", "east")
    hits = nearby.bands_around(views.road(spark, folder).select("id", "lat", "lon"), boxes).withColumn("ok", F.col("lon").between(F.col("west"), F.col("east")))
    return hits.groupBy("id").agg(F.count_if("ok").alias("verified"), F.count_if(~F.col("ok")).alias("rejected"))


_AREA = "CAST(round((north - south) * 1000) * round((east - west) * 1000) AS BIGINT)"


@query(views.sql("road", "box") + f" SELECT road.id, min_by(box.name, struct_pack(a := {_AREA}, b := box.name)) AS municipality FROM road LEFT JOIN box ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY 1")
def smallest_bbox(spark, folder):
    boxes = views.box(spark, folder).withColumn("area", (F.round((F.col("north") - F.col("south")) * 1000) * F.round((F.col("east") - F.col("west")) * 1000)).cast("long"))
    points = views.road(spark, folder).select(F.col("id").alias("point"), "lat", "lon")
    return spatial.smallest_box(points, boxes.select("name", "south", "west", "north", "east", "area")).select(F.col("point").alias("id"), F.col("name").alias("municipality"))


@query("SELECT map_row FROM mvp_map_data JOIN municipality_bounds USING (municipality) WHERE displayLat BETWEEN boundingbox[1] AND boundingbox[2] AND displayLon BETWEEN boundingbox[3] AND boundingbox[4]")
def range_join_bbox(spark, folder):
    boxes = views.box(spark, folder).withColumnRenamed("name", "municipality")
    inside = F.col("displayLat").between(F.col("south"), F.col("north")) & F.col("displayLon").between(F.col("west"), F.col("east"))
    return load(spark, folder, "mvp_map_data").select("map_row", "municipality", "displayLat", "displayLon").join(boxes, "municipality").filter(inside).select("map_row")


def _haversine(a: str, b: str) -> str:
    h = f"(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))"
    return f"2 * 6371000 * asin(sqrt(least(1, {h})))"


_PAIRS = f"SELECT a.k AS a, b.k AS b FROM road a JOIN road b ON a.name = b.name AND a.k < b.k AND {_haversine('a', 'b')} <= 20000"


def _near_pairs(spark, folder):
    """Pairs of roads of one name within ``NEAR_M``: joined per name and grid cell, not by name alone."""
    roads = views.road(spark, folder).select("k", "name", "lat", "lon")
    cell_lat, cell_lon = 0.18, 0.26
    at = lambda c, size: F.floor(F.col(c) / size).cast("long")
    left = roads.withColumns({"cy": at("lat", cell_lat), "cx": at("lon", cell_lon)})
    around = roads.select(F.col("k").alias("k2"), "name", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    around = around.withColumn("cy", F.explode(F.sequence(at("lat2", cell_lat) - 1, at("lat2", cell_lat) + 1))).withColumn("cx", F.explode(F.sequence(at("lon2", cell_lon) - 1, at("lon2", cell_lon) + 1)))
    pairs = left.join(around, ["name", "cy", "cx"]).filter("k < k2")
    return pairs.filter(great_circle_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= NEAR_M).select(F.col("k").alias("a"), F.col("k2").alias("b"))


@query(views.sql("road") + " " + _PAIRS)
def self_distance_join(spark, folder):
    return _near_pairs(spark, folder)


def _component_sql(rest: str) -> str:
    return views.sql("road").replace("WITH ", "WITH RECURSIVE ", 1) + f", e AS ({_PAIRS}), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach AS (SELECT k AS v, k AS w FROM road UNION SELECT reach.v, u.b FROM reach JOIN u ON reach.w = u.a), comp AS (SELECT v, min(w) AS component FROM reach GROUP BY v) " + rest


def _components(spark, folder):
    roads = views.road(spark, folder)
    return graph.components(roads.select(F.col("k").alias("v")), _near_pairs(spark, folder))


@query(_component_sql("SELECT v, component FROM comp"))
def connected_components(spark, folder):
    return _components(spark, folder)


@query(_component_sql("""SELECT s.component, s.n, b.brand, s.lat_e5, s.lon_e5, s.lowest, s.highest
FROM (SELECT component, count(*) AS n, CAST(round(sum(lat * 1e5)) AS BIGINT) // count(*) AS lat_e5, CAST(round(sum(lon * 1e5)) AS BIGINT) // count(*) AS lon_e5, min(v) AS lowest, max(v) AS highest FROM comp JOIN road ON v = k GROUP BY 1) s
JOIN (SELECT component, brand, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, min(v), brand) AS r FROM comp JOIN road ON v = k GROUP BY 1, 2) b ON s.component = b.component AND r = 1"""))
def component_summary(spark, folder):
    rows = _components(spark, folder).join(views.road(spark, folder).select(F.col("k").alias("v"), "brand", "lat", "lon"), "v")
    centre = lambda c: F.floor(F.round(F.sum(F.col(c) * 1e5)).cast("long") / F.count("*")).alias(c + "_e5")
    brand = rank.mode_first(rows, ["component"], "brand", "v").select("component", "brand")
    # Members are rows of ``connected_components``; a component of any size is one row of numbers here.
    sums = rows.groupBy("component").agg(F.count("*").alias("n"), centre("lat"), centre("lon"), F.min("v").alias("lowest"), F.max("v").alias("highest"))
    return sums.join(brand, "component").select("component", "n", "brand", "lat_e5", "lon_e5", "lowest", "highest")


@query(_component_sql("SELECT component, CAST((r - 1) // 50 AS BIGINT) AS page, string_agg(CAST(v AS VARCHAR), '/' ORDER BY v) AS members FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY v) AS r FROM comp) GROUP BY 1, 2"))
def component_members(spark, folder):
    pages = rank.paged(_components(spark, folder), ["component"], "v", 50)
    return pages.select("component", "page", F.array_join(F.transform("values", lambda v: v.cast("string")), "/").alias("members"))


def _ring_sql(ring: list[tuple[float, float]], role: str) -> str:
    return ", ".join(f"('{role}', {a[0]:e}, {a[1]:e}, {b[0]:e}, {b[1]:e})" for a, b in zip(ring, ring[1:], strict=False))


@query(views.sql("road") + f", edge(role, y1, x1, y2, x2) AS (VALUES {_ring_sql(OUTER, 'outer')}, {_ring_sql(HOLE, 'inner')}), hit AS (SELECT id, role FROM road JOIN edge ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) SELECT id FROM hit GROUP BY id HAVING count(*) FILTER (role = 'outer') % 2 = 1 AND count(*) FILTER (role = 'inner') % 2 = 0")
def point_in_polygon(spark, folder):
    rings = spark.createDataFrame([(1, "outer", 1, OUTER), (1, "inner", 2, HOLE)], "polygon int, role string, ring int, points array<struct<lat: double, lon: double>>")
    points = views.road(spark, folder).select(F.col("id").alias("point"), "lat", "lon")
    return spatial.points_in_polygons(points, rings).select(F.col("point").alias("id"))


@query(views.sql("box") + " SELECT name AS polygon, CAST(5 AS INTEGER) AS n_points, CAST(round((north - south) * (east - west) * 1e6) AS BIGINT) AS area FROM box WHERE south < north AND west < east")
def stitched_rings(spark, folder):
    # The sides of each box, every other one turned round, in an order of their own.
    corner = lambda y, x: F.struct(F.col(y).alias("lat"), F.col(x).alias("lon"))
    sw, se, ne, nw = corner("south", "west"), corner("south", "east"), corner("north", "east"), corner("north", "west")
    sides = F.array(F.array(ne, nw), F.array(sw, se), F.array(sw, nw), F.array(ne, se))
    pieces = views.box(spark, folder).filter("south < north AND west < east").select(F.col("name").alias("polygon"), F.lit("outer").alias("role"), F.explode(sides).alias("points"))
    rings = spatial.stitched_rings(pieces)
    turns = F.transform(F.sequence(F.lit(0), F.size("points") - 2), lambda k: F.get("points", k)["lon"] * F.get("points", k + 1)["lat"] - F.get("points", k + 1)["lon"] * F.get("points", k)["lat"])
    area = F.abs(F.aggregate(turns, F.lit(0.0), lambda a, x: a + x)) / 2
    return rings.select("polygon", F.size("points").alias("n_points"), F.round(area * 1e6).cast("long").alias("area"))


_PICK = "CASE WHEN NOT list_contains(w.taken, o.c) THEN o.c WHEN NOT list_contains(w.taken, o.c + 1) THEN o.c + 1 END"


@query(f"""WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS rn, o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderstatus = 'P'),
w AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS k, CAST(NULL AS BIGINT) AS pick UNION ALL SELECT o.rn, list_append(w.taken, CAST({_PICK} AS BIGINT)), o.k, CAST({_PICK} AS BIGINT) FROM w JOIN o ON o.rn = w.rn + 1) SELECT k AS new, pick AS old FROM w WHERE pick IS NOT NULL""")
def greedy_assign(spark, folder):
    # Each order claims the candidates of its customer's neighbourhood; earlier orders go first.
    orders = load(spark, folder, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("new"), F.explode(F.array(F.col("o_custkey"), F.col("o_custkey") + 1)).alias("old"), F.col("o_orderkey").alias("order"))
    return assign.greedy_claims(orders.withColumn("preference", F.col("old")))


@query(views.sql("road") + ", c AS (SELECT r.id, x.id AS other, CASE WHEN r.name = x.name AND r.muni = x.muni THEN 1 WHEN r.name = x.name THEN 2 ELSE 3 END AS step, x.k FROM (SELECT * FROM road WHERE size <= 3) r JOIN (SELECT * FROM road WHERE size > 3) x ON split_part(r.name, ' ', 1) = split_part(x.name, ' ', 1)) SELECT id, other, CAST(step AS INTEGER) AS step FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step, k) AS rn FROM c) WHERE rn = 1")
def cascade_match(spark, folder):
    roads = views.road(spark, folder)
    left = roads.filter("size <= 3").select("id", "name", "muni")
    # Only the best of each group on the right can win, so groups are cut down before they meet.
    right = roads.filter("size > 3").select(F.col("id").alias("other"), F.col("name").alias("name2"), F.col("muni").alias("muni2"), "k")
    word = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    exact = left.join(rank.first_by(right, ["name2", "muni2"], F.col("k")), (F.col("name") == F.col("name2")) & (F.col("muni") == F.col("muni2"))).withColumn("step", F.lit(1))
    same = left.join(rank.first_by(right, ["name2"], F.col("k")), F.col("name") == F.col("name2")).withColumn("step", F.lit(2))
    close = left.withColumn("w", word("name")).join(rank.first_by(right.withColumn("w", word("name2")), ["w"], F.col("k")), "w").withColumn("step", F.lit(3))
    cols = ["id", "other", "step", "k"]
    every = exact.select(*cols).unionByName(same.select(*cols)).unionByName(close.select(*cols))
    return rank.first_by(every, ["id"], F.col("step"), F.col("k")).select("id", "other", "step")


@query("SELECT record_no, CAST(i AS INTEGER) AS pos, CASE WHEN len(entrances) > 0 THEN entrances[i].id ELSE 'REP' END AS point FROM (SELECT *, unnest(CASE WHEN len(entrances) > 0 THEN range(1, len(entrances) + 1) ELSE [0] END) AS i FROM nagano_entrances)")
def explode_or_default(spark, folder):
    some = F.coalesce(F.size("entrances") > 0, F.lit(False))
    rows = F.when(some, F.transform("entrances", lambda e, i: F.struct((i + 1).alias("pos"), e["id"].alias("point")))).otherwise(F.array(F.struct(F.lit(0).alias("pos"), F.lit("REP").alias("point"))))
    return load(spark, folder, "nagano_entrances").select("record_no", F.inline(rows))


@query("SELECT record_no, CASE WHEN e.lat IS NOT NULL AND e.lon IS NOT NULL THEN CAST(round(2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(e.lat - 36.0) / 2), 2) + cos(radians(36.0)) * cos(radians(e.lat)) * pow(sin(radians(e.lon - 138.0) / 2), 2))))) AS BIGINT) END AS metres FROM (SELECT record_no, list_filter(entrances, lambda x: x.status = 'verified')[1] AS e FROM nagano_entrances)")
def distance_to_point(spark, folder):
    first = F.get(F.filter("entrances", lambda e: e["status"] == "verified"), F.lit(0))
    metres = F.round(great_circle_m(F.lit(36.0), F.lit(138.0), F.col("e.lat"), F.col("e.lon"))).cast("long")
    return load(spark, folder, "nagano_entrances").select("record_no", first.alias("e")).select("record_no", F.when(F.isnan("e.lat") | F.isnan("e.lon"), None).otherwise(metres).alias("metres"))
