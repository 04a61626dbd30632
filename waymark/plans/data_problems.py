"""Queries of the general data problems (p1, p2, p5, p7) over whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NARROW_ASCII, WIDE_ASCII
from ..operators import nearby, nested, orphans, segments
from ..sources.tables import load

NEAR_M = 30.0


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.keyed_children(load(spark, folder, "nagano_entrances"), load(spark, folder, "karte"), load(spark, folder, "raw_records"))


def p1_roads(spark: SparkSession, folder: str) -> DataFrame:
    return nested.all_roads(load(spark, folder, "nagano_entrances"), load(spark, folder, "raw_records"))


def p1_cards(spark: SparkSession, folder: str) -> DataFrame:
    return nested.all_cards(load(spark, folder, "karte"), load(spark, folder, "raw_records"))


def p1_entrances(spark: SparkSession, folder: str) -> DataFrame:
    return nested.all_entrances(load(spark, folder, "nagano_entrances"), load(spark, folder, "raw_records"))


def p1_sources(spark: SparkSession, folder: str) -> DataFrame:
    return nested.all_sources(load(spark, folder, "karte"), load(spark, folder, "raw_records"))


def p1_typed_entrances(spark: SparkSession, folder: str) -> DataFrame:
    return nested.table_entrances(load(spark, folder, "nagano_entrances")).filter("child_key IS NOT NULL").select("record_no", "child_pos", "parent_key", "child_key", "status", "pointType")


def p1_typed_sources(spark: SparkSession, folder: str) -> DataFrame:
    return nested.table_sources(load(spark, folder, "karte")).filter("child_key IS NOT NULL").select("record_no", "child_pos", "parent_key", "child_key", "title", "note")


def p1_typed_roads(spark: SparkSession, folder: str) -> DataFrame:
    return p1_roads(spark, folder).filter("src = 'nagano_entrances'").select("record_no", "road_pos", "road_key", "classification", "n_children")


def p1_typed_cards(spark: SparkSession, folder: str) -> DataFrame:
    return p1_cards(spark, folder).filter("src = 'karte'").select("record_no", "road_pos", "card_key", "name", "n_children")


def _references(spark: SparkSession, folder: str) -> DataFrame:
    locations = orphans.references(load(spark, folder, "suwa_chino_locations"), "suwa_chino_locations", "ID", "loc_row", "received_at")
    return locations.unionByName(orphans.references(load(spark, folder, "nagano_entrances"), "nagano_entrances", "roadId", "record_no", "received_at"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_references(_references(spark, folder), load(spark, folder, "suwa_chino_candidates"))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(_references(spark, folder), load(spark, folder, "suwa_chino_candidates"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return segments.split_cells(load(spark, folder, "nagano_current_plan"), "plan_row")


def _displayed(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "mvp_map_data").select("map_row", F.col("displayLat").alias("lat"), F.col("displayLon").alias("lon"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    entrances = nearby.entrance_points(load(spark, folder, "nagano_entrances"))
    return nearby.near_rows(_displayed(spark, folder), entrances, NEAR_M).select("map_row", "record_no", "entrance_pos")


def p7_boxes(spark: SparkSession, folder: str) -> DataFrame:
    b = F.col("boundingbox")
    boxes = load(spark, folder, "municipality_bounds").select("municipality", "region_name", F.get(b, F.lit(0)).alias("south"), F.get(b, F.lit(1)).alias("north"), F.get(b, F.lit(2)).alias("west"), F.get(b, F.lit(3)).alias("east"))
    return nearby.boxes_around(_displayed(spark, folder), boxes).select("map_row", "municipality", "region_name")


_NARROW = NARROW_ASCII.replace("'", "''")


def _key(column: str) -> str:
    return f"upper(trim(translate({column}, '{WIDE_ASCII}　\xa0', '{_NARROW}  ')))"


_REFERENCES = f"""
SELECT 'suwa_chino_locations' AS ref_table, loc_row AS ref_row, {_key('ID')} AS k, received_at AS t FROM suwa_chino_locations
UNION ALL SELECT 'nagano_entrances', record_no, {_key('"roadId"')}, received_at FROM nagano_entrances"""
_REGISTER = f"SELECT {_key('ID')} AS k, loaded_at AS a, withdrawn_at AS b FROM suwa_chino_candidates"
_MONTH = "strftime(CAST(t AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m')"
_ORPHAN = "NOT EXISTS (SELECT 1 FROM g WHERE g.k = r.k AND g.a <= r.t AND (g.b IS NULL OR g.b > r.t))"
_PLACE = "{0} BETWEEN 20 AND 50 AND {1} BETWEEN 120 AND 155"

QUERIES = {f.__name__: f for f in (p1_found, p1_roads, p1_cards, p1_entrances, p1_sources, p1_typed_entrances, p1_typed_sources, p1_typed_roads, p1_typed_cards, p2_found, p2_report, p5_found, p7_found, p7_boxes)}

ORACLES = {
    "p1_typed_entrances": "SELECT record_no, CAST(i AS INTEGER) AS child_pos, roadId AS parent_key, entrances[i].id AS child_key, entrances[i].status AS status, entrances[i].pointType AS \"pointType\" FROM (SELECT *, unnest(range(1, len(entrances) + 1)) AS i FROM nagano_entrances) WHERE regexp_matches(entrances[i].id, '[^\\s　]')",
    "p1_typed_sources": "SELECT card_row AS record_no, CAST(i AS INTEGER) AS child_pos, id AS parent_key, sources[i].url AS child_key, sources[i].title AS title, sources[i].note AS note FROM (SELECT *, unnest(range(1, len(sources) + 1)) AS i FROM karte) WHERE regexp_matches(sources[i].url, '[^\\s　]')",
    "p1_typed_roads": "SELECT record_no, CAST(1 AS INTEGER) AS road_pos, roadId AS road_key, classification, CAST(coalesce(len(entrances), 0) AS INTEGER) AS n_children FROM nagano_entrances",
    "p1_typed_cards": "SELECT card_row AS record_no, CAST(1 AS INTEGER) AS road_pos, id AS card_key, name, CAST(coalesce(len(sources), 0) AS INTEGER) AS n_children FROM karte",
    "p2_found": f"WITH r AS ({_REFERENCES}), g AS ({_REGISTER}) SELECT ref_table, ref_row, {_MONTH} AS period FROM r WHERE k <> '' AND t IS NOT NULL AND {_ORPHAN}",
    "p2_report": f"WITH r AS ({_REFERENCES}), g AS ({_REGISTER}) SELECT ref_table, {_MONTH} AS period, count(*) AS n_references, count(*) FILTER ({_ORPHAN}) AS n_orphans FROM r WHERE k <> '' AND t IS NOT NULL GROUP BY ALL",
    "p7_found": f"""WITH e AS (SELECT record_no, CAST(i AS INTEGER) AS entrance_pos, entrances[i].lat AS lat, entrances[i].lon AS lon FROM (SELECT *, unnest(range(1, len(entrances) + 1)) AS i FROM nagano_entrances)),
m AS (SELECT map_row, displayLat AS lat, displayLon AS lon FROM mvp_map_data WHERE {_PLACE.format('displayLat', 'displayLon')})
SELECT m.map_row, e.record_no, e.entrance_pos FROM m JOIN e ON abs(m.lat - e.lat) < 0.0003 AND {_PLACE.format('e.lat', 'e.lon')}
WHERE 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(m.lat - e.lat) / 2), 2) + cos(radians(m.lat)) * cos(radians(e.lat)) * pow(sin(radians(m.lon - e.lon) / 2), 2)))) <= 30""",
    "p7_boxes": f"SELECT map_row, municipality_bounds.municipality AS municipality, region_name FROM mvp_map_data JOIN municipality_bounds ON displayLat BETWEEN boundingbox[1] AND boundingbox[2] AND displayLon BETWEEN boundingbox[3] AND boundingbox[4] WHERE {_PLACE.format('displayLat', 'displayLon')}",
}
