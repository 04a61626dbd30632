"""Documents, pages, chunks of work, small expressions, exports and constraints of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, web
from ..functions.text import blank_to_null
from ..operators import evidence, graph, quality, rank, spatial
from ..sources import files, pages, sinks
from ..sources.tables import load, load_all
from . import views
from .registry import Registry
from .spatial_queries import OUTER, _near_pairs, _PAIRS, _ring_sql

query = Registry()


@query("SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'unreadable' ELSE 'text' END AS kind, nullif(length(text), 0) AS n FROM (SELECT doc_id, 'a' || text AS text FROM documents)")
def charset_decode(spark, folder):
    # Stored as bytes in one of three encodings; what a header names wins, else the first that fits.
    text = F.concat(F.lit("a"), F.col("text"))
    kind = F.col("doc_id") % 3
    stored = F.when(kind == 0, F.encode(text, "UTF-16")).otherwise(F.encode(text, "UTF-8"))
    header = F.when(kind == 0, "text/plain; charset=utf-16").when(kind == 1, "text/plain; charset=no-such")
    docs = load(spark, folder, "documents").select("doc_id", stored.alias("content"), header.alias("header"))
    read = docs.select("doc_id", F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "unreadable").otherwise("text").alias("kind"), pages.decoded("content", "header").alias("text"))
    return read.select("doc_id", "kind", F.length("text").cast("long").alias("n"))


@query("SELECT DISTINCT sha256(url) AS key FROM documents WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM documents WHERE source = 'forum' AND url IS NOT NULL)")
def text_cache(spark, folder):
    docs = load(spark, folder, "documents")
    cache = docs.filter("source = 'forum' AND url IS NOT NULL").select(F.sha2("url", 256).alias("key")).distinct()
    return pages.still_wanted(docs, cache).select(F.sha2("url", 256).alias("key"))


@query("SELECT id, (row_number() OVER (ORDER BY id) - 1) // 150 AS chunk FROM (SELECT DISTINCT id FROM mvp_map_data WHERE id IS NOT NULL AND id NOT IN (SELECT ID FROM suwa_chino_locations WHERE ID IS NOT NULL))")
def resume_chunks(spark, folder):
    cached = load(spark, folder, "suwa_chino_locations").select(F.col("ID").alias("id")).filter("id IS NOT NULL")
    return pages.in_chunks(files.new_only(load(spark, folder, "mvp_map_data").select("id"), cached, "id"), "id")


@query("SELECT event_id, tile FROM (SELECT event_id, tile, row_number() OVER (PARTITION BY event_id ORDER BY tile DESC) AS r FROM (SELECT event_id, 0 AS tile FROM events WHERE value < 60 UNION ALL SELECT event_id, 1 FROM events WHERE value > 40 UNION ALL SELECT event_id, 2 FROM events WHERE event_type = 'click')) WHERE r = 1")
def tile_union(spark, folder):
    events = load(spark, folder, "events")
    parts = [events.filter(c).select("event_id", F.lit(k).alias("tile")) for k, c in enumerate(("value < 60", "value > 40", "event_type = 'click'"))]
    return files.tiles_union(parts, "event_id")


@query("SELECT municipality, region_name FROM municipality_bounds ORDER BY \"osmId\" DESC, municipality LIMIT 1")
def exactly_one(spark, folder):
    bounds = load(spark, folder, "municipality_bounds")
    top = bounds.agg(F.max(F.struct("osmId", F.col("municipality"))).alias("t")).select("t.osmId").first()
    chosen = bounds.filter(F.col("osmId") == (top.osmId if top else None))
    return files.exactly_one(rank.first_by(chosen, ["osmId"], F.col("municipality")), "boundary").select("municipality", "region_name")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, ts, event_id) AS r FROM events) WHERE r = 1")
def first_preferred(spark, folder):
    return rank.first_preferred(load(spark, folder, "events"), ["user_id"], F.col("event_type") == "purchase", F.col("ts"), F.col("event_id")).select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (value >= 95) DESC, CASE WHEN value < 95 THEN -value END, ts, event_id) AS r FROM events) WHERE r = 1")
def first_reaching(spark, folder):
    return rank.first_reaching(load(spark, folder, "events"), ["user_id"], F.col("value"), 95, F.col("ts"), F.col("event_id")).select("user_id", "event_id")


@query("SELECT doc_id, regexp_replace(url, '#.*$', '') AS url FROM documents WHERE regexp_matches(url, '^https?://')")
def result_blocks(spark, folder):
    item = lambda body: F.concat(F.lit("<li class='r'>"), body, F.lit("</li>\n"))
    anchor = lambda address: F.concat(F.lit('<b>x</b> <a class="t" href="'), address, F.lit('">page</a>'))
    page = F.concat(F.lit("<ul>"), item(anchor(F.lit("/own"))), item(F.concat(anchor(F.concat("url", F.lit("#a"))), anchor(F.lit("https://second.example/")))), item(anchor(F.concat("url", F.lit("#b")))), item(F.lit("none")), F.lit("</ul>"))
    docs = load(spark, folder, "documents").filter("url IS NOT NULL").select("doc_id", page.alias("page"))
    return docs.select("doc_id", F.explode(web.result_links(F.col("page"))).alias("url"))


@query("SELECT municipality, region_name AS section, '/plan/' || CAST(\"osmId\" AS VARCHAR) || '.pdf' AS href FROM municipality_bounds")
def catalog_rows(spark, folder):
    # One catalog page of all municipalities under the headings of their regions, read back.
    row = F.concat(F.lit("<tr><td>"), "municipality", F.lit('</td><td><a href="/plan/'), F.col("osmId").cast("string"), F.lit('.pdf">PDF</a></td></tr>'))
    sections = load(spark, folder, "municipality_bounds").groupBy("region_name").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    section = F.concat(F.lit("<h3>"), "region_name", F.lit("</h3><table><tr><th>none</th></tr>"), "rows", F.lit("</table>"))
    page = sections.agg(F.concat(F.lit("<html><h1>all</h1>"), F.array_join(F.array_sort(F.collect_list(section)), "\n"), F.lit("</html>")).alias("page"))
    found = page.select(F.inline(web.catalog_rows(F.col("page"))))
    return found.select(F.regexp_replace("label", " *PDF$", "").alias("municipality"), "section", "href")


@query("WITH d AS (SELECT doc_id, regexp_extract(url, '^https?://[^/?#]+') AS root, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') AS dir FROM documents WHERE regexp_matches(url, '^https?://[^/?#]+/')) SELECT doc_id, CAST(0 AS INTEGER) AS position, root || '/plan/a.pdf' AS url FROM d UNION ALL SELECT doc_id, 2, dir || 'b.PDF?v=1' FROM d UNION ALL SELECT doc_id, 3, 'https://other.example/c.pdf' FROM d")
def document_links(spark, folder):
    page = F.lit('<p><a href="/plan/a.pdf#p2">林道整備計画</a> <a href="x.html">林道</a><a class="k" href="b.PDF?v=1">林道一覧</a><a href="//other.example/c.pdf">林道</a><a href="d.pdf">予算</a><a href="/plan/a.pdf">林道整備計画</a></p>')
    docs = load(spark, folder, "documents").filter(F.col("url").rlike("^https://[^/?#]+/")).select("doc_id", "url", page.alias("page"))
    return web.document_links(docs, "doc_id", "url", "page", "林道")


@query("SELECT municipality, region_name, coalesce(area, '他') AS area FROM municipality_bounds LEFT JOIN (VALUES ('東信', 'EN'), ('北信', 'EN'), ('中信', 'CS'), ('南信', 'CS')) v(region_name, area) USING (region_name)")
def inline_relation(spark, folder):
    areas = spark.createDataFrame([("東信", "EN"), ("北信", "EN"), ("中信", "CS"), ("南信", "CS")], "region_name string, area string")
    return load(spark, folder, "municipality_bounds").join(F.broadcast(areas), "region_name", "left").select("municipality", "region_name", F.coalesce("area", F.lit("他")).alias("area"))


@query("SELECT map_row, name FROM mvp_map_data ORDER BY map_row LIMIT 17")
def first_rows(spark, folder):
    return files.first_rows(load(spark, folder, "mvp_map_data").select("map_row", "name"), "map_row", 17)


@query("SELECT 'karte' AS name, count(*) AS n FROM karte UNION ALL SELECT 'mvp_map_data', count(*) FROM mvp_map_data UNION ALL SELECT 'nagano_entrances', count(*) FROM nagano_entrances")
def load_all_tables(spark, folder):
    tables = load_all(spark, folder, ["karte", "mvp_map_data", "nagano_entrances"])
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return quality.all_of(*parts)


_CARD = """'{"id":' || CASE WHEN id IS NULL THEN 'null' ELSE '"' || id || '"' END || ',"row":' || CAST(card_row AS VARCHAR) || '}'"""


@query(f"SELECT row_number() OVER (ORDER BY id NULLS FIRST, card_row) AS position, {_CARD} AS object FROM karte")
def json_export(spark, folder):
    cards = load(spark, folder, "karte").select("id", F.col("card_row").alias("row"))
    return sinks.objects(cards, F.asc_nulls_first("id"), F.asc("row"))


@query("SELECT doc_id, kind, n FROM (SELECT doc_id, 'fresh' AS kind, length(text) AS n FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'cached', 0 FROM documents WHERE lang IS NULL OR lang <> 'en')")
def result_cache(spark, folder):
    docs = load(spark, folder, "documents")
    cache = docs.select("doc_id", F.lit("cached").alias("kind"), F.lit(0).cast("long").alias("n"))
    fresh = docs.filter("lang = 'en'").select("doc_id", F.lit("fresh").alias("kind"), F.length("text").cast("long").alias("n"))
    return sinks.with_errors_kept(cache, fresh, "doc_id")


@query(r"SELECT doc_id, left(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')), 500) AS excerpt, concat_ws('|', CASE WHEN contains(text, '林道') THEN '林道' END, CASE WHEN contains(text, '通行') THEN '通行' END) AS attributes FROM documents")
def evidence_row(spark, folder):
    marks = F.array(*[F.when(F.contains("text", F.lit(w)), F.lit(w)).otherwise(F.lit("")) for w in ("林道", "通行", "林道")])
    return load(spark, folder, "documents").select("doc_id", evidence.evidence_row(F.col("text"), marks).alias("e")).select("doc_id", "e.excerpt", F.array_join("e.attributes", "|").alias("attributes"))


_T = r"regexp_replace({0}, '[ \t\n\r\f\x0B]', '', 'g')"


@query(f"WITH t AS (SELECT map_row, CASE WHEN i <> '' THEN {_T.format('i')} ELSE {_T.format('name')} END AS t FROM (SELECT map_row, name, regexp_extract(name, '[（(](林道[^（）()]*)[）)]', 1) AS i FROM mvp_map_data WHERE name IS NOT NULL AND NOT contains(name, '事業'))) SELECT map_row, CASE WHEN ends_with(t, '支線') THEN substr(t, 3, length(t) - 4) ELSE substr(t, 3) END AS stem, ends_with(t, '支線') AS others FROM t WHERE starts_with(t, '林道')")
def bracketed_name(spark, folder):
    parsed = names.bracketed_name(F.col("name"), "林道", "支線", "事業")
    return load(spark, folder, "mvp_map_data").select("map_row", parsed.alias("p")).filter("p IS NOT NULL").select("map_row", "p.stem", "p.others")


@query(r"SELECT plan_row, regexp_replace(事業内容, '[\s\x0B\x{85}\p{Z}]+', '', 'g') AS clean FROM nagano_current_plan")
def drop_blanks(spark, folder):
    return load(spark, folder, "nagano_current_plan").select("plan_row", F.regexp_replace("事業内容", r"(?U)\s+", "").alias("clean"))


@query(r"SELECT plan_row, CAST(len(l) AS INTEGER) AS n, array_to_string(l, '／') AS parts FROM (SELECT plan_row, flatten(list_transform(list_filter(list_transform(string_split(replace(関係市町村, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> ''), lambda x: CASE WHEN len(list_filter(list_transform(string_split(x, '・'), lambda p: regexp_replace(p, '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g')), lambda p: NOT ends_with(p, '市') OR p = '市')) = 0 THEN list_transform(string_split(x, '・'), lambda p: regexp_replace(p, '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g')) ELSE [x] END)) AS l FROM nagano_current_plan WHERE 関係市町村 IS NOT NULL)")
def split_compound(spark, folder):
    parts = files.split_compound(F.col("関係市町村"), "市")
    return load(spark, folder, "nagano_current_plan").filter("`関係市町村` IS NOT NULL").select("plan_row", parts.alias("l")).select("plan_row", F.size("l").alias("n"), F.array_join("l", "／").alias("parts"))


@query("WITH s AS (SELECT record_no, unnest(range(1, len(entrances) + 1)) AS i, entrances FROM nagano_entrances), f AS (SELECT record_no, entrances[i].surface AS v, min(i) AS p FROM s WHERE coalesce(entrances[i].surface, '') <> '' GROUP BY 1, 2) SELECT n.record_no, coalesce(string_agg(f.v, '/' ORDER BY p), '') AS surfaces FROM nagano_entrances n LEFT JOIN f ON n.record_no = f.record_no GROUP BY 1")
def join_field(spark, folder):
    surfaces = F.coalesce(F.transform("entrances", lambda e: e["surface"]), F.expr("CAST(array() AS ARRAY<STRING>)"))
    values = F.filter(surfaces, lambda v: v.isNotNull() & (v != ""))
    return load(spark, folder, "nagano_entrances").select("record_no", F.array_join(F.array_distinct(values), "/").alias("surfaces"))


_OK = "{0} IS NOT NULL AND {1} IS NOT NULL AND NOT isnan({0}) AND NOT isnan({1})"
_E, _X, _D = (_OK.format(f'"{p}Lat"', f'"{p}Lon"') for p in ("entry", "exit", "display"))


@query(f"""SELECT map_row, CAST(CASE WHEN ({_E}) OR ({_X}) THEN CASE WHEN ({_E}) AND ({_X}) AND NOT ("entryLat" = "exitLat" AND "entryLon" = "exitLon") THEN 2 ELSE 1 END WHEN {_D} THEN 1 ELSE 0 END AS INTEGER) AS n,
CASE WHEN {_E} THEN 'entry' WHEN {_X} THEN 'exit' WHEN {_D} THEN 'centre' END AS first FROM mvp_map_data""")
def endpoints(spark, folder):
    point = lambda p: F.when(F.col(p + "Lat").isNotNull() & F.col(p + "Lon").isNotNull() & ~F.isnan(p + "Lat") & ~F.isnan(p + "Lon"), F.struct(F.col(p + "Lat").alias("lat"), F.col(p + "Lon").alias("lon")))
    df = load(spark, folder, "mvp_map_data").select("map_row", point("entry").alias("e"), point("exit").alias("x"), point("display").alias("d"))
    ends = F.array_distinct(F.array_compact(F.array("e", "x")))
    points = F.when(F.size(ends) > 0, ends).otherwise(F.array_compact(F.array("d")))
    first = F.when(F.col("e").isNotNull(), "entry").when(F.col("x").isNotNull(), "exit").when(F.col("d").isNotNull(), "centre")
    return df.select("map_row", F.size(points).alias("n"), first.alias("first"))


@query("SELECT cand_row, CASE WHEN contains(取得元, 'http') THEN 'http' WHEN contains(取得元, '県') THEN '県' WHEN contains(取得元, '市') THEN '市' ELSE '不明' END AS origin FROM suwa_chino_candidates")
def first_literal(spark, folder):
    return load(spark, folder, "suwa_chino_candidates").select("cand_row", names.first_contained(F.col("取得元"), ["http", "県", "市"], "不明").alias("origin"))


@query("SELECT map_row, 'https://map.example/dir?to=' || url_encode(name) || '&mode=drive' AS url FROM mvp_map_data WHERE name IS NOT NULL")
def address_build(spark, folder):
    address = F.concat(F.lit("https://map.example/dir?to="), web.encoded(F.col("name")), F.lit("&mode=drive"))
    return load(spark, folder, "mvp_map_data").filter("name IS NOT NULL").select("map_row", address.alias("url"))


@query("SELECT card_row, coalesce(label, '未確認') AS label FROM karte LEFT JOIN (VALUES ('high', '高'), ('medium', '中'), ('low', '低')) v(confidence, label) USING (confidence)")
def label_lookup(spark, folder):
    labels = F.create_map(*[F.lit(x) for pair in (("high", "高"), ("medium", "中"), ("low", "低")) for x in pair])
    return load(spark, folder, "karte").select("card_row", F.coalesce(F.when(F.col("confidence").isNotNull(), F.try_element_at(labels, F.col("confidence"))), F.lit("未確認")).alias("label"))


_BAD = "SELECT 'ID form' AS rule, CAST(cand_row AS VARCHAR) AS key FROM suwa_chino_candidates WHERE NOT coalesce(regexp_matches(ID, '^[A-Z]{3}-[0-9]{6}$'), false)"


@query(f"(SELECT rule, key FROM ({_BAD}) ORDER BY rule, key LIMIT 100) UNION ALL SELECT 'more', CAST(count(*) - 100 AS VARCHAR) FROM ({_BAD}) HAVING count(*) > 100")
def capped_errors(spark, folder):
    bad = quality.violated(load(spark, folder, "suwa_chino_candidates"), "cand_row", {"ID form": ~F.coalesce(F.col("ID").rlike("^[A-Z]{3}-[0-9]{6}$"), F.lit(False))})
    return quality.capped(bad)


@query("SELECT 'column ' || c || ' is missing' AS rule, c AS key FROM (VALUES ('ID'), ('林道名'), ('関係市町村'), ('取得元')) v(c) WHERE c NOT IN (SELECT column_name FROM (DESCRIBE suwa_chino_candidates))")
def dq_required(spark, folder):
    return quality.required(load(spark, folder, "suwa_chino_candidates"), ["ID", "林道名", "関係市町村", "取得元"])


@query("SELECT 'unknown confidence' AS rule, CAST(card_row AS VARCHAR) AS key FROM karte WHERE NOT coalesce(confidence IN ('high', 'medium', 'low'), false) UNION ALL SELECT 'no check date', CAST(card_row AS VARCHAR) FROM karte WHERE coalesce(trim(last_checked), '') = ''")
def dq_enum(spark, folder):
    rules = {"unknown confidence": quality.not_among("confidence", ["high", "medium", "low"]), "no check date": quality.is_blank(F.col("last_checked"))}
    return quality.violated(load(spark, folder, "karte"), "card_row", rules)


@query("""SELECT 'placeholder' AS rule, CAST(map_row AS VARCHAR) AS key FROM mvp_map_data WHERE "displayLat" = 0 AND "displayLon" = 0 UNION ALL SELECT 'too few placed', CAST(n AS VARCHAR) FROM (SELECT count(*) FILTER ("displayLat" BETWEEN 20 AND 50) AS n FROM mvp_map_data) WHERE n < 1000000000""")
def dq_minimum(spark, folder):
    df = load(spark, folder, "mvp_map_data")
    placeholders = quality.violated(df, "map_row", {"placeholder": (F.col("displayLat") == 0) & (F.col("displayLon") == 0)})
    return quality.all_of(placeholders, quality.too_few(df, F.col("displayLat").between(20, 50), 1_000_000_000, "too few placed"))


@query(f"""WITH l AS (SELECT map_row, id, ({_E}) AS a, ({_X}) AS b FROM mvp_map_data) SELECT 'no line' AS rule, CAST(map_row AS VARCHAR) AS key FROM l WHERE NOT (a AND b) UNION ALL SELECT 'unknown road', CAST(map_row AS VARCHAR) FROM l WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM karte WHERE id IS NOT NULL)""")
def dq_lines(spark, folder):
    here = lambda p: F.col(p + "Lat").isNotNull() & F.col(p + "Lon").isNotNull() & ~F.isnan(p + "Lat") & ~F.isnan(p + "Lon")
    df = load(spark, folder, "mvp_map_data")
    broken = quality.violated(df, "map_row", {"no line": ~(here("entry") & here("exit"))})
    return quality.all_of(broken, quality.missing(df, "id", "map_row", load(spark, folder, "karte"), "id", "unknown road"))


_SHARED = "SELECT a.k AS a, b.k AS b FROM road a JOIN road b ON a.brand = b.brand AND a.k < b.k AND (a.k // 4 = b.k // 4 OR a.k // 6 = b.k // 6)"


@query(views.sql("road").replace("WITH ", "WITH RECURSIVE ", 1) + f", e AS ({_PAIRS} UNION {_SHARED}), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach AS (SELECT k AS v, k AS w FROM road UNION SELECT reach.v, u.b FROM reach JOIN u ON reach.w = u.a) SELECT v, min(w) AS component FROM reach GROUP BY v")
def components_by_node_or_distance(spark, folder):
    # Ways of one brand that share a node, or of one name that lie near each other.
    roads = views.road(spark, folder)
    nodes = F.array(F.concat(F.lit("a"), F.floor(F.col("k") / 4)), F.concat(F.lit("b"), F.floor(F.col("k") / 6)))
    shared = graph.shared_edges(roads.select(F.col("k").alias("v"), "brand", F.explode(nodes).alias("node")), "brand", "node")
    return graph.components(roads.select(F.col("k").alias("v")), _near_pairs(spark, folder).unionByName(shared))


@query(views.sql("road") + f", edge(role, y1, x1, y2, x2) AS (VALUES {_ring_sql(OUTER, 'outer')}), inside AS (SELECT id FROM road JOIN edge ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY id HAVING count(*) % 2 = 1) SELECT muni, count(*) FILTER (size >= 20) AS kept, count(*) FILTER (size < 20) AS rejected FROM road WHERE id IN (SELECT id FROM inside) GROUP BY 1")
def filter_pipeline(spark, folder):
    rings = spark.createDataFrame([(1, "outer", 1, OUTER)], "polygon int, role string, ring int, points array<struct<lat: double, lon: double>>")
    roads = views.road(spark, folder)
    inside = spatial.points_in_polygons(roads.select(F.col("id").alias("point"), "lat", "lon"), rings).select(F.col("point").alias("id"))
    strict = F.col("size") >= 20
    return roads.join(inside, "id", "left_semi").groupBy("muni").agg(F.count_if(strict).alias("kept"), F.count_if(~strict).alias("rejected"))


@query(f"WITH edge(role, y1, x1, y2, x2) AS (VALUES {_ring_sql(OUTER, 'outer')}), inside AS (SELECT municipality AS name FROM municipality_bounds JOIN edge ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1 HAVING count(*) % 2 = 1) SELECT name, 'boundary' AS src FROM inside UNION ALL SELECT DISTINCT municipality, 'cache' FROM mvp_map_data WHERE municipality IS NOT NULL AND municipality NOT IN (SELECT name FROM inside)")
def municipality_dimension(spark, folder):
    rings = spark.createDataFrame([(1, "outer", 1, OUTER)], "polygon int, role string, ring int, points array<struct<lat: double, lon: double>>")
    centres = load(spark, folder, "municipality_bounds").select(F.col("municipality").alias("point"), "lat", "lon")
    own = spatial.points_in_polygons(centres, rings).select(F.col("point").alias("name"), F.lit("boundary").alias("src"))
    cached = load(spark, folder, "mvp_map_data").select(F.col("municipality").alias("name")).filter("name IS NOT NULL").distinct()
    return own.unionByName(cached.join(own, "name", "left_anti").withColumn("src", F.lit("cache")))


@query(f"""SELECT map_row, CAST(len(p) AS INTEGER) AS n_points, CAST(round(p[len(p) // 2 + 1].lat * 1e6) AS BIGINT) AS middle_e6, CAST(round(p[1].lat * 1e6) AS BIGINT) AS first_e6, CAST(round(p[len(p)].lat * 1e6) AS BIGINT) AS last_e6 FROM
(SELECT map_row, list_filter([CASE WHEN {_E} THEN struct_pack(lat := "entryLat", lon := "entryLon") END, CASE WHEN {_D} THEN struct_pack(lat := "displayLat", lon := "displayLon") END, CASE WHEN {_X} THEN struct_pack(lat := "exitLat", lon := "exitLon") END], lambda x: x IS NOT NULL) AS p FROM mvp_map_data WHERE id IN (SELECT id FROM karte)) WHERE len(p) > 1""")
def route_lines(spark, folder):
    point = lambda p: F.when(F.col(p + "Lat").isNotNull() & F.col(p + "Lon").isNotNull() & ~F.isnan(p + "Lat") & ~F.isnan(p + "Lon"), F.struct(F.col(p + "Lat").alias("lat"), F.col(p + "Lon").alias("lon")))
    ways = load(spark, folder, "mvp_map_data").join(load(spark, folder, "karte").select("id"), "id", "left_semi").select("map_row", F.array_compact(F.array(point("entry"), point("display"), point("exit"))).alias("p")).filter(F.size("p") > 1)
    micro = lambda at: F.round(F.element_at("p", at)["lat"] * 1e6).cast("long")
    return ways.select("map_row", F.size("p").alias("n_points"), micro(F.floor(F.size("p") / 2).cast("int") + 1).alias("middle_e6"), micro(1).alias("first_e6"), micro(-1).alias("last_e6"))


@query(views.sql("cand") + " SELECT id FROM (SELECT id, row_number() OVER (ORDER BY (id = 'CUS-000007') DESC, id) AS r FROM cand WHERE bal > 0) WHERE r = 1")
def selection(spark, folder):
    # The chosen row if it is in view, else the first one that is.
    return views.cand(spark, folder).filter("bal > 0").select("id").orderBy((F.col("id") == "CUS-000007").cast("int").desc(), "id").limit(1)


@query("SELECT count(*) AS visible, count(*) FILTER (bal > 5000) AS rich, count(DISTINCT region) AS regions " + "FROM (" + views.sql("cand") + " SELECT * FROM cand WHERE contains(lower(concat_ws(' ', id, name, seg, muni)), 'building'))")
def search_counts(spark, folder):
    found = views.cand(spark, folder).filter(F.contains(F.lower(F.concat_ws(" ", "id", "name", "seg", "muni")), F.lit("building")))
    return found.agg(F.count("*").alias("visible"), F.count_if(F.col("bal") > 5000).alias("rich"), F.count_distinct("region").alias("regions"))


@query(r"WITH s AS (SELECT card_row, unnest(range(1, len(sources) + 1)) AS i, sources FROM karte), f AS (SELECT card_row, sources[i].url AS u, min(i) AS p FROM s WHERE regexp_matches(sources[i].url, '[^\s\p{Z}]') GROUP BY 1, 2), a AS (SELECT card_row, count(*) AS n FROM f GROUP BY 1) SELECT k.card_row, CAST(coalesce(a.n, 0) AS INTEGER) AS sources, CAST(coalesce(len(list_filter(cautions, lambda c: c IS NOT NULL AND c <> '')), 0) + CASE WHEN coalesce(trim(access_status), '') = '' THEN 1 ELSE 0 END AS INTEGER) AS cautions FROM karte k LEFT JOIN a USING (card_row)")
def caution_lists(spark, folder):
    told = F.filter(F.coalesce("cautions", F.expr("CAST(array() AS ARRAY<STRING>)")), lambda c: c.isNotNull() & (c != ""))
    cautions = F.when(quality.is_blank(F.col("access_status")), F.concat(F.array(F.lit("通行の可否は未確認")), told)).otherwise(told)
    urls = F.array_distinct(F.array_compact(F.transform("sources", lambda s: blank_to_null(s["url"]))))
    return load(spark, folder, "karte").select("card_row", F.coalesce(F.when(F.col("sources").isNotNull(), F.size(urls)), F.lit(0)).alias("sources"), F.size(cautions).alias("cautions"))


@query("SELECT doc_id, CASE WHEN lang IN ('ja', 'en') THEN lang ELSE 'ja' END AS lang, CASE WHEN regexp_matches(site, '^[a-z-]+(\\.[a-z-]+)+$') THEN site ELSE 'all' END AS site FROM documents")
def state_parse(spark, folder):
    allowed = F.when(F.col("lang").isin("ja", "en"), F.col("lang")).otherwise("ja")
    return load(spark, folder, "documents").select("doc_id", allowed.alias("lang"), F.when(F.col("site").rlike(r"^[a-z-]+(\.[a-z-]+)+$"), F.col("site")).otherwise("all").alias("site"))


@query(r"""WITH e AS (SELECT map_row, name, unnest(regexp_extract_all("candidateSource", 'https?://[^ \t\n|]+')) AS u, regexp_matches("candidateSource", 'way [0-9]+') AS way FROM mvp_map_data), c AS (SELECT map_row, count(DISTINCT u) AS urls, bool_or(way) AS way FROM e GROUP BY 1), n AS (SELECT name, count(*) AS n FROM mvp_map_data WHERE name IS NOT NULL GROUP BY 1)
SELECT m.map_row, coalesce(c.urls, 0) AS evidence, coalesce(n.n > 1, false) AS ambiguous, CASE WHEN coalesce(c.urls, 0) = 0 OR coalesce(n.n > 1, false) THEN 'Lv0' WHEN c.urls > 1 THEN 'Lv2' ELSE 'Lv1' END AS level FROM mvp_map_data m LEFT JOIN c USING (map_row) LEFT JOIN n USING (name)""")
def registry_levels(spark, folder):
    # The whole run from stored rows to grades: addresses, ambiguous names, sums, grade.
    df = load(spark, folder, "mvp_map_data").select("map_row", "name", "candidateSource")
    found = df.select("map_row", F.explode(F.regexp_extract_all("candidateSource", F.lit(r"(https?://[^ \t\n|]+)"), F.lit(1))).alias("u")).groupBy("map_row").agg(F.count_distinct("u").alias("urls"))
    named = df.filter("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"))
    rows = df.join(found, "map_row", "left").join(named, "name", "left")
    some, ambiguous = F.coalesce("urls", F.lit(0)), F.coalesce(F.col("n") > 1, F.lit(False))
    return rows.select("map_row", some.cast("long").alias("evidence"), ambiguous.alias("ambiguous"), F.when((some == 0) | ambiguous, "Lv0").when(some > 1, "Lv2").otherwise("Lv1").alias("level"))
