"""Evidence, grades, validation and serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import web
from ..operators import contains, evidence, quality, rank, spatial
from ..sources.tables import load
from . import settings, views
from .registry import Registry

query = Registry()

_USABLE = "cls <> 'osm' AND conf <> 'ambiguous-same-name' AND url <> ''"
_SUMS = f"""SELECT cid, count(*) FILTER ({_USABLE}) AS evidence, count(*) FILTER ({_USABLE} AND direct AND cls = 'official') AS official,
 count(DISTINCT CASE WHEN {_USABLE} AND direct THEN dom END) AS domains, count(DISTINCT CASE WHEN {_USABLE} THEN eid % 3 END) AS attributes FROM ev GROUP BY 1"""
_LEVEL = "CASE WHEN NOT (coalesce(evidence, 0) > 0 AND (cid % 3 = 0 OR coalesce(official, 0) > 0)) THEN 'Lv0' WHEN cid % 3 = 0 AND attributes >= 2 AND (official >= 1 OR domains >= 2) THEN 'Lv2' ELSE 'Lv1' END"
_GRADED = views.sql("cand", "ev") + f", g AS (SELECT id, cid, region, coalesce(evidence, 0) AS evidence, coalesce(official, 0) AS official, coalesce(domains, 0) AS domains, coalesce(attributes, 0) AS attributes, {_LEVEL} AS level FROM cand LEFT JOIN ({_SUMS}) s USING (cid))"


def _graded(spark, folder):
    cands = views.cand(spark, folder).select("id", "cid", "region", (F.col("cid") % 3 == 0).alias("placed"))
    return evidence.graded(cands, views.ev(spark, folder).withColumn("attribute", F.col("eid") % 3), "cid")


@query(_GRADED + " SELECT id, evidence, official, domains, attributes, level FROM g")
def classify_levels(spark, folder):
    return _graded(spark, folder).select("id", "evidence", "official", "domains", "attributes", "level")


@query(_GRADED + " SELECT level, region, count(*) AS n, round(count(*) / (SELECT count(*) FROM g), 6) AS share FROM g GROUP BY 1, 2")
def level_report(spark, folder):
    graded = _graded(spark, folder)
    total = graded.agg(F.count("*").alias("total"))
    return graded.groupBy("level", "region").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("level", "region", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query(views.sql("ev") + " SELECT eid, url, cls FROM ev WHERE cls <> 'osm' UNION ALL SELECT eid, url || u, 'osm' FROM ev, (VALUES ('#a'), ('#b')) t(u) WHERE cls = 'osm'")
def evidence_baseline(spark, folder):
    ev = views.ev(spark, folder).select("eid", "url", "cls")
    own = ev.filter("cls = 'osm'").withColumn("url", F.explode(F.array(F.concat("url", F.lit("#a")), F.concat("url", F.lit("#b")))))
    return ev.filter("cls <> 'osm'").unionByName(own)


@query(views.sql("road") + " SELECT id, CASE WHEN count(*) OVER (PARTITION BY muni, name) > 1 THEN 'ambiguous-same-name' ELSE 'exact-direct' END AS confidence FROM road")
def ambiguity_flag(spark, folder):
    return evidence.ambiguous(views.road(spark, folder).select("id", "muni", "name"), "name", ["muni"]).select("id", "confidence")


@query("SELECT doc_id, w AS name FROM (SELECT doc_id, regexp_replace(text, '[ \\n]', '', 'g') AS t FROM documents), (VALUES ('林道'), ('地図上'), ('通行の可否')) v(w) WHERE CASE WHEN length(w) < 4 THEN contains(t, w) AND regexp_matches(t, '整備|通行') ELSE contains(t, w) END")
def occurrence_rule(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", F.regexp_replace("text", r"[ \n]", "").alias("t")).withColumn("name", F.explode(F.array(*map(F.lit, ("林道", "地図上", "通行の可否")))))
    return docs.filter(evidence.occurs(F.col("t"), F.col("name"), F.col("name"), F.col("t").rlike("整備|通行"))).select("doc_id", "name")


@query(r"WITH d AS (SELECT doc_id, text, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE url IS NOT NULL AND text IS NOT NULL) SELECT doc_id FROM d WHERE NOT regexp_matches(h, '" + settings.BOARD_HOSTS + r"') AND contains(text, '林道') AND (n = 1 OR regexp_matches(text, '[市町村]の'))")
def hit_acceptance(spark, folder):
    docs = load(spark, folder, "documents").filter("url IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", web.host(F.col("url")).alias("h")).withColumn("digest", F.sha2("text", 256))
    copies = docs.groupBy("digest").agg(F.count("*").alias("n"))
    kept = docs.filter(~F.col("h").rlike(settings.BOARD_HOSTS) & F.contains("text", F.lit("林道"))).join(copies, "digest")
    return kept.filter((F.col("n") == 1) | F.col("text").rlike("[市町村]の")).select("doc_id")


@query(views.sql("ev") + ", f AS (SELECT cid, cls || '/' || conf AS a, min(eid) AS p FROM ev GROUP BY 1, 2) SELECT cid, string_agg(a, '|' ORDER BY p) AS attributes FROM f GROUP BY 1")
def attribute_union(spark, folder):
    df = views.ev(spark, folder).select("cid", "eid", F.concat_ws("/", "cls", "conf").alias("a"))
    firsts = df.groupBy("cid", "a").agg(F.min("eid").alias("p"))
    return firsts.groupBy("cid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "a"))), lambda x: x["a"]), "|").alias("attributes"))


@query(views.sql("cand", "ev") + " SELECT cand.id, CAST(CASE WHEN bal > 5000 THEN 4 ELSE 0 END + CASE WHEN coalesce(n, 0) >= 5 THEN 3 ELSE 0 END + CASE WHEN seg = 'BUILDING' THEN 2 ELSE 0 END - CASE WHEN bal < 0 THEN 5 ELSE 0 END AS INTEGER) AS score FROM cand LEFT JOIN (SELECT cid, count(*) AS n FROM ev WHERE direct GROUP BY 1) USING (cid)")
def additive_score(spark, folder):
    direct = views.ev(spark, folder).filter("direct").groupBy("cid").agg(F.count("*").alias("n"))
    rules = {"rich": (F.col("bal") > 5000, 4), "proven": (F.coalesce("n", F.lit(0)) >= 5, 3), "segment": (F.col("seg") == "BUILDING", 2), "debt": (F.col("bal") < 0, -5)}
    return views.cand(spark, folder).join(direct, "cid", "left").select("id", evidence.weighted(rules).alias("score"))


@query(views.sql("cand") + " SELECT id, CASE WHEN bal < 0 THEN '保留' WHEN bal >= 9000 THEN 'A' WHEN bal >= 7000 THEN 'B' WHEN seg = 'BUILDING' THEN 'C' ELSE 'D' END AS priority FROM cand")
def priority_case(spark, folder):
    ladder = F.when(F.col("bal") < 0, "保留").when(F.col("bal") >= 9000, "A").when(F.col("bal") >= 7000, "B").when(F.col("seg") == "BUILDING", "C").otherwise("D")
    return views.cand(spark, folder).select("id", ladder.alias("priority"))


@query(views.sql("cand") + " SELECT id, CASE WHEN bal > 5000 OR seg = 'BUILDING' THEN concat_ws('。', CASE WHEN bal > 5000 THEN '残高あり' END, CASE WHEN seg = 'BUILDING' THEN '建設' END) || '。' ELSE '' END AS reason FROM cand")
def reason_text(spark, folder):
    return views.cand(spark, folder).select("id", evidence.sentences(F.when(F.col("bal") > 5000, F.lit("残高あり")), F.when(F.col("seg") == "BUILDING", F.lit("建設"))).alias("reason"))


@query("SELECT DISTINCT m AS municipality FROM (SELECT unnest(regexp_split_to_array(関係市町村, '[・／/,、 |\\n]+')) AS m FROM nagano_current_plan p WHERE EXISTS (SELECT 1 FROM mvp_map_data d WHERE d.name = p.林道名)) WHERE m <> '' AND m NOT IN (" + settings.quoted(settings.KNOWN_PLACES) + ")")
def worklist(spark, folder):
    matched = load(spark, folder, "nagano_current_plan").select(F.col("林道名").alias("name"), F.col("関係市町村").alias("m")).join(load(spark, folder, "mvp_map_data").select("name").distinct(), "name", "left_semi")
    return matched.select(F.explode(F.split("m", r"[・／/,、 |\n]+")).alias("municipality")).filter((F.col("municipality") != "") & ~F.col("municipality").isin(*settings.KNOWN_PLACES)).distinct()


@query(views.sql("cand") + """ SELECT id, n, first_price, concat_ws('/', region, seg) AS label FROM cand LEFT JOIN (SELECT o_custkey AS cid, count(*) AS n, min(o_totalprice) AS first_price FROM orders GROUP BY 1) USING (cid)""")
def nested_struct(spark, folder):
    sums = load(spark, folder, "orders").groupBy(F.col("o_custkey").alias("cid")).agg(F.struct(F.count("*").alias("n"), F.min("o_totalprice").alias("first_price")).alias("orders"))
    nested = views.cand(spark, folder).join(sums, "cid", "left").select("id", F.struct("orders", F.struct("region", "seg").alias("place")).alias("record"))
    return nested.select("id", "record.orders.n", "record.orders.first_price", F.concat_ws("/", "record.place.region", "record.place.seg").alias("label"))


@query("SELECT m.map_row, CASE WHEN k.id IS NOT NULL THEN k.surface_summary ELSE m.surfaceSummary END AS surface, CASE WHEN k.id IS NOT NULL THEN k.confidence ELSE m.confidence END AS confidence FROM mvp_map_data m LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, card_row DESC) AS r FROM karte WHERE id IS NOT NULL) WHERE r = 1) k ON m.id = k.id")
def overlay_join(spark, folder):
    cards = rank.last_by(load(spark, folder, "karte").filter("id IS NOT NULL").select("id", F.col("surface_summary").alias("s"), F.col("confidence").alias("c"), "loaded_at", "card_row"), ["id"], F.col("loaded_at"), F.col("card_row")).select("id", "s", "c", F.lit(True).alias("found"))
    df = load(spark, folder, "mvp_map_data").select("map_row", "id", "surfaceSummary", "confidence").join(cards, "id", "left")
    return df.select("map_row", F.when(F.col("found"), F.col("s")).otherwise(F.col("surfaceSummary")).alias("surface"), F.when(F.col("found"), F.col("c")).otherwise(F.col("confidence")).alias("confidence"))


@query("SELECT m.map_row, coalesce(e.n, 0) AS deliveries, coalesce(k.n, 0) AS cards, CASE WHEN e.n > 0 AND k.n > 0 THEN 'detailed' WHEN e.n > 0 OR k.n > 0 THEN 'partial' ELSE 'listed' END AS tier FROM mvp_map_data m LEFT JOIN (SELECT roadId AS id, count(*) AS n FROM nagano_entrances WHERE roadId IS NOT NULL GROUP BY 1) e ON m.id = e.id LEFT JOIN (SELECT id, count(*) AS n FROM karte WHERE id IS NOT NULL GROUP BY 1) k ON m.id = k.id")
def enrich_roads(spark, folder):
    entrances = load(spark, folder, "nagano_entrances").groupBy(F.col("roadId").alias("id")).agg(F.count("*").alias("deliveries"))
    cards = load(spark, folder, "karte").groupBy("id").agg(F.count("*").alias("cards"))
    df = load(spark, folder, "mvp_map_data").select("map_row", "id").join(entrances, "id", "left").join(cards, "id", "left").fillna(0, ["deliveries", "cards"])
    some, both = (F.col("deliveries") > 0) | (F.col("cards") > 0), (F.col("deliveries") > 0) & (F.col("cards") > 0)
    return df.select("map_row", "deliveries", "cards", F.when(both, "detailed").when(some, "partial").otherwise("listed").alias("tier"))


@query("SELECT doc_id, municipality, region_name FROM documents JOIN municipality_bounds ON contains(text, municipality)")
def contains_join(spark, folder):
    places = load(spark, folder, "municipality_bounds").select("municipality", "region_name")
    found = contains.terms_in_texts(load(spark, folder, "documents"), "doc_id", "text", places, "municipality")
    return found.join(places, "municipality").select("doc_id", "municipality", "region_name")


@query("SELECT 'blank name' AS rule, CAST(card_row AS VARCHAR) AS key FROM karte WHERE coalesce(trim(name), '') = '' UNION ALL SELECT 'blank exit', CAST(card_row AS VARCHAR) FROM karte WHERE coalesce(trim(exit_or_terminus), '') = ''")
def dq_not_empty(spark, folder):
    return quality.violated(load(spark, folder, "karte"), "card_row", {"blank name": quality.is_blank(F.col("name")), "blank exit": quality.is_blank(F.col("exit_or_terminus"))})


@query("SELECT 'ID form' AS rule, CAST(cand_row AS VARCHAR) AS key FROM suwa_chino_candidates WHERE NOT coalesce(regexp_matches(ID, '^[A-Z]{3}-[0-9]{6}$'), false)")
def dq_regex(spark, folder):
    return quality.violated(load(spark, folder, "suwa_chino_candidates"), "cand_row", {"ID form": ~F.coalesce(F.col("ID").rlike("^[A-Z]{3}-[0-9]{6}$"), F.lit(False))})


@query("SELECT 'ID repeated' AS rule, ID AS key FROM suwa_chino_candidates GROUP BY ID HAVING count(*) > 1")
def dq_unique(spark, folder):
    return quality.repeated(load(spark, folder, "suwa_chino_candidates"), "ID", "ID repeated")


_BLANK = "coalesce(trim({0}), '') = ''"
_LAT, _LON = _BLANK.format("出口緯度"), _BLANK.format("出口経度")


@query(f"WITH l AS (SELECT loc_row, 出口緯度, 出口経度, TRY_CAST(出口緯度 AS DOUBLE) AS y, TRY_CAST(出口経度 AS DOUBLE) AS x FROM suwa_chino_locations) SELECT 'coordinate alone' AS rule, CAST(loc_row AS VARCHAR) AS key FROM l WHERE ({_LAT}) <> ({_LON}) UNION ALL SELECT 'coordinate not a number', CAST(loc_row AS VARCHAR) FROM l WHERE (NOT ({_LAT}) AND y IS NULL) OR (NOT ({_LON}) AND x IS NULL) UNION ALL SELECT 'coordinate out of range', CAST(loc_row AS VARCHAR) FROM l WHERE y NOT BETWEEN 20 AND 50 OR x NOT BETWEEN 120 AND 155")
def dq_coordinates(spark, folder):
    return quality.violated(load(spark, folder, "suwa_chino_locations"), "loc_row", quality.bad_coordinates(F.col("出口緯度"), F.col("出口経度")))


@query("SELECT 'way without position' AS rule, CAST(map_row AS VARCHAR) AS key FROM mvp_map_data WHERE regexp_matches(coalesce(positionSource, ''), 'way [0-9]+') AND (displayLat IS NULL OR displayLon IS NULL OR isnan(displayLat) OR isnan(displayLon))")
def dq_implication(spark, folder):
    way = F.coalesce(F.col("positionSource"), F.lit("")).rlike("way [0-9]+")
    absent = F.col("displayLat").isNull() | F.col("displayLon").isNull() | F.isnan("displayLat") | F.isnan("displayLon")
    return quality.violated(load(spark, folder, "mvp_map_data"), "map_row", {"way without position": way & absent})


@query("SELECT after, before FROM (SELECT n AS after, lead(n) OVER (ORDER BY n) AS before FROM (SELECT DISTINCT CAST(split_part(ID, '-', 2) AS BIGINT) AS n FROM suwa_chino_candidates WHERE regexp_matches(ID, '^NGN-[0-9]{6}$'))) WHERE before - after > 1")
def dq_gaps(spark, folder):
    numbers = load(spark, folder, "suwa_chino_candidates").filter(F.col("ID").rlike("^NGN-[0-9]{6}$")).select(F.split_part(F.col("ID"), F.lit("-"), F.lit(2)).cast("long").alias("n"))
    return spatial.runs(numbers, "n")


@query(_GRADED + " SELECT 'Lv2 without position' AS rule, CAST(cid AS VARCHAR) AS key FROM g WHERE level = 'Lv2' AND cid % 6 <> 0 UNION ALL SELECT 'Lv1 without evidence', CAST(cid AS VARCHAR) FROM g WHERE level = 'Lv1' AND evidence < 2")
def dq_promotion(spark, folder):
    rules = {"Lv2 without position": (F.col("level") == "Lv2") & (F.col("cid") % 6 != 0), "Lv1 without evidence": (F.col("level") == "Lv1") & (F.col("evidence") < 2)}
    return quality.violated(_graded(spark, folder), "cid", rules)


@query("SELECT event_type, count(*) AS counted, (SELECT count(*) FROM events WHERE event_type = e.event_type AND value > 0) AS positive FROM events e GROUP BY 1 HAVING count(*) <> (SELECT count(*) FROM events WHERE event_type = e.event_type AND value > 0)")
def dq_reconcile(spark, folder):
    return load(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("counted"), F.count_if(F.col("value") > 0).alias("positive")).filter("counted <> positive")


@query("SELECT 'entrance ids repeat' AS rule, CAST(record_no AS VARCHAR) AS key FROM nagano_entrances WHERE len(list_filter(list_transform(entrances, lambda e: e.id), lambda x: x IS NOT NULL)) <> len(list_distinct(list_transform(entrances, lambda e: e.id))) UNION ALL SELECT 'unknown status', CAST(record_no AS VARCHAR) FROM nagano_entrances WHERE len(list_filter(entrances, lambda e: e.status NOT IN ('verified', 'estimated'))) > 0")
def dq_nested(spark, folder):
    ids = F.filter(F.transform("entrances", lambda e: e["id"]), lambda x: x.isNotNull())
    rules = {"entrance ids repeat": F.size(ids) != F.size(F.array_distinct(ids)), "unknown status": F.exists("entrances", lambda e: ~e["status"].isin("verified", "estimated"))}
    return quality.violated(load(spark, folder, "nagano_entrances"), "record_no", rules)


@query("SELECT 'unknown road' AS rule, CAST(record_no AS VARCHAR) AS key FROM nagano_entrances WHERE roadId IS NOT NULL AND roadId NOT IN (SELECT id FROM mvp_map_data WHERE id IS NOT NULL) UNION ALL SELECT 'address scheme', CAST(doc_id AS VARCHAR) FROM documents WHERE NOT regexp_matches(url, '^https://')")
def fk_violations(spark, folder):
    unknown = quality.missing(load(spark, folder, "nagano_entrances"), "roadId", "record_no", load(spark, folder, "mvp_map_data"), "id", "unknown road")
    schemes = quality.violated(load(spark, folder, "documents"), "doc_id", {"address scheme": ~F.col("url").rlike("^https://")})
    return quality.all_of(unknown, schemes)
