"""Aggregations, ranking, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rank
from ..sources.tables import load
from . import views
from .registry import Registry

query = Registry()


@query(views.sql("road") + " SELECT name, (r - 1) // 100 AS page, count(*) AS n, min(k) AS lowest, max(k) AS highest, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS members FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k) AS r FROM road) GROUP BY 1, 2")
def group_collect(spark, folder):
    pages = rank.paged(views.road(spark, folder), ["name"], "k", 100)
    at = lambda k: F.element_at("values", k)
    return pages.select("name", "page", F.size("values").cast("long").alias("n"), at(1).alias("lowest"), at(-1).alias("highest"), F.array_join(F.transform("values", lambda k: k.cast("string")), ",").alias("members"))


@query("""WITH f AS (SELECT 関係市町村 AS m, 事業型 AS v, min(plan_row) AS pos FROM nagano_current_plan WHERE coalesce(事業型, '') <> '' GROUP BY ALL)
SELECT g.m AS municipalities, coalesce((SELECT string_agg(v, ' | ' ORDER BY pos) FROM f WHERE f.m = g.m), '') AS kinds, g.others FROM (SELECT 関係市町村 AS m, coalesce(bool_or(ほか表記 = 'あり'), false) AS others FROM nagano_current_plan WHERE 関係市町村 IS NOT NULL GROUP BY 1) g""")
def group_ordered_distinct(spark, folder):
    df = load(spark, folder, "nagano_current_plan").filter("`関係市町村` IS NOT NULL").select(F.col("関係市町村").alias("municipalities"), F.col("事業型").alias("kind"), F.col("ほか表記").alias("o"), "plan_row")
    kinds = rank.ordered_distinct("kind", "plan_row")
    return df.groupBy("municipalities").agg(F.array_join(kinds, " | ").alias("kinds"), F.coalesce(F.bool_or(F.col("o") == "あり"), F.lit(False)).alias("others"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by(spark, folder):
    return load(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT suppkey, l_returnflag, n FROM (SELECT l_suppkey AS suppkey, l_returnflag, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, min(l_orderkey), l_returnflag) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1""")
def mode_first(spark, folder):
    df = load(spark, folder, "lineitem").select(F.col("l_suppkey").alias("suppkey"), "l_returnflag", "l_orderkey")
    return rank.mode_first(df, ["suppkey"], "l_returnflag", "l_orderkey")


@query(views.sql("road") + " SELECT name, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM road GROUP BY name")
def centroid(spark, folder):
    return views.road(spark, folder).groupBy("name").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_totalprice > 200000) AS large, count(*) FILTER (o_orderkey <= 144) AS first_cohort FROM orders GROUP BY 1")
def conditional_counts(spark, folder):
    count = lambda condition, name: F.count_if(F.expr(condition)).alias(name)
    return load(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), count("o_orderstatus = 'F'", "finished"), count("o_orderstatus = 'P'", "pending"), count("o_totalprice > 200000", "large"), count("o_orderkey <= 144", "first_cohort"))


@query(views.sql("ev") + " SELECT cid % 4 AS cohort, count(*) FILTER (cls = 'official') AS official, count(*) FILTER (cls = 'public-web') AS public_web, count(*) FILTER (cls = 'osm') AS osm FROM ev GROUP BY 1")
def cohort_pivot(spark, folder):
    df = views.ev(spark, folder).select((F.col("cid") % 4).alias("cohort"), "cls")
    return df.groupBy("cohort").pivot("cls", ["official", "public-web", "osm"]).agg(F.count(F.lit(1))).withColumnRenamed("public-web", "public_web").fillna(0)


@query(views.sql("ev") + " SELECT cid, count(DISTINCT dom) AS domains FROM ev GROUP BY 1")
def count_distinct_domain(spark, folder):
    return views.ev(spark, folder).groupBy("cid").agg(F.count_distinct("dom").alias("domains"))


@query(views.sql("ev") + " SELECT cid, bool_or(direct) AS any_direct, bool_and(direct) AS all_direct, max(eid) AS last_id FROM ev GROUP BY 1")
def bool_aggs(spark, folder):
    return views.ev(spark, folder).groupBy("cid").agg(F.bool_or("direct").alias("any_direct"), F.bool_and("direct").alias("all_direct"), F.max("eid").alias("last_id"))


@query("SELECT user_id, CASE max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END) WHEN 3 THEN '強' WHEN 2 THEN '中' ELSE '未確認' END AS severity FROM events GROUP BY 1")
def severity_fold(spark, folder):
    level = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)
    top = load(spark, folder, "events").groupBy("user_id").agg(F.max(level).alias("level"))
    return top.select("user_id", F.when(F.col("level") == 3, "強").when(F.col("level") == 2, "中").otherwise("未確認").alias("severity"))


@query("SELECT classification, count(*) AS records, CAST(sum(coalesce(len(entrances), 0)) AS BIGINT) AS entrances, count(*) FILTER (coalesce(len(entrances), 0) = 0) AS unmapped FROM nagano_entrances GROUP BY 1")
def summary_counts(spark, folder):
    n = F.coalesce(F.when(F.col("entrances").isNotNull(), F.size("entrances")), F.lit(0))
    return load(spark, folder, "nagano_entrances").groupBy("classification").agg(F.count("*").alias("records"), F.sum(n).alias("entrances"), F.count_if(n == 0).alias("unmapped"))


@query(views.sql("road") + " SELECT region, round(min(lat), 6) AS south, round(max(lat), 6) AS north, round(min(lon), 6) AS west, round(max(lon), 6) AS east FROM road GROUP BY 1")
def bbox_agg(spark, folder):
    side = lambda f, c, name: F.round(f(c), 6).alias(name)
    return views.road(spark, folder).groupBy("region").agg(side(F.min, "lat", "south"), side(F.max, "lat", "north"), side(F.min, "lon", "west"), side(F.max, "lon", "east"))


@query(views.sql("ev") + " SELECT cid, eid, price FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY (cls = 'official') DESC, direct DESC, price DESC, eid) AS r FROM ev) WHERE r = 1")
def best_of_group(spark, folder):
    official = (F.col("cls") == "official").cast("int")
    return rank.first_by(views.ev(spark, folder), ["cid"], -official, -F.col("direct").cast("int"), -F.col("price"), F.col("eid")).select("cid", "eid", "price")


@query(views.sql("ev") + " SELECT cid, url FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY (cls = 'official') DESC, direct DESC, url) AS r FROM ev) WHERE r = 1")
def preferred_source(spark, folder):
    official = (F.col("cls") == "official").cast("int")
    return rank.first_by(views.ev(spark, folder), ["cid"], -official, -F.col("direct").cast("int"), F.col("url")).select("cid", "url")


_TOP = """, s AS (SELECT id, region, row_number() OVER (PARTITION BY region ORDER BY bal DESC, id) AS r, bal FROM cand), t AS (SELECT id, region, bal FROM s WHERE r <= 6 ORDER BY bal DESC, id LIMIT 16)"""


def _shortlist(spark, folder):
    return rank.top_per_group(views.cand(spark, folder).select("id", "region", "bal"), "region", 6, 16, F.desc("bal"), F.asc("id"))


@query(views.sql("cand") + _TOP + " SELECT id, region, CAST(row_number() OVER (ORDER BY bal DESC, id) AS INTEGER) AS position FROM t")
def topk_group_cap(spark, folder):
    return _shortlist(spark, folder).select("id", "region", "position")


@query(views.sql("cand") + _TOP + " SELECT id FROM cand WHERE bal > 9000 AND id NOT IN (SELECT id FROM t)")
def reserve_anti(spark, folder):
    return views.cand(spark, folder).filter("bal > 9000").join(F.broadcast(_shortlist(spark, folder)), "id", "left_anti").select("id")


@query("""SELECT name, other FROM (SELECT a.name, b.name AS other, row_number() OVER (PARTITION BY a.name ORDER BY length(b.name) DESC, b.name) AS r FROM (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS w FROM part) a JOIN (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS w FROM part) b ON a.w = b.w AND a.name <> b.name) WHERE r = 1""")
def best_name_match(spark, folder):
    distinct = load(spark, folder, "part").select(F.col("p_name").alias("name"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w")).distinct()
    # The order doesn't depend on who asks, so the best two of a word answer all of its names.
    best = rank.best_two(distinct, "w", F.struct(-F.length("name"), F.col("name")), "name")
    return distinct.join(best, "w").select("name", F.when(F.col("name") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("other")).filter("other IS NOT NULL")


@query(views.sql("road") + " SELECT k, 'NGN-' || lpad(CAST((SELECT max(k) FROM road) + row_number() OVER (ORDER BY name, lat, lon, k) AS VARCHAR), 6, '0') AS id FROM road WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = k AND l_quantity > 45)")
def mint_ids(spark, folder):
    roads = views.road(spark, folder)
    highest = roads.agg(F.max("k")).first()[0] or 0
    # New are the roads that another table doesn't know.
    known = load(spark, folder, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k")).distinct()
    return rank.minted(roads.select("k", "name", "lat", "lon").join(known, "k", "left_anti"), highest, "NGN", F.col("name"), F.col("lat"), F.col("lon"), F.col("k")).select("k", "id")


@query("SELECT cid, eid FROM (SELECT o_custkey AS cid, o_orderkey AS eid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_match(spark, folder):
    df = load(spark, folder, "orders").select(F.col("o_custkey").alias("cid"), F.col("o_orderkey").alias("eid"), F.col("o_orderdate").alias("at"))
    return rank.first_by(df, ["cid"], F.col("at"), F.col("eid")).select("cid", "eid")


@query(views.sql("ev") + " SELECT cid, dom, eid FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY eid) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY cid, dom ORDER BY eid) AS r FROM ev) WHERE r = 1) WHERE r2 <= 3")
def topk_distinct_host(spark, folder):
    per_host = rank.first_by(views.ev(spark, folder), ["cid", "dom"], F.col("eid"))
    w = Window.partitionBy("cid").orderBy("eid")
    return per_host.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("cid", "dom", "eid")


@query(views.sql("cand") + " SELECT id FROM cand ORDER BY id LIMIT 20 OFFSET 10")
def offset_limit(spark, folder):
    return views.cand(spark, folder).select("id").orderBy("id").offset(10).limit(20)


@query(views.sql("cand", "ev") + " SELECT cand.id, coalesce(e.n, 0) AS n, e.last_id FROM cand LEFT JOIN (SELECT cid, count(*) AS n, max(eid) AS last_id FROM ev WHERE cls = 'official' GROUP BY 1) e USING (cid)")
def left_join_dim(spark, folder):
    official = views.ev(spark, folder).filter("cls = 'official'").groupBy("cid").agg(F.count("*").alias("n"), F.max("eid").alias("last_id"))
    return views.cand(spark, folder).join(official, "cid", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "last_id")


_NAME = "upper(replace({0}, ' ', ''))"


@query(views.sql("road") + f" SELECT a.name, a.muni, count(*) AS pairs FROM road a JOIN (SELECT DISTINCT {_NAME.format('name')} AS key, brand FROM road) b ON {_NAME.format('a.name')} = b.key GROUP BY 1, 2")
def join_normalized(spark, folder):
    key = F.upper(F.replace("name", F.lit(" "), F.lit("")))
    roads = views.road(spark, folder).withColumn("key", key)
    return roads.select("key", "name", "muni").join(roads.select("key", "brand").distinct(), "key").groupBy("name", "muni").agg(F.count("*").alias("pairs"))


@query(views.sql("road") + " SELECT a.id, b.brand AS other FROM (SELECT id, name, muni FROM road WHERE size < 10) a JOIN (SELECT name, muni, min(brand) AS brand, count(*) AS n FROM road WHERE size >= 10 GROUP BY 1, 2) b ON a.name = b.name AND a.muni = b.muni AND b.n = 1")
def unique_match_join(spark, folder):
    roads = views.road(spark, folder)
    single = rank.only_of(roads.filter("size >= 10").select("name", "muni", F.col("brand").alias("other")), ["name", "muni"])
    return roads.filter("size < 10").select("id", "name", "muni").join(single, ["name", "muni"]).select("id", "other")


@query("SELECT plan_row, region_name FROM (SELECT DISTINCT plan_row, unnest(regexp_split_to_array(関係市町村, '[・／/,、 |\\n]+')) AS m FROM nagano_current_plan) JOIN municipality_bounds ON m = municipality")
def explode_join(spark, folder):
    parts = load(spark, folder, "nagano_current_plan").select("plan_row", F.explode(F.split("関係市町村", r"[・／/,、 |\n]+")).alias("municipality")).distinct()
    return parts.join(load(spark, folder, "municipality_bounds").select("municipality", "region_name"), "municipality").select("plan_row", "region_name")


@query("WITH s AS (SELECT plan_row, 林道名 AS name, list_filter(regexp_split_to_array(関係市町村, '[・／/,、 |\\n]+'), lambda x: x <> '') AS m FROM nagano_current_plan) SELECT a.plan_row AS first_row, b.plan_row AS second_row FROM s a JOIN s b ON a.name = b.name AND a.plan_row < b.plan_row AND list_has_any(a.m, b.m)")
def overlap_join(spark, folder):
    s = load(spark, folder, "nagano_current_plan").select("plan_row", F.col("林道名").alias("name"), F.filter(F.split("関係市町村", r"[・／/,、 |\n]+"), lambda x: x != "").alias("m"))
    # Rows meet per name and municipality, not per name alone; a pair that shares several counts once.
    s = s.select("plan_row", "name", F.explode(F.array_distinct("m")).alias("m"))
    pairs = s.withColumnRenamed("plan_row", "first_row").join(s.withColumnRenamed("plan_row", "second_row"), ["name", "m"])
    return pairs.filter("first_row < second_row").select("first_row", "second_row").distinct()


@query(views.sql("road") + """, p AS (SELECT id, name, muni FROM road WHERE size <= 25), t AS (SELECT k, name, muni FROM road WHERE size > 25), r AS (SELECT p.id, t.k FROM p JOIN t ON p.name = t.name AND p.muni = t.muni),
f AS (SELECT p.id, t.k FROM p JOIN t ON p.name = t.name WHERE length(p.name) >= 4 AND p.id NOT IN (SELECT id FROM r)), u AS (SELECT * FROM r UNION ALL SELECT * FROM f) SELECT id, min(k) AS k FROM u GROUP BY id HAVING count(*) = 1""")
def fallback_unique_join(spark, folder):
    roads = views.road(spark, folder)
    probe, other = roads.filter("size <= 25").select("id", "name", "muni"), roads.filter("size > 25").select("k", "name", "muni")
    # Partners are counted per key before they meet, so a hot name forms no pairs.
    regional = probe.join(rank.counted_of(other, ["name", "muni"], "k"), ["name", "muni"], "left")
    found = regional.filter("n = 1").select("id", "k")
    rest = regional.filter("n IS NULL AND length(name) >= 4").select("id", "name").join(rank.only_of(other.select("k", "name"), ["name"]), "name").select("id", "k")
    return found.unionByName(rest)


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM mix_targets m WHERE m.source = d.source AND m.max_repeats > 1)")
def semi_join(spark, folder):
    return load(spark, folder, "documents").join(load(spark, folder, "mix_targets").filter("max_repeats > 1"), "source", "left_semi").select("doc_id")


@query("SELECT loc_row FROM suwa_chino_locations l WHERE ID IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mvp_map_data m WHERE m.id = l.ID)")
def anti_join(spark, folder):
    known = load(spark, folder, "mvp_map_data").select(F.col("id").alias("ID")).distinct()
    return load(spark, folder, "suwa_chino_locations").filter("ID IS NOT NULL").join(known, "ID", "left_anti").select("loc_row")


@query(views.sql("cand") + " SELECT id, CAST(coalesce(len(l), 0) AS INTEGER) AS n, coalesce(array_to_string(l, ','), '') AS orders FROM cand LEFT JOIN (SELECT o_custkey AS cid, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS l FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) USING (cid)")
def collect_join(spark, folder):
    children = load(spark, folder, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("cid")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    df = views.cand(spark, folder).join(children, "cid", "left").withColumn("l", F.coalesce("l", F.expr("CAST(array() AS ARRAY<BIGINT>)")))
    return df.select("id", F.size("l").alias("n"), F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("orders"))


@query("SELECT coalesce(a.id, b.ID) AS id, CASE WHEN a.id IS NULL THEN 'location' WHEN b.ID IS NULL THEN 'map' ELSE 'both' END AS found FROM (SELECT DISTINCT id FROM mvp_map_data WHERE id IS NOT NULL) a FULL JOIN (SELECT DISTINCT ID FROM suwa_chino_locations WHERE ID IS NOT NULL) b ON a.id = b.ID")
def full_outer_merge(spark, folder):
    a = load(spark, folder, "mvp_map_data").filter("id IS NOT NULL").select(F.col("id").alias("key"), F.lit(True).alias("a")).distinct()
    b = load(spark, folder, "suwa_chino_locations").filter("ID IS NOT NULL").select(F.col("ID").alias("key"), F.lit(True).alias("b")).distinct()
    return a.join(b, "key", "full").select(F.col("key").alias("id"), F.when(F.col("a").isNull(), "location").when(F.col("b").isNull(), "map").otherwise("both").alias("found"))


@query(views.sql("cand") + " SELECT id, row_number() OVER (ORDER BY bal DESC, region, id) AS position FROM cand")
def sort_multi(spark, folder):
    return rank.numbered(views.cand(spark, folder), F.desc("bal"), F.asc("region"), F.asc("id")).select("id", "position")


@query("SELECT id AS name FROM mvp_map_data UNION ALL SELECT ID FROM suwa_chino_locations")
def union_all(spark, folder):
    return load(spark, folder, "mvp_map_data").select(F.col("id").alias("name")).unionByName(load(spark, folder, "suwa_chino_locations").select(F.col("ID").alias("name")))


@query("SELECT id, src FROM (SELECT id, src, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM (SELECT DISTINCT id, 'map' AS src, 1 AS p FROM mvp_map_data UNION ALL SELECT DISTINCT ID, 'location', 2 FROM suwa_chino_locations) WHERE id IS NOT NULL) WHERE r = 1")
def union_distinct(spark, folder):
    a = load(spark, folder, "mvp_map_data").select("id", F.lit("map").alias("src"), F.lit(1).alias("p"))
    b = load(spark, folder, "suwa_chino_locations").select(F.col("ID").alias("id"), F.lit("location").alias("src"), F.lit(2).alias("p"))
    return rank.first_by(a.unionByName(b).filter("id IS NOT NULL"), ["id"], F.col("p")).select("id", "src")


@query("SELECT DISTINCT site, lang, source FROM documents")
def distinct_rows(spark, folder):
    return load(spark, folder, "documents").select("site", "lang", "source").distinct()


@query("SELECT id FROM mvp_map_data INTERSECT SELECT ID FROM suwa_chino_locations")
def intersect(spark, folder):
    return load(spark, folder, "mvp_map_data").select("id").intersect(load(spark, folder, "suwa_chino_locations").select("ID"))


@query('SELECT id FROM mvp_map_data EXCEPT SELECT ID FROM suwa_chino_locations')
def except_(spark, folder):
    return load(spark, folder, "mvp_map_data").select("id").subtract(load(spark, folder, "suwa_chino_locations").select("ID"))


@query("SELECT name, src FROM (SELECT n_name AS name, 'nation' AS src FROM nation UNION ALL SELECT municipality, 'bounds' FROM municipality_bounds WHERE municipality NOT IN (SELECT n_name FROM nation))")
def union_precedence(spark, folder):
    own = load(spark, folder, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("src"))
    other = load(spark, folder, "municipality_bounds").select(F.col("municipality").alias("name"), F.lit("bounds").alias("src"))
    return own.unionByName(other.join(own, "name", "left_anti"))


@query(views.sql("ev") + " SELECT cls, count(*) AS n FROM (SELECT cls FROM ev WHERE cls <> 'osm' UNION ALL SELECT 'osm' FROM ev WHERE direct) GROUP BY 1")
def replace_partition(spark, folder):
    ev = views.ev(spark, folder)
    recomputed = ev.filter("direct").select(F.lit("osm").alias("cls"))
    return ev.filter("cls <> 'osm'").select("cls").unionByName(recomputed).groupBy("cls").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_last_wins(spark, folder):
    return rank.last_by(load(spark, folder, "events"), ["user_id", "event_type"], F.col("ts"), F.col("event_id")).select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, folder):
    return rank.last_by(load(spark, folder, "events"), ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id", "value")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def key_delete(spark, folder):
    latest = rank.last_by(load(spark, folder, "events"), ["user_id"], F.col("ts"), F.col("event_id"))
    return latest.filter("event_type <> 'error'").select("user_id", "event_id")
