"""Filters, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, web
from ..functions.geo import great_circle_m
from ..functions.text import NARROW_ASCII, OTHER_BLANKS, WIDE_ASCII
from ..operators import contains
from ..sources.tables import load
from . import settings, views
from .registry import Registry

query = Registry()

NEEDLES = ("通行止", "林道情報", "loop")


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, source)), '通行止') OR contains(lower(concat_ws(' ', text, source)), '林道情報') OR contains(lower(concat_ws(' ', text, source)), 'loop')")
def filter_keyword(spark, folder):
    text = F.lower(F.concat_ws(" ", "text", "source"))
    found = F.lit(False)
    for needle in NEEDLES:
        found = found | F.contains(text, F.lit(needle))
    return load(spark, folder, "documents").filter(found).select("doc_id")


def _reasons():
    """Tags whose condition holds, in a fixed order."""
    tags = {"metal": F.col("ptype").rlike("BRASS|STEEL|COPPER|TIN|NICKEL"), "large": F.col("size") >= 40, "north": F.col("lat") > 36.5, "first brands": F.col("brand").rlike("#1"), "mid": F.col("size").between(20, 30), "east": F.col("lon") > 138.0}
    return F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in tags.items()]), lambda x: x.isNotNull())


_REASONS = "list_filter([CASE WHEN regexp_matches(ptype, 'BRASS|STEEL|COPPER|TIN|NICKEL') THEN 'metal' END, CASE WHEN size >= 40 THEN 'large' END, CASE WHEN lat > 36.5 THEN 'north' END, CASE WHEN regexp_matches(brand, '#1') THEN 'first brands' END, CASE WHEN size BETWEEN 20 AND 30 THEN 'mid' END, CASE WHEN lon > 138.0 THEN 'east' END], lambda x: x IS NOT NULL)"


@query(views.sql("road") + f" SELECT id, array_to_string({_REASONS}, '／') AS reasons FROM road")
def reason_tags(spark, folder):
    return views.road(spark, folder).select("id", F.array_join(_reasons(), "／").alias("reasons"))


@query(views.sql("road") + f" SELECT id FROM road WHERE regexp_matches(ptype, 'PROMO') OR list_contains({_REASONS}, 'large') OR (NOT regexp_matches(ptype, 'SMALL|ECONOMY') AND (list_contains({_REASONS}, 'mid') OR list_contains({_REASONS}, 'north')))")
def strict_candidate(spark, folder):
    df = views.road(spark, folder).withColumn("reasons", _reasons())
    named, rejected = F.col("ptype").rlike("PROMO") | F.array_contains("reasons", "large"), F.col("ptype").rlike("SMALL|ECONOMY")
    return df.filter(F.when(named, True).when(rejected, False).otherwise(F.arrays_overlap("reasons", F.array(F.lit("mid"), F.lit("north"))))).select("id")


_HOST = r"lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


@query(f"SELECT doc_id, CASE WHEN regexp_matches({_HOST.format('url')}, '{settings.OFFICIAL_HOSTS}') THEN 'official' ELSE 'public-web' END AS cls FROM documents WHERE url IS NOT NULL")
def url_class(spark, folder):
    official = web.host(F.col("url")).rlike(settings.OFFICIAL_HOSTS)
    return load(spark, folder, "documents").filter("url IS NOT NULL").select("doc_id", F.when(official, "official").otherwise("public-web").alias("cls"))


@query(f"SELECT {_HOST.format('url')} AS host, count(*) AS n FROM documents WHERE url IS NOT NULL AND {_HOST.format('url')} <> '' GROUP BY 1")
def host_extract(spark, folder):
    return load(spark, folder, "documents").select(web.host(F.col("url")).alias("host")).filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"))


@query(r"SELECT map_row, u AS url, i AS pos FROM (SELECT map_row, unnest(l) AS u, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS i FROM (SELECT map_row, regexp_extract_all(candidateSource, 'https?://[^ \t\n|]+') AS l FROM mvp_map_data))")
def urls_in(spark, folder):
    found = web.addresses(F.col("candidateSource"))
    return load(spark, folder, "mvp_map_data").select("map_row", F.posexplode(found).alias("pos", "url")).withColumn("pos", F.col("pos") + 1)


@query(r"SELECT DISTINCT doc_id, regexp_replace(u, '#.*$', '') AS url FROM (SELECT doc_id, unnest(regexp_extract_all(text, '<a [^>]*?href=" + '"([^"]+)"' + r"', 1)) AS u FROM documents)")
def html_links(spark, folder):
    return load(spark, folder, "documents").select("doc_id", F.explode(web.links(F.col("text"))).alias("url")).select("doc_id", web.without_fragment(F.col("url")).alias("url")).distinct()


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS visible FROM documents WHERE contains(text, '<a ')")
def strip_tags(spark, folder):
    return load(spark, folder, "documents").filter(F.contains("text", F.lit("<a "))).select("doc_id", web.strip_tags(F.col("text"), unescape=False).alias("visible"))


@query(r"""SELECT url, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'href="([^"]+)"', 1)) AS url FROM documents) GROUP BY url HAVING count(*) > 1""")
def html_ids(spark, folder):
    found = F.regexp_extract_all("text", F.lit('href="([^"]+)"'), F.lit(1))
    return load(spark, folder, "documents").select(F.explode(found).alias("url")).groupBy("url").agg(F.count("*").alias("n")).filter("n > 1")


_FOLDED = f"translate(林道名, '{WIDE_ASCII}{OTHER_BLANKS}', '{NARROW_ASCII.replace(chr(39), chr(39) * 2)}{' ' * len(OTHER_BLANKS)}')"
_A = "regexp_replace(regexp_replace(replace(replace(replace(replace(trim({0}), '林道', ''), '澤', '沢'), 'ヶ', 'ケ'), 'ヵ', 'カ'), '[ \\t\\n\\r\\f\\x0B・･]', '', 'g'), '線$', '')"
_B = "regexp_replace(regexp_replace(replace(replace(replace(replace(trim({0}), '林道', ''), '澤', '沢'), 'ヶ', 'ケ'), 'ヵ', 'カ'), '[ \\t\\n\\r\\f\\x0B・･·]', '', 'g'), '線$', '')"
_C = "regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(trim({0}), '林道', ''), '線', ''), '支', ''), '澤', '沢'), 'ヶ', 'ケ'), 'ガ', 'カ'), '[ \\t\\n\\r\\f\\x0B・･]', '', 'g'), '[0-9]+号$', '')"
_D = "replace(replace(replace(replace(replace({0}, '林道', ''), '澤', '沢'), 'ヶ', 'ケ'), 'ガ', 'カ'), ' ', '')"


@query("SELECT cand_row, " + ", ".join(f"{sql.format(_FOLDED)} AS variant_{v}" for v, sql in zip("abcd", (_A, _B, _C, _D), strict=True)) + " FROM suwa_chino_candidates")
def normalize_name(spark, folder):
    return load(spark, folder, "suwa_chino_candidates").select("cand_row", *[names.width_name(F.col("林道名"), v).alias(f"variant_{v}") for v in names.VARIANTS])


@query()
def normalize_name_nfkc(spark, folder):
    return load(spark, folder, "suwa_chino_candidates").select("cand_row", *[names.normal_name(F.col("林道名"), v).alias(f"variant_{v}") for v in names.VARIANTS])


@query(r"SELECT plan_row, CASE WHEN ends_with(t, '線') THEN substr(t, 3, length(t) - 3) ELSE substr(t, 3) END AS stem, ends_with(t, '線') AS others FROM (SELECT plan_row, regexp_replace(林道名, '[ \t\n\r\f\x0B]', '', 'g') AS t FROM nagano_current_plan) WHERE starts_with(t, '林道')")
def prefix_suffix_parse(spark, folder):
    parsed = names.stem_and_flag(F.col("林道名"), "林道", "線")
    return load(spark, folder, "nagano_current_plan").select("plan_row", parsed.alias("p")).filter("p IS NOT NULL").select("plan_row", "p.stem", "p.others")


@query(r"SELECT doc_id, length(regexp_replace(replace(replace(text, 'ヶ', 'ケ'), '澤', '沢'), '[ \t\n\r]', '', 'g')) AS n FROM documents")
def compact_text(spark, folder):
    compact = F.regexp_replace(F.replace(F.replace("text", F.lit("ヶ"), F.lit("ケ")), F.lit("澤"), F.lit("沢")), r"[ \t\n\r]", "")
    return load(spark, folder, "documents").select("doc_id", F.length(compact).cast("long").alias("n"))


@query(r"SELECT plan_row, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(関係市町村, '[・／/,、 \t\n]+'), lambda x: x <> ''))), '|') AS municipalities FROM nagano_current_plan")
def split_set(spark, folder):
    parts = F.filter(F.split("関係市町村", r"[・／/,、 \t\n]+"), lambda x: x != "")
    return load(spark, folder, "nagano_current_plan").select("plan_row", F.array_join(F.array_sort(F.array_distinct(parts)), "|").alias("municipalities"))


_COORDINATES = {"表示緯度": "display_lat", "表示経度": "display_lon", "入口緯度": "entry_lat", "入口経度": "entry_lon", "出口緯度": "exit_lat", "出口経度": "exit_lon"}


@query("SELECT loc_row, " + ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {n}" for c, n in _COORDINATES.items()) + ", CAST(" + " + ".join(f"CASE WHEN {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL THEN 1 ELSE 0 END" for c in _COORDINATES) + " AS INTEGER) AS unusable FROM suwa_chino_locations")
def try_cast(spark, folder):
    numbers = [F.col(c).try_cast("double") for c in _COORDINATES]
    unusable = sum(((F.col(c).isNotNull() & n.isNull()).cast("int") for c, n in zip(_COORDINATES, numbers, strict=True)), F.lit(0))
    return load(spark, folder, "suwa_chino_locations").select("loc_row", *[n.alias(name) for n, name in zip(numbers, _COORDINATES.values(), strict=True)], unusable.alias("unusable"))


@query("SELECT o_orderkey, 'NGN-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS id, CAST(split_part('NGN-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0'), '-', 2) AS INTEGER) = o_orderkey AS same FROM orders")
def id_format(spark, folder):
    df = load(spark, folder, "orders").select("o_orderkey", F.concat(F.lit("NGN-"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0")).alias("id"))
    return df.withColumn("same", F.split_part("id", F.lit("-"), F.lit(2)).cast("int") == F.col("o_orderkey"))


@query(views.sql("road") + " SELECT id, 'osm:' || name || ':' || CAST(CAST(floor(lat * 1000 + 0.5) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(lon * 1000 + 0.5) AS BIGINT) AS VARCHAR) AS key FROM road")
def candidate_key(spark, folder):
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("string")
    return views.road(spark, folder).select("id", F.concat_ws(":", F.lit("osm"), "name", milli("lat"), milli("lon")).alias("key"))


def _distance(lat: str, lon: str) -> str:
    return f"2 * 6371000 * atan2(sqrt(pow(sin(radians({lat} - 36.0) / 2), 2) + cos(radians(36.0)) * cos(radians({lat})) * pow(sin(radians({lon} - 138.0) / 2), 2)), sqrt(1 - (pow(sin(radians({lat} - 36.0) / 2), 2) + cos(radians(36.0)) * cos(radians({lat})) * pow(sin(radians({lon} - 138.0) / 2), 2))))"


@query(views.sql("road") + f" SELECT id, CAST(round({_distance('lat', 'lon')}) AS BIGINT) AS metres FROM road")
def haversine(spark, folder):
    return views.road(spark, folder).select("id", F.round(great_circle_m(F.lit(36.0), F.lit(138.0), F.col("lat"), F.col("lon"))).cast("long").alias("metres"))


@query(views.sql("road") + f" SELECT id, CASE WHEN m < 1000 THEN CAST(CAST(floor(m / 10 + 0.5) AS BIGINT) * 10 AS VARCHAR) || ' m' WHEN m < 10000 THEN CAST(CAST(floor(m / 100 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor(m / 100 + 0.5) AS BIGINT) % 10 AS VARCHAR) || ' km' ELSE CAST(CAST(floor(m / 1000 + 0.5) AS BIGINT) AS VARCHAR) || ' km' END AS label FROM (SELECT id, {_distance('lat', 'lon')} AS m FROM road)")
def format_distance(spark, folder):
    m = great_circle_m(F.lit(36.0), F.lit(138.0), F.col("lat"), F.col("lon"))
    units = lambda size: F.floor(F.col("m") / size + 0.5).cast("long")
    near = F.concat((units(10) * 10).cast("string"), F.lit(" m"))
    tenths = F.concat(F.floor(units(100) / 10).cast("string"), F.lit("."), (units(100) % 10).cast("string"), F.lit(" km"))
    far = F.concat(units(1000).cast("string"), F.lit(" km"))
    return views.road(spark, folder).select("id", m.alias("m")).select("id", F.when(F.col("m") < 1000, near).when(F.col("m") < 10000, tenths).otherwise(far).alias("label"))


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first_value, CAST(embedding[len(embedding) // 2 + 1] AS DOUBLE) AS middle, CAST(embedding[len(embedding)] AS DOUBLE) AS last_value FROM embeddings")
def array_endpoints(spark, folder):
    at = lambda k: F.try_element_at("embedding", k).cast("double")
    return load(spark, folder, "embeddings").select("vec_id", at(F.lit(1)).alias("first_value"), at((F.size("embedding") / 2).cast("int") + 1).alias("middle"), at(F.lit(-1)).alias("last_value"))


@query(views.sql("road") + " SELECT id, CASE WHEN size >= 40 OR regexp_matches(ptype, 'STEEL') THEN '強' WHEN size >= 20 THEN '中' ELSE 'なし' END AS signal, concat_ws(', ', CASE WHEN size >= 40 THEN 'size' END, CASE WHEN regexp_matches(ptype, 'STEEL') THEN 'type' END) AS detail FROM road")
def signal_case(spark, folder):
    large, steel = F.col("size") >= 40, F.col("ptype").rlike("STEEL")
    signal = F.when(large | steel, "強").when(F.col("size") >= 20, "中").otherwise("なし")
    return views.road(spark, folder).select("id", signal.alias("signal"), F.concat_ws(", ", F.when(large, "size"), F.when(steel, "type")).alias("detail"))


_REGION_SQL = " ".join(f"WHEN list_has_any(s, [{settings.quoted(places)}]) THEN '{region}'" for region, places in settings.REGIONS.items())


@query(f"SELECT plan_row, CASE WHEN 関係市町村 IS NULL OR trim(関係市町村) = '' THEN '{settings.NO_REGION}' {_REGION_SQL} ELSE '{settings.OTHER_REGION}' END AS region FROM (SELECT plan_row, 関係市町村, list_transform(regexp_split_to_array(関係市町村, '[・／/,、 |\\n]+'), lambda x: regexp_replace(x, '[市町村]$', '')) AS s FROM nagano_current_plan)")
def region_overlap(spark, folder):
    cell = F.col("関係市町村")
    keys = F.transform(F.split(cell, r"[・／/,、 |\n]+"), lambda x: F.regexp_replace(x, "[市町村]$", ""))
    region = F.when(F.col("plain").isNull() | (F.trim("plain") == ""), settings.NO_REGION)
    for name, places in settings.REGIONS.items():
        region = region.when(F.arrays_overlap("s", F.array(*map(F.lit, places))), name)
    return load(spark, folder, "nagano_current_plan").select("plan_row", cell.alias("plain"), keys.alias("s")).select("plan_row", region.otherwise(settings.OTHER_REGION).alias("region"))


@query(views.sql("road") + " SELECT id, CASE WHEN lat >= 36.5 THEN '北信' WHEN lon >= 138.3 THEN '東信' WHEN lat >= 36.0 THEN '中信' ELSE '南信' END AS region FROM road")
def region_threshold(spark, folder):
    region = F.when(F.col("lat") >= 36.5, "北信").when(F.col("lon") >= 138.3, "東信").when(F.col("lat") >= 36.0, "中信").otherwise("南信")
    return views.road(spark, folder).select("id", region.alias("region"))


@query(r"SELECT DISTINCT cand_row, regexp_replace(v, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS alias FROM (SELECT cand_row, unnest([林道名, b, regexp_replace(regexp_replace(b, '^林道', ''), '線$', '')]) AS v FROM (SELECT cand_row, 林道名, regexp_replace(林道名, '[（(][^（）()]*[）)]', '', 'g') AS b FROM suwa_chino_candidates)) WHERE regexp_matches(v, '[^\s\p{Z}]')")
def name_variants(spark, folder):
    return load(spark, folder, "suwa_chino_candidates").select("cand_row", F.explode(names.aliases(F.col("林道名"))).alias("alias"))


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part) SELECT name, word, CAST(CASE WHEN name = word THEN 100 WHEN contains(name, word) THEN 80 ELSE 60 END AS INTEGER) AS score, CAST(length(word) AS INTEGER) AS len FROM n JOIN w ON name = word OR contains(name, word) OR contains(word, name)")
def name_score(spark, folder):
    # Words are found in names by an automaton, one pass over the names.
    distinct = load(spark, folder, "part").select(F.col("p_name").alias("name")).distinct()
    words = distinct.select(F.split_part("name", F.lit(" "), F.lit(1)).alias("word")).distinct()
    pairs = contains.terms_in_texts(distinct.select("name", F.col("name").alias("text")), "name", "text", words, "word")
    return pairs.select("name", "word", names.name_likeness(F.col("name"), F.col("word")).alias("score"), F.length("word").alias("len"))


@query(r"SELECT doc_id, concat_ws('|', CASE WHEN regexp_matches(text, '[0-9]+(\.[0-9]+)?km') THEN '延長' END, CASE WHEN regexp_matches(text, '幅員|幅は') THEN '幅員' END, CASE WHEN regexp_matches(text, '標高[0-9]+m') THEN '標高' END, CASE WHEN regexp_matches(text, '通行止|閉鎖') THEN '規制' END) AS attributes FROM documents")
def regex_attributes(spark, folder):
    patterns = {"延長": r"[0-9]+(\.[0-9]+)?km", "幅員": "幅員|幅は", "標高": "標高[0-9]+m", "規制": "通行止|閉鎖"}
    return load(spark, folder, "documents").select("doc_id", F.concat_ws("|", *[F.when(F.col("text").rlike(p), a) for a, p in patterns.items()]).alias("attributes"))


@query("SELECT doc_id, substr(text, greatest(1, p - 120), p + 2 + 160 - greatest(1, p - 120)) AS excerpt FROM (SELECT doc_id, text, strpos(text, '林道') AS p FROM documents) WHERE p > 0")
def excerpt(spark, folder):
    return load(spark, folder, "documents").select("doc_id", web.excerpt(F.col("text"), "林道").alias("excerpt")).filter("excerpt IS NOT NULL")


@query(r"SELECT plan_row, CAST(list_sum(list_transform(regexp_extract_all(資料ページ, '[0-9]+'), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS total, CAST(len(list_filter(regexp_split_to_array(資料ページ, '/'), lambda x: regexp_matches(x, '^[0-9]+$'))) AS BIGINT) AS plain_numbers FROM nagano_current_plan")
def int_list(spark, folder):
    every = F.transform(F.regexp_extract_all("資料ページ", F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("long"))
    plain = F.filter(F.split("資料ページ", "/"), lambda x: x.rlike("^[0-9]+$"))
    total = F.when(F.size(every) > 0, F.aggregate(every, F.lit(0).cast("long"), lambda a, x: a + x))
    return load(spark, folder, "nagano_current_plan").select("plan_row", total.alias("total"), F.size(plain).cast("long").alias("plain_numbers"))


@query("SELECT doc_id, sha256(url) AS key FROM documents WHERE url IS NOT NULL")
def url_key(spark, folder):
    return load(spark, folder, "documents").filter("url IS NOT NULL").select("doc_id", F.sha2("url", 256).alias("key"))


@query(views.sql("cand") + " SELECT id FROM cand WHERE region = 'ASIA' AND bal >= 5000")
def view_filter(spark, folder):
    return views.cand(spark, folder).filter("region = 'ASIA' AND bal >= 5000").select("id")


@query(views.sql("cand") + " SELECT id FROM cand WHERE contains(lower(concat_ws(' ', id, name, seg, muni)), 'machinery')")
def text_search(spark, folder):
    return views.cand(spark, folder).filter(F.contains(F.lower(F.concat_ws(" ", "id", "name", "seg", "muni")), F.lit("machinery"))).select("id")


@query(views.sql("ev") + " SELECT eid, cls AS 種別, CASE WHEN direct THEN 'はい' ELSE 'いいえ' END AS 直接確認, concat_ws(' | ', cls, conf, dom) AS 属性 FROM ev")
def encode_projection(spark, folder):
    return views.ev(spark, folder).select("eid", F.col("cls").alias("種別"), F.when(F.col("direct"), "はい").otherwise("いいえ").alias("直接確認"), F.array_join(F.array("cls", "conf", "dom"), " | ").alias("属性"))


@query("SELECT map_row, coalesce(nullif(trim(summary), ''), nullif(trim(surfaceSummary), ''), '未確認') AS summary, coalesce(nullif(trim(confidence), ''), 'unknown') AS confidence FROM mvp_map_data")
def coalesce_merge(spark, folder):
    told = lambda c: F.nullif(F.trim(c), F.lit(""))
    return load(spark, folder, "mvp_map_data").select("map_row", F.coalesce(told("summary"), told("surfaceSummary"), F.lit("未確認")).alias("summary"), F.coalesce(told("confidence"), F.lit("unknown")).alias("confidence"))


@query("SELECT event_id, date_trunc('day', CAST(ts AS TIMESTAMP)) AS day, strftime(CAST(ts AS TIMESTAMP), '%Y/%m/%d %H:%M') AS label FROM events")
def local_datetime(spark, folder):
    return load(spark, folder, "events").select("event_id", F.date_trunc("day", "ts").alias("day"), F.date_format("ts", "yyyy/MM/dd HH:mm").alias("label"))
