"""Whole jobs: the registry after a scan, evidence from plans and texts, a report of what came out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, web
from ..functions.text import NARROW_ASCII, OTHER_BLANKS, WIDE_ASCII
from ..operators import contains, evidence, rank, registry
from ..sources.tables import load
from . import views
from .registry import Registry
from .scalar_queries import _B

query = Registry()


def _ways(spark, folder):
    """Roads as ways: two nodes each, and two ends a little apart."""
    roads = views.road(spark, folder)
    nodes = F.array(F.concat(F.lit("a"), F.floor(F.col("k") / 4)), F.concat(F.lit("b"), F.floor(F.col("k") / 6)))
    end = lambda off: F.struct((F.col("lat") + off).alias("lat"), (F.col("lon") + off).alias("lon"))
    return roads.select(F.col("k").alias("way"), F.col("brand").alias("name"), nodes.alias("nodes"), F.array(end(0.0), end(0.001)).alias("ends"), "size")


def _scan(spark, folder):
    # Every fifth way is known already, every tenth of these without its way, beside IDs that no way has.
    k = F.col("p_partkey")
    known = load(spark, folder, "part").select(F.concat(F.lit("NGN-"), F.lpad((F.floor(k / 5)).cast("string"), 6, "0")).alias("id"), F.col("p_brand").alias("name"), F.when(k % 10 == 0, None).otherwise(k).alias("way"), k.alias("k")).filter("k % 5 = 0").drop("k")
    gone = load(spark, folder, "supplier").select(F.concat(F.lit("NGN-9"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")).alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("long").alias("way"))
    return _ways(spark, folder), known.unionByName(gone), F.col("size") >= 5


@query()
def registry_job(spark, folder):
    return registry.merged(*_scan(spark, folder))


@query()
def registry_report(spark, folder):
    return registry.report(*_scan(spark, folder))


def _wide(column: str) -> str:
    narrow = NARROW_ASCII.replace("'", "''") + " " * len(OTHER_BLANKS)
    return f"translate({column}, '{WIDE_ASCII}{OTHER_BLANKS}', '{narrow}')"


@query(f"""WITH p AS (SELECT DISTINCT plan_row, {_B.format(_wide('林道名'))} AS key, unnest(regexp_split_to_array(関係市町村, '[・／/,、 |\\n]+')) AS muni FROM nagano_current_plan WHERE 林道名 IS NOT NULL), u AS (SELECT key, muni, min(plan_row) AS plan_row FROM p WHERE key <> '' AND muni <> '' GROUP BY 1, 2 HAVING count(*) = 1)
SELECT m.map_row, u.plan_row, concat_ws('|', CASE WHEN coalesce(n.工期, '') <> '' THEN '工期' END, CASE WHEN coalesce(n.総事業費千円, '') <> '' THEN '事業費' END) AS attributes, concat_ws(' | ', nullif(n.事業型, ''), nullif(n.工期, '')) AS excerpt
FROM mvp_map_data m JOIN u ON {_B.format(_wide('m.name'))} = u.key AND m.municipality = u.muni JOIN nagano_current_plan n USING (plan_row)""")
def plan_evidence(spark, folder):
    # A plan entry counts for a road if it is the only one of its name in the road's municipality.
    plan = load(spark, folder, "nagano_current_plan").filter("`林道名` IS NOT NULL")
    told = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    marks = F.array(F.when(told("工期").isNotNull(), "工期"), F.when(told("総事業費千円").isNotNull(), "事業費"))
    fields = plan.select("plan_row", evidence.evidence_row(F.lit(""), marks)["attributes"].alias("attributes"), F.concat_ws(" | ", told("事業型"), told("工期")).alias("excerpt"))
    keys = plan.select("plan_row", names.width_name(F.col("林道名"), "b").alias("key"), F.explode(F.split("関係市町村", r"[・／/,、 |\n]+")).alias("municipality")).distinct()
    single = rank.only_of(keys.filter("key <> '' AND municipality <> ''"), ["key", "municipality"])
    roads = load(spark, folder, "mvp_map_data").select("map_row", names.width_name(F.col("name"), "b").alias("key"), "municipality")
    return roads.join(single, ["key", "municipality"]).join(fields, "plan_row").select("map_row", "plan_row", F.array_join("attributes", "|").alias("attributes"), "excerpt")


@query("WITH n AS (SELECT municipality AS name, count(DISTINCT id) AS roads FROM mvp_map_data WHERE length(municipality) >= 3 GROUP BY 1) SELECT doc_id, name, CASE WHEN roads > 1 THEN 'ambiguous-same-name' ELSE 'exact-direct' END AS confidence FROM documents JOIN n ON contains(text, name)")
def text_evidence(spark, folder):
    # A name that several roads go by is kept, but marked.
    known = load(spark, folder, "mvp_map_data").select(F.col("municipality").alias("name"), "id").filter(F.length("name") >= 3).groupBy("name").agg(F.count_distinct("id").alias("roads"))
    found = contains.terms_in_texts(load(spark, folder, "documents"), "doc_id", "text", known, "name")
    return found.join(known, "name").select("doc_id", "name", F.when(F.col("roads") > 1, "ambiguous-same-name").otherwise("exact-direct").alias("confidence"))


@query("WITH d AS (SELECT doc_id, text, strpos(text, '林道') AS p FROM documents WHERE contains(text, '林道')) SELECT doc_id, regexp_matches(text, '通行|整備') AS direct, concat_ws('|', CASE WHEN regexp_matches(text, '[0-9]+(\\.[0-9]+)?km') THEN '延長' END, CASE WHEN contains(text, '標高') THEN '標高' END) AS attributes, substr(text, greatest(1, p - 120), p + 2 + 240 - greatest(1, p - 120)) AS excerpt FROM d")
def page_evidence(spark, folder):
    docs = load(spark, folder, "documents").filter(F.contains("text", F.lit("林道")))
    attributes = F.concat_ws("|", F.when(F.col("text").rlike(r"[0-9]+(\.[0-9]+)?km"), "延長"), F.when(F.contains("text", F.lit("標高")), "標高"))
    return docs.select("doc_id", F.col("text").rlike("通行|整備").alias("direct"), attributes.alias("attributes"), web.excerpt(F.col("text"), "林道", after=240).alias("excerpt"))
