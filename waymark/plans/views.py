"""Views of the tables that the reference queries run on, each for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load

SQL = {
    "road": """road AS (SELECT 'PRT-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS id, p_partkey AS k, p_name AS name, p_type AS ptype, p_brand AS brand, p_size AS size,
 35.15 + ((p_partkey * 7919) % 195000) / 1e5 AS lat, 137.25 + ((p_partkey * 104729) % 165000) / 1e5 AS lon, n_name AS muni, r_name AS region
 FROM part JOIN nation ON p_partkey % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "box": "box AS (SELECT municipality AS name, region_name, boundingbox[1] AS south, boundingbox[2] AS north, boundingbox[3] AS west, boundingbox[4] AS east FROM municipality_bounds)",
    "cand": """cand AS (SELECT 'CUS-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS id, c_custkey AS cid, c_name AS name, c_mktsegment AS seg, c_acctbal AS bal, n_name AS muni, r_name AS region
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "ev": """ev AS (SELECT o_custkey AS cid, o_orderkey AS eid, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'official' WHEN o_orderpriority = '5-LOW' THEN 'osm' ELSE 'public-web' END AS cls,
 CASE WHEN o_orderstatus = 'P' THEN 'ambiguous-same-name' ELSE 'exact' END AS conf, 'd' || CAST(o_orderkey % 7 AS VARCHAR) AS dom, o_orderkey % 3 <> 0 AS direct,
 'https://d' || CAST(o_orderkey % 7 AS VARCHAR) || '.example/' || CAST(o_orderkey AS VARCHAR) AS url, o_orderdate AS ts, o_totalprice AS price FROM orders)""",
}


def sql(*names: str) -> str:
    """A WITH clause of the named views."""
    return "WITH " + ", ".join(SQL[n] for n in names)


def road(spark: SparkSession, folder: str) -> DataFrame:
    """Roads: an ID, a name that several share, a position, a municipality and its region."""
    k = F.col("p_partkey")
    part = load(spark, folder, "part").withColumn("n_nationkey", (k % 25).cast("int"))
    places = load(spark, folder, "nation").join(F.broadcast(load(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    df = part.join(F.broadcast(places.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", "r_name")), "n_nationkey")
    return df.select(
        F.concat(F.lit("PRT-"), F.lpad(k.cast("string"), 6, "0")).alias("id"), k.alias("k"), F.col("p_name").alias("name"), F.col("p_type").alias("ptype"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"),
        (F.lit(35.15) + (k * 7919) % 195000 / F.lit(1e5)).alias("lat"), (F.lit(137.25) + (k * 104729) % 165000 / F.lit(1e5)).alias("lon"), F.col("n_name").alias("muni"), F.col("r_name").alias("region"),
    )


def box(spark: SparkSession, folder: str) -> DataFrame:
    """Bounding boxes of municipalities."""
    b = lambda k: F.get("boundingbox", F.lit(k))
    return load(spark, folder, "municipality_bounds").select(F.col("municipality").alias("name"), "region_name", b(0).alias("south"), b(1).alias("north"), b(2).alias("west"), b(3).alias("east"))


def cand(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with municipality and region."""
    places = load(spark, folder, "nation").join(F.broadcast(load(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    df = load(spark, folder, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.select(F.concat(F.lit("CUS-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("id"), F.col("c_custkey").alias("cid"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"), F.col("n_name").alias("muni"), F.col("r_name").alias("region"))


def ev(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence on candidates: its class, confidence, host and whether it is direct."""
    p, k = F.col("o_orderpriority"), F.col("o_orderkey")
    dom = F.concat(F.lit("d"), (k % 7).cast("string"))
    cls = F.when(p.isin("1-URGENT", "2-HIGH"), "official").when(p == "5-LOW", "osm").otherwise("public-web")
    conf = F.when(F.col("o_orderstatus") == "P", "ambiguous-same-name").otherwise("exact")
    return load(spark, folder, "orders").select(F.col("o_custkey").alias("cid"), k.alias("eid"), cls.alias("cls"), conf.alias("conf"), dom.alias("dom"), (k % 3 != 0).alias("direct"), F.concat(F.lit("https://"), dom, F.lit(".example/"), k.cast("string")).alias("url"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"))
