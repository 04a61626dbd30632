"""The report on a register whose roads of one name lie close together."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as waymark
from waymark.operators import registry
from waymark.plans import job_queries

ROADS = 3000


def shuffled(spark) -> int:
    """Bytes that the session has written for shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    return context.statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.fixture
def dense(spark, tmp_path) -> str:
    part = spark.range(ROADS).select(F.col("id").alias("p_partkey"), F.lit("road").alias("p_name"), F.lit("type").alias("p_type"), F.lit("Brand#1").alias("p_brand"), (F.col("id") % 10).cast("int").alias("p_size"))
    tables = {
        "part": part,
        "supplier": spark.range(1, 4).select(F.col("id").alias("s_suppkey"), F.lit("gone").alias("s_name")),
        "nation": spark.range(25).select(F.col("id").alias("n_nationkey"), F.lit("place").alias("n_name"), F.lit(0).alias("n_regionkey")),
        "region": spark.createDataFrame([(0, "region")], "r_regionkey int, r_name string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_few_edges_and_all_ways(spark, dense):
    ways = job_queries._ways(spark, dense).filter("size >= 5")
    assert registry.way_edges(ways, registry.Rules().join_m).count() <= 5 * ROADS
    got = {r["origin"]: r for r in waymark.queries()["q_registry_report"](spark, dense).collect()}
    assert got["matched"]["n_ways"] + (got["new"]["n_ways"] if "new" in got else 0) == ROADS // 2
    # Each fifth road gives an ID, beside the three of no road.
    assert got["matched"]["n"] + got["unmatched"]["n"] == ROADS // 5 + 3
    job = waymark.queries()["q_registry_job"](spark, dense).groupBy("origin").agg(F.count("*").alias("n"), F.sum("n_ways").alias("n_ways"))
    assert rows(job) == sorted((tuple(r) for r in got.values()), key=repr)


def test_little_is_shuffled(spark, dense):
    before = shuffled(spark)
    assert waymark.queries()["q_registry_report"](spark, dense).count() >= 2
    assert shuffled(spark) - before <= 300 * ROADS
