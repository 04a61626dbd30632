"""Queries of the problems on texts (p3, p4, p6, p8, p9, p10) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from . import copies, linkage, lookalikes, mixing, packing, stuffed


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """``(src, row_no, name)`` of the three tables with names."""
    tables = (("suwa_chino_candidates", "cand_row", "林道名"), ("nagano_current_plan", "plan_row", "林道名"), ("mvp_map_data", "map_row", "name"))
    parts = [load(spark, folder, t).select(F.lit(t).alias("src"), F.col(row).alias("row_no"), F.col(name).alias("name")) for t, row, name in tables]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_links(spark, folder).select("plan_row", "map_row")


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    plan = load(spark, folder, "nagano_current_plan").select("plan_row", F.col("林道名").alias("name"), F.col("関係市町村").alias("municipalities"))
    mapped = load(spark, folder, "mvp_map_data").select("map_row", F.col("id").alias("road"), "name", "municipality", F.col("candidateSource").alias("source"))
    return linkage.link(plan, mapped)


def p4_names(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.in_one_form(_names(spark, folder), "name").select("src", "row_no", "name", "canonical")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.in_one_form(_names(spark, folder), "name").filter("name <> canonical").select("src", "row_no")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [copies.copies(load(spark, folder, t), layout).select(F.lit(t).alias("src"), "first_row", "copy_row") for t, layout in (("suwa_chino_candidates", copies.CANDIDATES), ("nagano_current_plan", copies.PLAN))]
    return parts[0].unionByName(parts[1])


def p6_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return copies.collapsed(load(spark, folder, "suwa_chino_candidates"), copies.CANDIDATES)


def p6_plan(spark: SparkSession, folder: str) -> DataFrame:
    return copies.collapsed(load(spark, folder, "nagano_current_plan"), copies.PLAN)


def p8_packs(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(load(spark, folder, "documents"), load(spark, folder, "pack_sizes"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_report(p8_packs(spark, folder))


def p9_uses(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.uses(load(spark, folder, "documents"), load(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(p9_uses(spark, folder))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(p9_uses(spark, folder), load(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed.stuffed_pages(load(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_links, p4_found, p4_names, p6_found, p6_candidates, p6_plan, p8_packs, p8_report, p9_uses, p9_mix, p9_shares, p10_found)}
ORACLES: dict[str, str] = {}
