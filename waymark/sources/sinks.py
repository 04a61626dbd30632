"""Sinks: CSV for spreadsheets, JSON, lines of routes, versions of a table and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rank import last_by, numbered


def write_csv(df: DataFrame, path: str, columns: list[str], mark: bool = True) -> None:
    """CSV files with ``columns`` in this order, others left out; ``mark`` puts a byte order mark before the header.

    Arrays are joined by `` | `` and nulls are empty. The header's first name carries the mark, so it stands first in each
    part file and no file has to be rewritten.
    """
    kinds = dict(df.dtypes)
    text = [(F.array_join(c, " | ") if kinds[c].startswith("array<string") else F.col(f"`{c}`").cast("string")).alias(("﻿" if mark and k == 0 else "") + c) for k, c in enumerate(columns)]
    df.select(*text).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def features(lines: DataFrame, columns: list[str]) -> DataFrame:
    """A column ``feature`` of route lines with ``points`` (lat, lon); lines of fewer than two points are left out."""
    coordinates = F.transform("points", lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    return lines.filter(F.size("points") > 1).select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*columns).alias("properties"), geometry.alias("geometry"))).alias("feature"))


def write_version(df: DataFrame, folder: str, version: str) -> str:
    """Write a new version of a table beside the old ones, then point to it; a table may be made from its last version."""
    path = f"{folder}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{folder}/current")
    return path


def read_version(spark: SparkSession, folder: str) -> DataFrame:
    """The version of a table that was pointed to last."""
    version = spark.read.schema("version string").json(f"{folder}/current").first().version
    return spark.read.parquet(f"{folder}/version={version}")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` and ``new``, of each key those of ``new`` if it has any; within one side the last by ``seq``."""
    both = old.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    return last_by(both, keys, F.col("__side"), F.col("seq")).drop("__side")


def objects(df: DataFrame, *order: Column) -> DataFrame:
    """``(position, object)``: each row as a JSON object, numbered in ``order`` over all partitions; nulls are written."""
    rows = numbered(df, *order, name="position")
    return rows.select("position", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("object"))


def write_document(df: DataFrame, path: str, *order: Column) -> None:
    """One JSON array in ``path``, for small exports: its rows in ``order``, an object a line."""
    lines = objects(df, *order).withColumn("n", F.max("position").over(Window.partitionBy()))
    sign = lambda at, text: F.when(at, F.lit(text)).otherwise(F.lit(""))
    text = F.concat(sign(F.col("position") == 1, "[\n"), F.col("object"), sign(F.col("position") < F.col("n"), ","), sign(F.col("position") == F.col("n"), "\n]"))
    lines.coalesce(1).sortWithinPartitions("position").select(text.alias("value")).write.mode("overwrite").text(path)


def with_errors_kept(cache: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The cache with fresh answers, errors among them, so a key is asked for once; fresh answers win."""
    return fresh.unionByName(cache.join(fresh.select(key), key, "left_anti"))
