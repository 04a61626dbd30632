"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; only the columns a plan uses are read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_all(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """All named tables; one that is missing is an error before anything runs."""
    return {name: load(spark, folder, name) for name in names}
