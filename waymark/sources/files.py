"""Sources other than Parquet tables: CSV with a byte order mark, JSON envelopes and maps, lines of routes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import trim_blanks


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-text CSV with a header; a byte order mark, quoted line breaks and doubled quotes are fine.

    Columns are matched by the header's names: missing ones are null, others are left out.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    return raw.select(*[(F.col(f"`{names[c]}`") if c in names else F.lit(None)).cast("string").alias(c) for c in columns])


def first_of(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The first file by name that matches a glob pattern; null for none."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return min((str(f.getPath()) for f in found), default=None) if found else None


def read_envelope(spark: SparkSession, path: str, element: str, name: str = "elements") -> DataFrame:
    """Rows of the array ``name`` of JSON documents, one document per file; ``element`` is the type of a row.

    A file that isn't JSON, such as an error page, yields no rows.
    """
    documents = spark.read.text(path, wholetext=True)
    parsed = documents.select(F.from_json("value", f"struct<`{name}`: array<{element}>>", {"mode": "PERMISSIVE"}).alias("d"))
    return parsed.select(F.inline(F.col("d").getField(name)))


def read_map(spark: SparkSession, path: str, value: str, name: str, key: str = "key") -> DataFrame:
    """Rows of an object ``name`` that maps keys to values of type ``value``."""
    documents = spark.read.text(path, wholetext=True)
    parsed = documents.select(F.from_json("value", f"struct<`{name}`: map<string, {value}>>").alias("d"))
    return parsed.select(F.explode(F.col("d").getField(name)).alias(key, "value")).select(key, "value.*")


def read_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a collection with lines: ``properties`` as columns and ``points`` as (lat, lon)."""
    feature = f"struct<type: string, properties: struct<{properties}>, geometry: struct<type: string, coordinates: array<array<double>>>>"
    rows = read_envelope(spark, path, feature, "features").filter("geometry.type = 'LineString'")
    points = F.transform("geometry.coordinates", lambda c: F.struct(F.get(c, F.lit(1)).alias("lat"), F.get(c, F.lit(0)).alias("lon")))
    return rows.select("properties.*", points.alias("points"))


def optional(read, spark: SparkSession, schema: StructType | list[str]) -> DataFrame:
    """What ``read()`` gives; an empty frame of ``schema`` where its path doesn't exist. Other faults stay faults."""
    if isinstance(schema, list):
        schema = StructType([StructField(c, StringType()) for c in schema])
    try:
        return read()
    except AnalysisException as fault:
        if "PATH_NOT_FOUND" not in str(fault.getCondition() if hasattr(fault, "getCondition") else fault):
            raise
        return spark.createDataFrame([], schema)


def table_rows(pages: DataFrame, key: str = "key", skip: int = 2, least: int = 10) -> DataFrame:
    """Rows of extracted tables, an array of cells each, with the header rows of each page left out.

    ``pages`` has ``page`` and ``cells`` (array of arrays of texts), as any document reader may deliver them; the first
    page is a cover. ``key`` is the position of the cell that names the row.
    """
    rows = pages.filter("page > 1").select("page", F.posexplode("cells").alias("pos", "row"))
    return rows.filter((F.col("pos") >= skip) & (F.size("row") >= least)).select("page", (F.col("pos") - skip + 1).alias(key), F.transform("row", lambda c: F.regexp_replace(c, r"(?U)\s+", "")).alias("row"))


def anchored(rows: DataFrame, pattern: str, offsets: dict[str, int]) -> DataFrame:
    """Cells at fixed offsets from the first cell of ``row`` that matches ``pattern``, whose column may float."""
    hits = rows.withColumn("__at", F.get(F.filter(F.transform("row", lambda c, i: F.when(c.rlike(pattern), i)), lambda i: i.isNotNull()), F.lit(0))).filter("__at IS NOT NULL")
    return hits.select("*", *[F.get("row", F.col("__at") + offset).alias(name) for name, offset in offsets.items()]).drop("__at", "row")


def new_only(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Keys still to be fetched: those wanted that the cache lacks, so an interrupted fetch goes on where it was."""
    return wanted.join(cached.select(key), key, "left_anti")


def first_rows(df: DataFrame, position: str, n: int) -> DataFrame:
    """The first ``n`` rows in the order of a file, given by its column ``position``; the limit is the feature."""
    return df.orderBy(position).limit(n)


def exactly_one(df: DataFrame, what: str = "row") -> DataFrame:
    """``df`` if it has exactly one row, else an error; at most two rows are looked at."""
    n = len(df.limit(2).take(2))
    if n != 1:
        raise ValueError(f"exactly one {what} expected, found {'none' if not n else 'more'}")
    return df


def tiles_union(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of tiles that may overlap, of each key the one of the last tile that has it."""
    from ..operators.rank import last_by

    numbered = [p.withColumn("__tile", F.lit(k)) for k, p in enumerate(parts)]
    both = numbered[0]
    for part in numbered[1:]:
        both = both.unionByName(part)
    rest = [F.col(c) for c in parts[0].columns if c != key]
    return last_by(both, [key], F.col("__tile"), *rest).drop("__tile")


def split_compound(cell: Column, ending: str, sign: str = "・") -> Column:
    """Values of a cell of several lines; a line is split at ``sign`` only if each of its parts ends in ``ending``."""
    lines = F.filter(F.transform(F.split(cell, r"\r?\n"), trim_blanks), lambda x: x != "")
    parts = lambda line: F.transform(F.split(line, sign), trim_blanks)
    return F.flatten(F.transform(lines, lambda line: F.when(F.forall(parts(line), lambda p: F.endswith(p, F.lit(ending)) & (p != ending)), parts(line)).otherwise(F.array(line))))
