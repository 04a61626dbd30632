"""Field records as a stream: the latest per road, with deletions."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.rank import last_by


#: Parts of the table by hash of the key.
BUCKETS = 64


def latest(records: DataFrame, key: str, at: str, deleted: str = "deleted") -> DataFrame:
    """Of each key the last record by time, unless that deletes it; ties go to the larger row."""
    rest = [c for c in records.columns if c not in (key, at)]
    return last_by(records, [key], F.col(at), *[F.col(c) for c in rest if dict(records.dtypes)[c] in ("string", "bigint", "int", "double", "boolean")]).filter(~F.coalesce(F.col(deleted), F.lit(False)))


def keep_latest(stream: DataFrame, folder: str, key: str, at: str, checkpoint: str, deleted: str = "deleted", buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the last record of each key in a versioned table under ``folder``.

    Keys lie in ``buckets`` by hash. Each batch is merged with the buckets that it touches and writes these alone as the version
    of its number, so what a batch costs doesn't grow with the buckets it leaves alone. A batch that is run again after a loss
    starts from the same versions and leaves the same table. Deletions stay as marks, lest a late record brings its key back.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        # At most ``buckets`` numbers.
        touched = {r.bucket for r in rows.select("bucket").distinct().collect()}
        before = [path for bucket, path in _newest(spark, folder, number).items() if bucket in touched]
        if before:
            old = spark.read.schema(batch.schema).parquet(*before)
            rows = old.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).unionByName(rows)
        rest = [F.col(c) for c in batch.columns if c not in (key, at) and dict(batch.dtypes)[c] in ("string", "bigint", "int", "double", "boolean")]
        last_by(rows, [key], F.col(at), *rest).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/version={number:012d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _globbed(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [str(f.getPath()) for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []]


def _newest(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, str]:
    """Folder of the newest whole version of each bucket, of those before number ``before`` if that is given."""
    whole = {os.path.dirname(p) for p in _globbed(spark, f"{folder}/version=*/_SUCCESS")}
    found: dict[int, str] = {}
    for path in sorted(_globbed(spark, f"{folder}/version=*/bucket=*")):
        version, bucket = os.path.split(path)
        if version in whole and (before is None or int(version.rsplit("=", 1)[1]) < before):
            found[int(bucket.split("=")[1])] = path
    return found


def current(spark: SparkSession, folder: str, schema: StructType | str, deleted: str = "deleted") -> DataFrame:
    """Records that the batches left, without deleted ones; none where no batch was written."""
    paths = list(_newest(spark, folder).values())
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.filter(~F.coalesce(F.col(deleted), F.lit(False)))
