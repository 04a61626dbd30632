"""First, best, last and next of groups; every order is total, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in ``order``.

    One aggregation with map-side combine instead of a window, so a hot group isn't sorted in one task. ``order`` must
    be columns of types that can be compared within a struct; a descending one is given by its negative or by ``last_by``.
    """
    return _extreme(df, keys, order, F.min_by)


def last_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each group in ``order``: of several records under one key the latest."""
    return _extreme(df, keys, order, F.max_by)


def _extreme(df: DataFrame, keys: list[str], order: tuple[Column, ...], pick) -> DataFrame:
    rank = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])
    return df.groupBy(*keys).agg(pick(F.struct(*df.columns), rank).alias("row")).select("row.*")


def mode_first(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Most frequent ``value`` per group, of equally frequent ones the one that comes first, then the smallest."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(position).alias("at"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col("at"), F.col(value))).alias(value), F.max("n").alias("n"))


def ordered_distinct(value: str, *order: str) -> Column:
    """Aggregate: distinct values in the order of their first occurrence. For groups of bounded size."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, value)))
    return F.array_distinct(F.filter(F.transform(ordered, lambda r: r[value]), lambda v: v.isNotNull() & (v.cast("string") != "")))


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """``df`` with the number of each row in a global order, without gathering all rows in one task.

    Rows are range-partitioned and sorted; each partition then adds the sizes of those before it.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    spread = spread.withColumn("__k", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33))
    sizes = spread.groupBy("__p").agg((F.max("__k") + 1).alias("n"))
    before = sizes.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return spread.join(F.broadcast(before.select("__p", "offset")), "__p").withColumn(name, F.col("offset") + F.col("__k") + 1).drop("__p", "__k", "offset")


def top_per_group(df: DataFrame, group: str, per_group: int, total: int, *order: Column) -> DataFrame:
    """The first ``total`` rows in ``order`` of which at most ``per_group`` belong to one group, with ``position``.

    As the cap of each group follows the same order, this equals a walk through all rows in order. The cap is the feature.
    """
    w = Window.partitionBy(group).orderBy(*order)
    few = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_group).drop("__r")
    # At most ``total`` rows reach the single task that numbers them.
    chosen = few.orderBy(*order).limit(total)
    return chosen.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def minted(new: DataFrame, highest: int, prefix: str, *order: Column) -> DataFrame:
    """``new`` rows with IDs that go on after number ``highest``, in ``order``."""
    rows = numbered(new, *order)
    return rows.withColumn("id", F.concat(F.lit(prefix + "-"), F.lpad((F.col("position") + highest).cast("string"), 6, "0"))).drop("position")


def best_two(df: DataFrame, group: str, order: Column, value: str) -> DataFrame:
    """``(group, first, second)``: the two first distinct values of each group in ``order``; null where there is no second.

    Two aggregations with map-side combine; no group is gathered.
    """
    ordered = df.select(group, value, order.alias("__o"))
    first = ordered.groupBy(group).agg(F.min_by(value, "__o").alias("first"))
    second = ordered.join(first, group).filter(F.col(value) != F.col("first")).groupBy(group).agg(F.min_by(value, "__o").alias("second"))
    return first.join(second, group, "left")


def counted_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys``, one ``value`` and ``n``, the number of rows, per group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias(value))


def only_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` no other row has; one aggregation, before any join."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.min(c).alias(c) for c in rest]).filter("__n = 1").drop("__n")


def paged(df: DataFrame, keys: list[str], value: str, size: int) -> DataFrame:
    """``keys``, ``page`` and ``values``: the values of each group in order, in lists of at most ``size``.

    Rows are numbered over all groups by range partitions, so a group that holds a third of the rows is never one list or
    one task.
    """
    named = df.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col(value).alias("__v"))
    rows = numbered(named, *[F.col(f"__key_{k}") for k in keys], F.col("__v"), name="__at")
    first = rows.groupBy(*[F.col(f"__key_{k}").alias(k) for k in keys]).agg(F.min("__at").alias("__first"))
    # Null groups are groups too.
    placed = rows.join(first, [F.col(f"__key_{k}").eqNullSafe(F.col(k)) for k in keys]).withColumn("__k", F.col("__at") - F.col("__first"))
    return placed.groupBy(*keys, F.floor(F.col("__k") / size).alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__v"))), lambda r: r["__v"]).alias("values"))


def only_match(pairs: DataFrame, probe: list[str]) -> DataFrame:
    """Pairs whose probe side has exactly one partner."""
    single = pairs.groupBy(*probe).agg(F.count("*").alias("__n")).filter("__n = 1").drop("__n")
    return pairs.join(single, probe, "left_semi")


def first_preferred(df: DataFrame, keys: list[str], preferred: Column, *order: Column) -> DataFrame:
    """Of each group the first row in ``order`` that is ``preferred``, else the first row."""
    return first_by(df, keys, (~F.coalesce(preferred, F.lit(False))).cast("int"), *order)


def first_reaching(df: DataFrame, keys: list[str], score: Column, least: float, *order: Column) -> DataFrame:
    """Of each group the first row in ``order`` whose score reaches ``least``, else the one of the highest score."""
    reached = F.coalesce(score >= least, F.lit(False))
    return first_by(df, keys, (~reached).cast("int"), F.when(~reached, -score), *order)
