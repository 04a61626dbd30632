"""References to keys that a register lacks at the time of the reference.

Method: a skew-aware split. References are pre-aggregated per key and period; keys with many references are
checked against the broadcast register rows of just these keys, the remaining ones by a shuffled anti-join, and
the orphans of both sides are put together.

The register is first reduced to disjoint spans in which a key is in force: loads and withdrawals become steps
of +1 and -1, which are summed per key and instant before the shuffle, opening balances run over one row per
key and slice, and only then the steps within a slice are ordered; an edge finds the next one within its slice or at
the begin of a later one. So neither many copies nor a long history of one key meets in one task.

A hot key is one with more references or steps than ``hot_share`` of all, so there are at most
``2 / hot_share`` of them. Their spans are broadcast only if there are at most ``broadcast_rows``; beyond
that they are cut at slice bounds and joined per key and slice, which splits a hot key by time.

Defined results:

* null and blank keys are no references; a null time of reference has no period and yields no row;
* IDs that differ in width, case or blanks around them are one key;
* a row in force has ``loaded_at <= t`` and ``withdrawn_at`` null or ``> t``; rows without ``loaded_at`` and rows
  withdrawn at or before they are loaded are never in force;
* repeated references count each; with an empty register every reference is an orphan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import reference_key

HOT_SHARE = 0.01
#: Keys with at most so many rows are never hot.
HOT_ROWS = 1000
BROADCAST_ROWS = 100_000
SLICE = "month"


def period_of(at: Column) -> Column:
    """Month of a UTC timestamp as ``2025-03``."""
    return F.date_format(at, "yyyy-MM")


def references(df: DataFrame, table: str, key: str, row: str, at: str) -> DataFrame:
    """``(ref_table, ref_row, key, at)`` of the rows of ``df`` that refer to something."""
    return df.select(F.lit(table).alias("ref_table"), F.col(row).alias("ref_row"), reference_key(F.col(key)).alias("key"), F.col(at).alias("at")).filter("key IS NOT NULL AND at IS NOT NULL")


def register_steps(register: DataFrame, key: str = "ID", opened: str = "loaded_at", closed: str = "withdrawn_at") -> DataFrame:
    """``(key, at, step)``: net change of the number of rows in force, one row per key and instant."""
    rows = register.select(reference_key(F.col(key)).alias("key"), F.col(opened).alias("a"), F.col(closed).alias("b")).filter("key IS NOT NULL AND a IS NOT NULL AND (b IS NULL OR b > a)")
    steps = rows.select("key", F.expr("inline(filter(array(named_struct('at', a, 'step', 1L), named_struct('at', b, 'step', -1L)), s -> s.at IS NOT NULL))"))
    return steps.groupBy("key", "at").agg(F.sum("step").alias("step")).filter("step <> 0")


def spans_in_force(steps: DataFrame) -> DataFrame:
    """Disjoint spans ``(key, a, b)`` with at least one row in force; ``b`` is null where the span has no end."""
    steps = steps.withColumn("slice", F.date_trunc(SLICE, "at"))
    per_slice = steps.groupBy("key", "slice").agg(F.sum("step").alias("net"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = per_slice.select("key", "slice", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("opening"))
    within = Window.partitionBy("key", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    levels = steps.join(opening, ["key", "slice"]).withColumn("level", F.col("opening") + F.sum("step").over(within))
    edges = levels.filter("(level > 0) <> (level - step > 0)").select("key", "slice", "at", (F.col("level") > 0).alias("opens"))
    # An edge is followed by the next one of its slice, the last one by the first of the next slice that has any.
    firsts = edges.groupBy("key", "slice").agg(F.min("at").alias("first"))
    later = firsts.select("key", "slice", F.lead("first").over(Window.partitionBy("key").orderBy("slice")).alias("later"))
    ordered = edges.withColumn("next", F.lead("at").over(Window.partitionBy("key", "slice").orderBy("at"))).filter("opens")
    return ordered.join(later, ["key", "slice"]).select("key", F.col("at").alias("a"), F.coalesce("next", "later").alias("b"))


def hot_keys(refs: DataFrame, steps: DataFrame, hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS) -> list[str]:
    """Keys with more than ``hot_share`` of all references or steps; at most ``2 / hot_share``."""
    per_key = refs.groupBy("key", period_of(F.col("at")).alias("period")).count().groupBy("key").agg(F.sum("count").alias("n"))
    found: set[str] = set()
    for counts in (per_key, steps.groupBy("key").agg(F.count("*").alias("n"))):
        total = counts.agg(F.sum("n")).first()[0] or 0
        limit = max(hot_rows, hot_share * total)
        if total > limit:
            found |= {r.key for r in counts.filter(F.col("n") > limit).select("key").collect()}
    return sorted(found)


def orphan_references(refs: DataFrame, register: DataFrame, hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(ref_table, ref_row, period)`` of the references without a row in force at their time."""
    steps = register_steps(register)
    spans = spans_in_force(steps)
    hot = hot_keys(refs, steps, hot_share, hot_rows)
    held = (F.col("r.key") == F.col("s.key")) & (F.col("r.at") >= F.col("s.a")) & (F.col("s.b").isNull() | (F.col("r.at") < F.col("s.b")))
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    orphans = refs.filter(~is_hot).alias("r").join(spans.filter(~is_hot).alias("s"), held, "left_anti")
    if hot:
        hot_refs, hot_spans = refs.filter(is_hot), spans.filter(is_hot)
        if hot_spans.limit(broadcast_rows + 1).count() <= broadcast_rows:
            found = hot_refs.alias("r").join(F.broadcast(hot_spans).alias("s"), held, "left_anti")
        else:
            found = _by_slice(hot_refs, hot_spans)
        orphans = orphans.unionByName(found)
    return orphans.select("ref_table", "ref_row", period_of(F.col("at")).alias("period"))


def _by_slice(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """The anti-join per key and slice: each span is repeated for the slices it touches."""
    last = refs.agg(F.max("at").alias("last"))
    cut = spans.crossJoin(F.broadcast(last)).filter("a <= last").withColumn("slice", F.explode(F.expr(f"sequence(date_trunc('{SLICE}', a), date_trunc('{SLICE}', least(coalesce(b, last), last)), interval 1 month)"))).drop("last")
    refs = refs.withColumn("slice", F.date_trunc(SLICE, "at"))
    held = (F.col("r.key") == F.col("s.key")) & (F.col("r.slice") == F.col("s.slice")) & (F.col("r.at") >= F.col("s.a")) & (F.col("s.b").isNull() | (F.col("r.at") < F.col("s.b")))
    return refs.alias("r").join(cut.alias("s"), held, "left_anti").drop("slice")


def orphan_report(refs: DataFrame, register: DataFrame) -> DataFrame:
    """Per table and month: how many references there are, how many of them are orphans."""
    orphans = orphan_references(refs, register).groupBy("ref_table", "period").agg(F.count("*").alias("n_orphans"))
    every = refs.groupBy("ref_table", period_of(F.col("at")).alias("period")).agg(F.count("*").alias("n_references"))
    return every.join(orphans, ["ref_table", "period"], "left").select("ref_table", "period", "n_references", F.coalesce("n_orphans", F.lit(0)).cast("long").alias("n_orphans"))
