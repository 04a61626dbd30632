"""Connected components without gathering any component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(vertices: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``(v, component)``: each vertex with the smallest vertex of its component.

    ``vertices`` has ``v``, ``edges`` has ``a, b`` in any direction, with repeats and loops. Method: alternating large and
    small stars. Neighbours are never collected; each round is two aggregations and joins, and there are
    logarithmically many. Lineage is cut in the shared checkpoint folder.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges)
    mark = _mark(edges)
    for _ in range(most_rounds):
        edges = cut_lineage(_small_star(_large_star(edges)))
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components are not stable after {most_rounds} rounds")
    lowest = edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("low"))
    return vertices.select("v").distinct().join(lowest, "v", "left").select("v", F.coalesce("low", "v").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and two sums over their hashes: the same for the same edges, in one small aggregation."""
    hashes = [F.sum(F.xxhash64(F.lit(seed), "a", "b").cast("decimal(20,0)")) for seed in (1, 2)]
    return tuple(edges.agg(F.count("*"), *hashes).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components_of_labels(vertices: DataFrame, labels: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """``(v, component)`` as by ``components`` over all edges ``(v, c)`` of ``labels``, ``links`` and ``edges``.

    ``labels`` has at most one row per ``v``, its ``c`` a vertex not greater than ``v``; ``links`` has edges between ``c``, ``edges`` those
    between ``v``. Only what is between different ``c`` goes through rounds, so the many vertices of one ``c`` are joined once.
    """
    end = lambda k: labels.select(F.col("v").alias(k), F.col("c").alias(f"c{k}"))
    between = edges.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    between = cut_lineage(between.unionByName(links).filter("a <> b").distinct())
    out = vertices.select("v").distinct().join(labels, "v", "left").select("v", F.coalesce("c", "v").alias("c"))
    if between.isEmpty():
        return out.withColumnRenamed("c", "component")
    ends = between.select(F.explode(F.array("a", "b")).alias("v"))
    moved = components(ends, between).filter("v <> component").withColumnRenamed("v", "c")
    return out.join(moved, "c", "left").select("v", F.coalesce("component", "c").alias("component"))


#: Up to so many groups are broadcast to their members.
FEW_GROUPS = 50_000


def shared_edges(members: DataFrame, *keys: str) -> DataFrame:
    """Edges ``(a, b)`` that join all ``v`` with the same ``keys``: each to the smallest, not each pair.

    Components are the same as those of all pairs, and a key that holds a third of all rows gives one edge a row. The members of
    a key are looked up again only where it has more rows than two.
    """
    groups = members.groupBy(*keys).agg(F.min("v").alias("b"), F.max("v").alias("a"), F.count("*").alias("n"))
    groups = cut_lineage(groups.filter("a <> b").dropna(subset=list(keys)))
    more = groups.filter("n > 2").select(*keys, "b")
    rest = members.join(F.broadcast(more) if more.count() <= FEW_GROUPS else more, list(keys)).select(F.col("v").alias("a"), "b").filter("a <> b")
    return groups.filter("n = 2").select("a", "b").unionByName(rest).distinct()
