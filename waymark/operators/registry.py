"""A registry of routes kept up from a new scan: filtered, put together, matched to known IDs, numbered, merged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import is_place
from ..session import cut_lineage
from . import assign, graph, links, rank


@dataclass(frozen=True)
class Rules:
    """How near ends join ways of one name, and how IDs are written."""

    join_m: float = 5000.0
    prefix: str = "NGN"


def way_edges(ways: DataFrame, join_m: float) -> DataFrame:
    """Edges ``(a, b)`` that put ways of one name together which share a node or have ends within ``join_m``.

    ``ways`` has ``way, name, nodes`` and ``ends`` (array of lat, lon). Components are those of all such pairs, but there are only a few
    edges a way: a node, place or region that holds a third of all ways forms no pairs.
    """
    labels, links_, edges = _joined(ways, join_m)
    return labels.filter("v <> c").select(F.col("v").alias("a"), F.col("c").alias("b")).unionByName(links_).unionByName(edges)


def way_components(ways: DataFrame, join_m: float) -> DataFrame:
    """``(way, component)``: the components of ``way_edges``."""
    return graph.components_of_labels(ways.select(F.col("way").alias("v")), *_joined(ways, join_m)).withColumnRenamed("v", "way")


def _joined(ways: DataFrame, join_m: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels of near ends, links between labels, and edges between ways of a node or of equal ends that are no places."""
    shared = graph.shared_edges(ways.select(F.col("way").alias("v"), "name", F.explode("nodes").alias("node")), "name", "node")
    at = ways.select(F.col("way").alias("v"), "name", F.explode("ends").alias("p")).select("v", "name", "p.lat", "p.lon")
    # Ends that are no places are near nothing, but those at the same coordinates are still one end.
    together = graph.shared_edges(at.filter(~is_place(F.col("lat"), F.col("lon"))), "name", "lat", "lon")
    return *links.near_labels(at, "name", join_m), shared.unionByName(together)


def routes(ways: DataFrame, members: DataFrame) -> DataFrame:
    """``(component, name, n, lat_e6, lon_e6)``: ways put together by ``members`` (way, component), with the centre of their ends.

    Coordinates are summed up per way before they are shuffled; whoever leaves the centre out doesn't read them.
    """
    micro = lambda c: F.transform("ends", lambda p: F.round(p[c] * 1e6).cast("long"))
    total = lambda c: F.when(F.exists(micro(c), F.isnotnull), F.aggregate(micro(c), F.lit(0).cast("long"), lambda x, y: x + F.coalesce(y, F.lit(0)))).alias(c)
    rows = ways.select("way", "name", total("lat"), total("lon"), F.greatest(F.size("ends"), F.lit(0)).cast("long").alias("ends")).join(members, "way")
    named = rows.groupBy("component", "name").agg(F.count("*").alias("n"), F.min("way").alias("at"), *[F.sum(c).alias(c) for c in ("lat", "lon", "ends")])
    name = F.min_by("name", F.struct(-F.col("n"), F.col("at"), F.col("name"))).alias("name")
    centre = [F.when(F.sum("ends") > 0, F.floor(F.sum(c) / F.sum("ends"))).alias(f"{c}_e6") for c in ("lat", "lon")]
    return named.groupBy("component").agg(name, F.sum("n").alias("n"), *centre)


def kept_ids(found: DataFrame, ways: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """``(component, id)``: known IDs of components, by a shared way first, then by a name that both sides have once.

    ``known`` has ``id, name`` and ``way`` (one row per way, null for none). A claim by a way goes to the first component that makes it.
    """
    by_way = members.join(known.filter("way IS NOT NULL").select("way", "id").distinct(), "way").select(F.col("component").alias("new"), F.col("id").alias("old")).distinct()
    by_way = cut_lineage(by_way)
    claimed = assign.greedy_claims(by_way.withColumns({"order": F.col("new"), "preference": F.col("old")})).select(F.col("new").alias("component"), F.col("old").alias("id"))
    claimed = cut_lineage(claimed)
    open_components = rank.only_of(found.join(claimed, "component", "left_anti").select("component", "name"), ["name"])
    open_ids = rank.only_of(known.select("id", "name").distinct().join(claimed, "id", "left_anti"), ["name"])
    return claimed.unionByName(open_components.join(open_ids, "name").select("component", "id"))


def merged(ways: DataFrame, known: DataFrame, strict: Column, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """``(id, name, n_ways, origin)``: the registry after a scan; ``strict`` says which ways count.

    ``origin`` is ``matched``, ``new`` or ``unmatched``; known IDs stay, new ones go on after the highest number. ``ways`` is read
    several times and must be the same each time: cut its lineage before where it isn't, or where it costs much.
    """
    rows, matched = _matched(ways, known, strict, rules, "component", "name", "n", "lat_e6", "lon_e6")
    highest = known.agg(F.max(F.split_part("id", F.lit("-"), F.lit(2)).try_cast("long"))).first()[0] or 0
    fresh = rank.minted(rows.join(matched, "component", "left_anti"), highest, rules.prefix, F.col("name"), F.col("lat_e6"), F.col("lon_e6"), F.col("component"))
    old = known.groupBy("id").agg(F.min("name").alias("known_name"))
    out = rows.join(matched, "component").join(old, "id").select("id", "name", F.col("n").alias("n_ways"), F.lit("matched").alias("origin"))
    out = out.unionByName(fresh.select("id", "name", F.col("n").alias("n_ways"), F.lit("new").alias("origin")))
    return out.unionByName(old.join(matched, "id", "left_anti").select("id", F.col("known_name").alias("name"), F.lit(0).cast("long").alias("n_ways"), F.lit("unmatched").alias("origin")))


def report(ways: DataFrame, known: DataFrame, strict: Column, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """``(origin, n, n_ways)``: how many rows and ways ``merged`` has of each origin, without centres and new IDs."""
    rows, matched = _matched(ways, known, strict, rules, "component", "name", "n")
    old = known.select("id").distinct()
    part = lambda df, n, origin: df.select(n.alias("n_ways"), F.lit(origin).alias("origin"))
    out = part(rows.join(matched, "component").join(old, "id"), F.col("n"), "matched")
    out = out.unionByName(part(rows.join(matched, "component", "left_anti"), F.col("n"), "new"))
    out = out.unionByName(part(old.join(matched, "id", "left_anti"), F.lit(0).cast("long"), "unmatched"))
    return out.groupBy("origin").agg(F.count("*").alias("n"), F.sum("n_ways").alias("n_ways"))


def _matched(ways: DataFrame, known: DataFrame, strict: Column, rules: Rules, *columns: str) -> tuple[DataFrame, DataFrame]:
    """``columns`` of the ``routes`` of strict ways, and their known IDs."""
    ways = ways.filter(strict)
    members = cut_lineage(way_components(ways, rules.join_m))
    rows = cut_lineage(routes(ways, members).select(*columns))
    return rows, cut_lineage(kept_ids(rows, ways, members, known))
