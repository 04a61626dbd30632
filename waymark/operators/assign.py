"""Old IDs for new groups, one claim at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components


def greedy_claims(claims: DataFrame) -> DataFrame:
    """``(new, old)``: each new group in its order takes its first old ID that no earlier one has taken.

    ``claims`` has ``new, old, order`` (of the group) and ``preference``. Groups that compete for an old ID, directly or
    through others, form a component of the claim graph; components don't touch each other and are worked off apart. Within
    one the walk is sequential by its nature.
    """
    ids = claims.select(F.concat(F.lit("n"), F.col("new").cast("string")).alias("a"), F.concat(F.lit("o"), F.col("old").cast("string")).alias("b")).distinct()
    vertices = ids.select(F.col("a").alias("v")).unionByName(ids.select(F.col("b").alias("v")))
    found = components(vertices, ids)
    marked = claims.join(found.withColumnRenamed("v", "__v"), F.concat(F.lit("n"), F.col("new").cast("string")) == F.col("__v")).drop("__v")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        ordered = group.sort_values(["order", "new", "preference", "old"], kind="stable")
        for new, options in ordered.groupby(["order", "new"], sort=False)["old"]:
            old = next((o for o in options if o not in taken), None)
            if old is not None:
                taken.add(old)
                out.append((new[1], old))
        return pd.DataFrame(out, columns=["new", "old"])

    kinds = dict(claims.dtypes)
    return marked.groupBy("component").applyInPandas(walk, f"new {kinds['new']}, old {kinds['old']}")
