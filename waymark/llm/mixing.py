"""Sources mixed to target shares of all tokens.

Method: Poisson replication. A uniform number from a seeded hash of the document's key is sent through the inverse of a
Poisson distribution, cut at the source's most repeats; each document is exploded by its count and the copies are
shuffled globally by another hash.

The mean of a source's distribution is the rate its target needs. As cutting and chance move the tokens that come
out, means are found on the data themselves: all documents are counted under a grid of means at once, and the grid is
narrowed around the target. Documents differ so much in length that without this the small sources would miss it.

The size of the mix is the largest at which no source needs more than its most repeats. Only sums per source and
grid point come to the driver; no source is gathered anywhere, so one that holds a third of all documents is no hot group.

Defined results: documents without source, of sources without target, or of targets that are null or not above 0 are
used 0 times; texts without tokens follow their source and weigh nothing; targets without documents can't be met
and show an actual share of 0, the others keep their ratios; repeated targets of a source: the smallest name sorts first
and the largest share counts; an empty table gives no uses.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import VOCABULARY, with_tokens

SEED = 20_25
GRID, PASSES = 32, 4
#: ``mix_targets`` may have so many rows, and so many steps of repeats over all rows and grid points may be broadcast; it is a
#: table of settings, not of data. More is an error, nothing is left out.
MOST_SOURCES, MOST_STEPS = 10_000, 20_000_000


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))


def poisson_steps(mean: float, most: int) -> list[float]:
    """Chances of fewer than 1, 2, ... ``most`` events: a uniform number gives as many as it isn't below."""
    if math.isinf(mean):
        return [0.0] * most
    if mean <= 0:
        return [1.0] * most
    # Chances in logarithms, as the first ones are below what a number can hold from a mean of 745 on.
    total, out = 0.0, []
    for k in range(most):
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        out.append(min(1.0, total))
    return out


def _uses(u: Column, steps: Column) -> Column:
    return F.size(F.filter(steps, lambda s: u >= s))


def counted(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, source, tokens, u)`` of each document, written to the shared folder once."""
    rows = with_tokens(documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source")), "text", vocabulary)
    return cut_lineage(rows.select("key", "source", "tokens", uniform(F.col("key"), seed).alias("u")))


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    if sum(r.t.max_repeats for r in rows) * GRID > MOST_STEPS:
        raise ValueError(f"more than {MOST_STEPS // GRID} repeats over all targets")
    return {r.source: (float(r.t.target_share), int(r.t.max_repeats)) for r in rows}


def means(rows: DataFrame, targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Mean of each source's Poisson distribution; infinite where every document is used as often as may be."""
    spark = rows.sparkSession
    held = {r.source: r.tokens for r in rows.filter(F.col("source").isin(list(targets))).groupBy("source").agg(F.sum("tokens").alias("tokens")).collect() if r.tokens}
    if not held:
        return {}
    total = min(targets[s][1] * held[s] / targets[s][0] for s in held)
    goal = {s: targets[s][0] * total for s in held}
    found = {s: math.inf for s in held if goal[s] >= targets[s][1] * held[s] * (1 - 1e-9)}
    low = {s: 0.0 for s in held if s not in found}
    high = {s: targets[s][1] + 10 * math.sqrt(targets[s][1]) + 10 for s in low}
    for _ in range(PASSES if low else 0):
        grid = {s: [low[s] + (high[s] - low[s]) * k / (GRID - 1) for k in range(GRID)] for s in low}
        table = spark.createDataFrame([(s, [poisson_steps(m, targets[s][1]) for m in g]) for s, g in grid.items()], "source string, steps array<array<double>>")
        used = rows.join(F.broadcast(table), "source").select("source", "tokens", F.transform("steps", lambda s: _uses(F.col("u"), s)).alias("n"))
        sums = used.groupBy("source").agg(*[F.sum(F.col("tokens") * F.get("n", F.lit(k))).alias(f"s{k}") for k in range(GRID)]).collect()
        for r in sums:
            s, values = r["source"], [r[f"s{k}"] for k in range(GRID)]
            above = next((k for k, v in enumerate(values) if v >= goal[s]), GRID - 1)
            below = max(0, above - 1)
            found[s] = grid[s][above if abs(values[above] - goal[s]) <= abs(values[below] - goal[s]) else below]
            low[s], high[s] = grid[s][below], grid[s][above]
    return found


def uses(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, source, tokens, uses)``: how often each document is used."""
    rows = counted(documents, key, text, source, seed, vocabulary)
    wanted = _targets(targets)
    table = rows.sparkSession.createDataFrame([(s, poisson_steps(m, wanted[s][1])) for s, m in means(rows, wanted).items()], "source string, steps array<double>")
    found = rows.join(F.broadcast(table), "source", "left").withColumn("uses", F.when(F.col("steps").isNull(), 0).otherwise(_uses(F.col("u"), F.col("steps"))).cast("int"))
    return found.select(F.col("key").alias(key), F.col("source").alias(source), "tokens", "uses")


def mixed(used: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The mix: ``(key, copy, shuffle_key)``, one row per use, in shuffled order over all partitions."""
    copies = used.filter("uses > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    order = F.xxhash64(F.lit(seed + 1), F.col(key), F.col("copy"))
    return copies.withColumn("shuffle_key", order).select(key, "source", "tokens", "copy", "shuffle_key").repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key", key, "copy")


def shares(used: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """Per target: documents, tokens used, the share wanted and the share reached."""
    sums = used.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens_held"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"), F.max("uses").alias("most_uses"))
    total = sums.agg(F.sum("tokens_used").alias("total"))
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return wanted.join(sums, "source", "left").crossJoin(F.broadcast(total)).select("source", "target_share", "max_repeats", zero("documents"), zero("tokens_held"), zero("tokens_used"), zero("most_uses"), F.round(F.coalesce(F.col("tokens_used") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"))
