"""Documents in packs of fixed capacities.

Method: hierarchical multi-length packing. Each document is routed to the tier of the smallest capacity that holds it
whole, each tier is packed from the longest window down (best fit, longest first), the gaps of long windows are filled
from the shorter tiers, and the packs of a tier are dealt to step groups so that these hold about the same number of
tokens.

Documents are spread by the hash of their key over shards of about ``SHARD_ITEMS``, which are packed on their own; so
the size of a task doesn't depend on the corpus, nor on how large a source is, and each shard leaves at most a few
packs that aren't full. Only keys and lengths are shuffled.

Defined results: a text longer than the largest capacity is cut into pieces of that capacity and a rest, none else is;
a text without tokens takes no room and lies in the first pack of the smallest tier; repeated keys are documents of
their own; without documents there are no packs; capacities below 1 or null and repeated capacities are left out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import VOCABULARY, with_tokens

SHARD_ITEMS = 100_000
GROUP_PACKS = 64
MOST_TIERS = 1000


class _Lengths:
    """A multiset of items by length."""

    def __init__(self, items: np.ndarray, lengths: np.ndarray):
        self.by_length: dict[int, list[int]] = {}
        for item in items[np.argsort(-items, kind="stable")]:
            self.by_length.setdefault(int(lengths[item]), []).append(int(item))
        self.sorted = sorted(self.by_length)

    def take(self, room: int) -> int | None:
        """The longest item that fits into ``room``."""
        at = bisect_right(self.sorted, room)
        if not at:
            return None
        length = self.sorted[at - 1]
        item = self.by_length[length].pop()
        if not self.by_length[length]:
            del self.by_length[length], self.sorted[at - 1]
        return item

    def rest(self) -> list[int]:
        return [i for length in self.sorted for i in self.by_length[length]]


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int) -> tuple[list[list[int]], list[int]]:
    """Packs and their room: each item, in ``order``, goes to the fullest pack that still holds it."""
    packs: list[list[int]] = []
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}
    known: list[int] = []
    for item in order:
        need = int(lengths[item])
        at = bisect_left(known, need)
        if at < len(known):
            room = known[at]
            pack = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], known[at]
        else:
            room, pack = capacity, len(packs)
            packs.append([])
            rooms.append(capacity)
        packs[pack].append(int(item))
        rooms[pack] = left = room - need
        if left not in by_room:
            by_room[left] = []
            insort(known, left)
        by_room[left].append(pack)
    return packs, rooms


def pack_shard(lengths: np.ndarray, capacities: list[int]) -> list[tuple[int, list[int], int]]:
    """``(tier, items, room)`` of each pack; no length exceeds the largest of the ascending ``capacities``."""
    tier_of = np.searchsorted(capacities, lengths)
    waiting = np.ones(len(lengths), dtype=bool)
    out = []
    for tier in reversed(range(len(capacities))):
        mine = np.flatnonzero(waiting & (tier_of == tier))
        order = mine[np.argsort(-lengths[mine], kind="stable")]
        packs, rooms = best_fit(lengths, order[lengths[order] > 0], capacities[tier])
        waiting[mine] = False
        shorter = _Lengths(np.flatnonzero(waiting & (lengths > 0)), lengths)
        for k in np.argsort(-np.asarray(rooms, dtype=int), kind="stable"):
            while rooms[k] > 0 and (item := shorter.take(rooms[k])) is not None:
                packs[k].append(item)
                rooms[k] -= int(lengths[item])
                waiting[item] = False
        out += [(tier, p, r) for p, r in zip(packs, rooms, strict=True)]
    empty = [int(i) for i in np.flatnonzero(lengths == 0)]
    if empty:
        first = next((k for k, (tier, _, _) in enumerate(out) if tier == 0), None)
        if first is None:
            out.append((0, empty, capacities[0]))
        else:
            out[first][1].extend(empty)
    return out


def step_groups(rooms: np.ndarray, size: int = GROUP_PACKS) -> np.ndarray:
    """Group of each pack: dealt back and forth from the fullest to the emptiest."""
    groups = max(1, -(-len(rooms) // size))
    order = np.argsort(rooms, kind="stable")
    rank = np.arange(len(rooms))
    turn, place = rank // groups, rank % groups
    out = np.empty(len(rooms), dtype=np.int64)
    out[order] = np.where(turn % 2 == 0, place, groups - 1 - place)
    return out


def packed(documents: DataFrame, sizes: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``(key, piece, tokens, pack, pack_id, step_group, room_left)`` of each document or piece.

    ``sizes`` has ``pack`` and ``capacity_tokens``.
    """
    rows = sizes.filter("capacity_tokens > 0").groupBy("capacity_tokens").agg(F.min("pack").alias("pack")).orderBy("capacity_tokens").limit(MOST_TIERS + 1).collect()
    if not rows or len(rows) > MOST_TIERS:
        raise ValueError(f"between 1 and {MOST_TIERS} capacities are needed")
    capacities, names = [r.capacity_tokens for r in rows], [r["pack"] for r in rows]
    largest = capacities[-1]
    # Keys travel as texts, lest pandas makes numbers of whole numbers with nulls.
    counted = cut_lineage(with_tokens(documents.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")), "text", vocabulary).select("key", "tokens"))
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("tokens") / largest).cast("int")))))
    pieces = pieces.withColumn("tokens", F.least(F.lit(largest).cast("long"), F.col("tokens") - (F.col("piece") - 1) * largest))
    shards = max(1, -(-pieces.count() // shard_items))

    def pack(shard: tuple[int], items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["key", "piece"], kind="stable").reset_index(drop=True)
        packs = pack_shard(items["tokens"].to_numpy(np.int64), capacities)
        groups = np.zeros(len(packs), dtype=np.int64)
        tiers, rooms = np.asarray([p[0] for p in packs]), np.asarray([p[2] for p in packs])
        for tier in set(tiers.tolist()):
            groups[tiers == tier] = step_groups(rooms[tiers == tier])
        out = [(i, names[tier], f"{names[tier]}-{shard[0]}-{k}", f"{names[tier]}-{shard[0]}-{groups[k]}", room) for k, (tier, members, room) in enumerate(packs) for i in members]
        found = pd.DataFrame(out, columns=["i", "pack", "pack_id", "step_group", "room_left"], dtype=object).set_index("i").sort_index()
        return pd.DataFrame({"key": items["key"].astype(object), "piece": items["piece"], "tokens": items["tokens"], **{c: found[c] for c in found}})

    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("key", "piece"), F.lit(shards)))
    done = sharded.groupBy("shard").applyInPandas(pack, "key string, piece int, tokens long, pack string, pack_id string, step_group string, room_left long")
    return done.select(F.col("key").cast(documents.schema[key].dataType).alias(key), "piece", "tokens", "pack", "pack_id", "step_group", "room_left")


def pack_report(packs: DataFrame) -> DataFrame:
    """Per tier: packs, documents or pieces, tokens and the share of room left over."""
    each = packs.groupBy("pack", "pack_id").agg(F.sum("tokens").alias("tokens"), F.first("room_left").alias("room"), F.count("*").alias("items"))
    return each.groupBy("pack").agg(F.count("*").alias("n_packs"), F.sum("items").alias("n_items"), F.sum("tokens").alias("tokens"), F.sum("room").alias("room_left")).withColumn("share_left", F.round(F.col("room_left") / (F.col("room_left") + F.col("tokens")), 6))
