"""Packs: whole documents, no overflow, little room, balanced groups."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from waymark.llm import packing as p
from waymark.llm.tokens import VOCABULARY, encoder, with_tokens

CAPACITIES = [8, 32, 128]


def check(lengths, packs):
    assert Counter(i for _, items, _ in packs for i in items) == Counter(range(len(lengths)))
    for tier, items, room in packs:
        assert room == CAPACITIES[tier] - sum(int(lengths[i]) for i in items) >= 0
        # Nothing lies in a window shorter than itself, nor is a window opened for shorter items alone.
        assert max(int(lengths[i]) for i in items) <= CAPACITIES[tier]
        if tier:
            assert max(int(lengths[i]) for i in items) > CAPACITIES[tier - 1]


@given(st.lists(st.integers(1, 128), max_size=60))
def test_any_lengths(lengths):
    check(lengths, p.pack_shard(np.asarray(lengths, dtype=np.int64), CAPACITIES))


def test_zero_lengths():
    packs = p.pack_shard(np.asarray([0, 5, 0]), CAPACITIES)
    assert packs == [(0, [1, 0, 2], 3)]
    assert p.pack_shard(np.asarray([0, 0]), CAPACITIES) == [(0, [0, 1], 8)]
    assert p.pack_shard(np.asarray([], dtype=np.int64), CAPACITIES) == []


def test_little_room():
    rnd = random.Random(3)
    lengths = np.asarray([min(128, max(1, int(rnd.lognormvariate(2, 1)))) for _ in range(5000)])
    packs = p.pack_shard(lengths, CAPACITIES)
    check(lengths, packs)
    used = sum(CAPACITIES[t] for t, _, _ in packs)
    assert sum(r for _, _, r in packs) < 0.01 * used


def test_step_groups():
    rooms = np.asarray([random.Random(k).randrange(100) for k in range(1000)])
    groups = p.step_groups(rooms, 64)
    sums = defaultdict(int)
    for g, r in zip(groups, rooms, strict=True):
        sums[int(g)] += int(r)
    assert max(Counter(groups.tolist()).values()) <= 64
    assert max(sums.values()) - min(sums.values()) <= 200


def run(spark, texts, shard_items=p.SHARD_ITEMS, capacities=(("s", 8), ("m", 32), ("none", None), ("zero", 0), ("s2", 8))):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], "doc_id long, text string, key string, tokens int")
    sizes = spark.createDataFrame(list(capacities), "pack string, capacity_tokens int")
    return p.packed(docs, sizes, shard_items=shard_items).collect()


@pytest.mark.parametrize("shard_items", [100_000, 3])
def test_documents(spark, shard_items):
    texts = [(1, "the road is closed"), (2, None), (3, ""), (4, "road " * 100), (5, "road"), (5, "road"), (None, "forest road map"), (7, "通行止" * 3)]
    got = run(spark, texts, shard_items)
    n = {k: len(encoder().encode_ordinary(t)) if t else 0 for k, t in texts}
    tokens = defaultdict(list)
    for r in got:
        tokens[r.doc_id].append((r.piece, r.tokens))
    assert sorted(tokens[4]) == [(k + 1, min(32, n[4] - 32 * k)) for k in range(-(-n[4] // 32))]
    assert sorted(tokens[5]) == [(1, n[5])] * 2
    assert {k: v for k, v in tokens.items() if k not in (4, 5)} == {k: [(1, n[k])] for k in (1, 2, 3, None, 7)}
    packs = defaultdict(list)
    for r in got:
        packs[r.pack_id].append(r)
    for members in packs.values():
        capacity = {"s": 8, "m": 32}[members[0]["pack"]]
        assert {r.room_left for r in members} == {capacity - sum(r.tokens for r in members)}


def test_no_documents_or_capacities(spark):
    assert run(spark, []) == []
    with pytest.raises(ValueError, match="capacities"):
        run(spark, [(1, "a")], capacities=[("none", None)])


def test_report(spark):
    docs = spark.createDataFrame([(k, "road map") for k in range(10)], "doc_id long, text string")
    sizes = spark.createDataFrame([("s", 8)], "pack string, capacity_tokens int")
    report = p.pack_report(p.packed(docs, sizes)).first()
    assert (report["pack"], report.n_items, report.tokens) == ("s", 10, 20)
    assert report.room_left == 8 * report.n_packs - 20


def test_token_counts(spark):
    texts = ["", None, "a road", "林道 <|endoftext|>", "長" * 3000]
    df = with_tokens(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert [r.tokens for r in df.collect()] == [len(encoder(VOCABULARY).encode_ordinary(t)) if t else 0 for t in texts]
