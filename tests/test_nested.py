"""Nested records: shapes, nulls, positions, and a plain walk over the test data."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from conftest import rows

from waymark.operators import nested
from waymark.sources.tables import load

ENTRANCE = "struct<id: string, lat: double, lon: double, status: string, pointType: string, accessClass: string, surface: string, navEnabled: boolean, description: string, source: string, sourceUrl: string, checkedOn: string>"


def raw(spark, *payloads, kind="nagano_entrances"):
    return spark.createDataFrame([(k, kind, p, "x") for k, p in enumerate(payloads, 1)], "raw_no long, kind string, payload string, road_pos string")


def found(spark, payload, kind="nagano_entrances"):
    read = nested.raw_entrances if kind == "nagano_entrances" else nested.raw_sources
    df = read(raw(spark, payload, kind=kind)).filter("child_key IS NOT NULL")
    return rows(df, "road_pos", "child_pos", "child_key")


@pytest.mark.parametrize(
    ("payload", "expected"),
    [
        ('{"roads": [{"roadId": "A", "entrances": [null, {"id": "E1"}, {"lat": 1}, {"id": " "}, {"id": "E4"}]}]}', [(1, 2, "E1"), (1, 5, "E4")]),
        ('{"roads": {"R2": {"entrances": [{"id": "x"}]}, "R1": {"entrances": [{"id": "y"}]}}}', [(1, 1, "x"), (2, 1, "y")]),
        ('[{"roadId": "A", "entrances": {"E2": {"lat": 1}, "E1": {"id": "own"}}}]', [(1, 1, "E2"), (1, 2, "own")]),
        ('{"roadId": "A", "entrances": {"id": "only", "lat": 2}}', [(1, 1, "only")]),
        ('{"data": {"result": {"roads": [{"roadId": "A", "segments": [{"entrances": [{"id": "a"}, null]}, {"entrances": null}, {"entrances": [{"id": "b"}]}]}]}}}', [(1, 1, "a"), (1, 3, "b")]),
        ('{"other": {"roads": [null, {"roadId": "A", "entrances": [{"id": "a"}]}]}}', [(2, 1, "a")]),
        (json.dumps('{"roads": [{"roadId": "A", "entrances": [{"id": "a"}]}]}'), [(1, 1, "a")]),
        ('{"roads": [{"roadId": "A", "entrances": [{"id": " kept "}]}]}', [(1, 1, " kept ")]),
        ('{"roads": [{"roadId": "A", "entrances": [{"id": "a"', []),
        ('{"roads": [{"roadId": "A", "entrances": [{"id": "a"}]}]} tail', []),
        ('{"roads": []}{"roads": []}', []),
        ('{"data": ' * 9 + '{"roads": [{"roadId": "A", "entrances": [{"id": "a"}]}]}' + "}" * 9, [(1, 1, "a")]),
        ('{"a": {"roads": [{"roadId": "A", "entrances": [{"id": "a"}]}]}, "n": 1, "b": {"roads": [null, {"roadId": "B", "entrances": [{"id": "b"}]}]}}', [(1, 1, "a"), (3, 1, "b")]),
        ('{"data": {"roads": [{"roadId": "A", "entrances": [{"id": "a"}]}]}, "result": [{"roadId": "B", "entrances": [{"id": "b"}]}]}', [(1, 1, "a"), (2, 1, "b")]),
        ('[{"roads": [{"roadId": "A", "entrances": [{"id": "a"}]}]}, null, {"roads": [{"roadId": "B", "entrances": [{"id": "b"}]}]}]', [(1, 1, "a"), (3, 1, "b")]),
        ('{"roads": [{"roadId": "A", "segments": [{"segments": [{"entrances": [{"id": "a"}]}, {"segments": [{"segments": [{"entrances": [null, {"id": "b"}]}]}], "entrances": [{"id": "c"}]}]}, {"entrances": [{"id": "d"}]}]}]}', [(1, 1, "a"), (1, 3, "b"), (1, 4, "c"), (1, 5, "d")]),
        ('{"roads": null, "cards": null}', []),
        ("<html></html>", []),
        ("", []),
        ("null", []),
        ("3", []),
        (None, []),
        ('{"roads": [{"roadId": "A", "entrances": null}, {"roadId": "B"}, {"roadId": "C", "entrances": []}, {"roadId": "D", "entrances": {}}]}', []),
    ],
)
def test_entrance_shapes(spark, payload, expected):
    assert found(spark, payload) == expected


@pytest.mark.parametrize(
    ("payload", "expected"),
    [
        ('[{"id": "A", "sources": ["u1", {"url": "u2"}, {"url": {"href": "u3"}}, {"url": null}, null, {"url": ""}]}]', [(1, 1, "u1"), (1, 2, "u2"), (1, 3, "u3")]),
        ('{"cards": [{"id": "A", "sources": {"items": [{"url": "a"}, {"url": "b"}]}}]}', [(1, 1, "a"), (1, 2, "b")]),
        ('{"cards": [{"id": "A", "sources": {"title": "t", "url": "a", "note": null}}]}', [(1, 1, "a")]),
        (json.dumps({"page": 1, "data": {"cards": [{"id": "A", "sources": json.dumps([{"url": "a"}])}]}}), [(1, 1, "a")]),
        ('{"id": "A", "sources": "https://x.example/a"}', [(1, 1, "https://x.example/a")]),
    ],
)
def test_source_shapes(spark, payload, expected):
    assert found(spark, payload, "karte") == expected


def test_roads_beside_cards(spark):
    payload = '{"meta": {"n": 2}, "roads": [{"roadId": "A", "entrances": [{"id": "a"}]}], "cards": [{"id": "C", "sources": [{"url": "u"}]}]}'
    df = raw(spark, payload)
    assert rows(nested.raw_roads(df), "road_pos", "kind", "record_key") == [(1, "nagano_entrances", "A"), (2, "karte", "C")]
    assert found(spark, payload) == [(1, 1, "a")]
    assert found(spark, payload, "karte") == [(2, 1, "u")]


def test_long_text_and_many_children(spark):
    many = [{"id": f"E{k}", "description": "長" * 2000} for k in range(500)]
    payload = json.dumps({"roads": [{"roadId": "A", "entrances": many}]}, ensure_ascii=False)
    assert len(found(spark, payload)) == 500


def test_typed_tables(spark):
    data = [(1, "R", [None, {"id": "E1"}, {"id": ""}], 9), (2, None, None, 9), (3, "R", [], 9), (3, "R", [{"id": "E1"}], 9)]
    df = spark.createDataFrame(data, f"record_no long, roadId string, entrances array<{ENTRANCE}>, child_pos int")
    assert rows(nested.table_entrances(df).filter("child_key IS NOT NULL"), "record_no", "child_pos", "child_key") == [(1, 2, "E1"), (3, 1, "E1")]
    assert nested.table_entrances(df.limit(0)).count() == 0


def test_children_point_to_parents(spark, small):
    roads = nested.all_roads(load(spark, small, "nagano_entrances"), load(spark, small, "raw_records"))
    children = nested.all_entrances(load(spark, small, "nagano_entrances"), load(spark, small, "raw_records"))
    assert children.join(roads, ["src", "record_no", "road_pos"], "left_anti").count() == 0
    assert roads.count() == roads.select("src", "record_no", "road_pos").distinct().count()


def _kids(v):
    if v is None:
        return []
    if isinstance(v, str):
        try:
            return _kids(json.loads(v))
        except ValueError:
            return [(None, v)]
    if isinstance(v, list):
        return [(None, x) for x in v]
    if "items" in v:
        return _kids(v["items"])
    if v and all(x is None or isinstance(x, dict) for x in v.values()):
        return list(v.items())
    return [(None, v)]


def _records(v):
    while isinstance(v, str):
        v = json.loads(v)
    if v is None or isinstance(v, list):
        return v or []
    for name in ("roads", "cards", "data", "result"):
        if name in v:
            return _records(v[name])
    return [v] if {"roadId", "id", "entrances"} & set(v) else list(v.values())


def test_like_a_plain_walk(spark, small):
    expected = []
    for r in load(spark, small, "raw_records").collect():
        try:
            records = _records(json.loads(r.payload))
        except (ValueError, TypeError):
            continue
        for i, x in enumerate(records, 1):
            entrances = []
            for name, v in (x or {}).items():
                if name == "entrances":
                    entrances += _kids(v)
                if name == "segments":
                    for s in v or []:
                        entrances += _kids(s.get("entrances"))
            for j, (name, e) in enumerate(entrances, 1):
                key = e and ((e.get("id") or "").strip() or name)
                if key:
                    expected.append((r.raw_no, i, j, key))
            for j, (_, s) in enumerate(_kids((x or {}).get("sources")), 1):
                url = s if isinstance(s, str) else (s or {}).get("url")
                url = url.get("href") if isinstance(url, dict) else url
                if url and url.strip():
                    expected.append((r.raw_no, i, j, url))
    got = nested.keyed_children(load(spark, small, "nagano_entrances"), load(spark, small, "karte"), load(spark, small, "raw_records")).filter("src = 'raw_records'")
    assert Counter(rows(got, "record_no", "road_pos", "child_pos", "child_key")) == Counter(expected)
