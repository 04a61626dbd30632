"""Sources, sinks and the stream of records, by round trips."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from waymark.sources import files, sinks
from waymark.streaming import records


def test_csv_with_mark(spark, tmp_path):
    df = spark.createDataFrame([("a,\n\"b\"", ["x", "y"], None)], "`名` string, l array<string>, n int")
    sinks.write_csv(df, str(tmp_path / "out"), ["名", "l", "n"])
    parts = [p.read_bytes() for p in (tmp_path / "out").glob("*.csv")]
    assert all(p.startswith(b"\xef\xbb\xbf") for p in parts if p)
    assert any(parts)
    back = files.read_csv(spark, str(tmp_path / "out"), ["名", "l", "missing"])
    assert rows(back) == [('a,\n"b"', "x | y", None)]


def test_envelope_map_and_lines(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"elements": [{"id": 1, "tags": {"name": "a"}}, {"id": 2}]}))
    (tmp_path / "bad.json").write_text("<html>error</html>")
    (tmp_path / "m.json").write_text(json.dumps({"municipalities": {"A": {"lat": 1.5}, "B": {"lat": None}}}))
    element = "struct<id: long, tags: map<string, string>>"
    assert rows(files.read_envelope(spark, str(tmp_path / "e.json"), element).select("id")) == [(1,), (2,)]
    assert files.read_envelope(spark, str(tmp_path / "bad.json"), element).count() == 0
    assert rows(files.read_map(spark, str(tmp_path / "m.json"), "struct<lat: double>", "municipalities")) == [("A", 1.5), ("B", None)]
    lines = spark.createDataFrame([("a", [(36.0, 138.0), (36.1, 138.1)]), ("b", [(36.0, 138.0)])], "id string, points array<struct<lat: double, lon: double>>")
    made = [json.loads(r.feature) for r in sinks.features(lines, ["id"]).collect()]
    assert made[0]["geometry"]["coordinates"][0] == [138.0, 36.0]
    (tmp_path / "r.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": made}))
    assert rows(files.read_lines(spark, str(tmp_path / "r.geojson"), "id: string").select("id", F.size("points").alias("n"))) == [("a", 2)]


def test_optional_and_first(spark, tmp_path):
    gone = files.optional(lambda: spark.read.parquet(str(tmp_path / "gone")), spark, ["a"])
    assert gone.count() == 0
    (tmp_path / "M_2.csv").write_text("a\n")
    (tmp_path / "M_1.csv").write_text("a\n")
    assert files.first_of(spark, str(tmp_path), "M_*.csv").endswith("M_1.csv")
    assert files.first_of(spark, str(tmp_path), "N_*.csv") is None


def test_extracted_tables(spark):
    cells = [["h"] * 3, ["h"] * 3, ["", "林道 西山線", "１"], ["x"]]
    pages = spark.createDataFrame([(1, cells), (2, cells)], "page int, cells array<array<string>>")
    body = files.table_rows(pages, "n", skip=2, least=3)
    assert rows(body, "page", "n", "row") == [(2, 1, ["", "林道西山線", "１"])]
    assert rows(files.anchored(body, "^林道", {"before": -1, "after": 1, "far": 5}), "before", "after", "far") == [("", "１", None)]


def test_versions_and_upsert(spark, tmp_path):
    folder = str(tmp_path / "t")
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, seq int")
    sinks.write_version(old, folder, "1")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 9, 1)], "k string, v int, seq int")
    sinks.write_version(sinks.upserted(sinks.read_version(spark, folder), new, ["k"]), folder, "2")
    assert rows(sinks.read_version(spark, folder), "k", "v") == [("a", 1), ("b", 3), ("c", 9)]
    assert rows(files.new_only(new.select("k").distinct(), old, "k")) == [("c",)]


def test_stream_keeps_the_latest(spark, tmp_path):
    schema = "k string, at timestamp, v int, deleted boolean"
    at = lambda d: datetime(2025, 1, d)
    first = [("a", at(1), 1, False), ("b", at(2), 2, False), ("a", at(3), 3, False)]
    second = [("b", at(4), 0, True), ("a", at(2), 9, False), ("c", at(1), 5, None)]
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for batch in (first, second):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(source)
        query = records.keep_latest(spark.readStream.schema(schema).json(source), table, "k", "at", str(tmp_path / "check"))
        assert query.awaitTermination(120)
    assert rows(records.current(spark, table, schema), "k", "v") == [("a", 3), ("c", 5)]
    # The second batch wrote only the parts that its keys lie in.
    assert len(list((tmp_path / "table" / "version=000000000001").glob("bucket=*"))) <= 3
    assert records.current(spark, str(tmp_path / "none"), schema).count() == 0
    both = spark.createDataFrame(first + second, schema)
    assert rows(records.latest(both, "k", "at"), "k", "v") == [("a", 3), ("c", 5)]


def test_json(spark, tmp_path):
    sinks.write_json(spark.createDataFrame([("a", None)], "k string, v string"), str(tmp_path / "j"))
    lines = [line for part in (tmp_path / "j").glob("*.json") for line in part.read_text().splitlines()]
    assert list(map(json.loads, lines)) == [{"k": "a", "v": None}]


@pytest.mark.parametrize("name", ["missing"])
def test_required_source_fails(spark, name, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(str(tmp_path / name))
