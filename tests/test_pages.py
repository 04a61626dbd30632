"""Documents behind addresses: encodings, fetching, chunks; links of pages."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from waymark.functions import names, web
from waymark.operators import graph, quality, rank
from waymark.sources import files, pages, sinks


@pytest.mark.parametrize(
    ("content", "header", "text"),
    [
        ("林道".encode(), None, "林道"),
        ("林道①".encode("cp932"), None, "林道①"),
        ("林道".encode("shift_jis"), "text/html; charset=Shift_JIS", "林道"),
        ("林道".encode("euc_jp"), 'text/html; charset="euc-jp"', "林道"),
        (b'<meta charset="euc-jp">' + "林道".encode("euc_jp"), "text/html", '<meta charset="euc-jp">林道'),
        ("林道".encode(), "text/html; charset=no-such", "林道"),
        (b"a\x81", None, "a\ufffd"),
        (b"", None, ""),
    ],
)
def test_encodings(content, header, text):
    assert pages.decoded_bytes(content, header) == text


def test_fetch_texts_and_cache(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<html><p>林道&amp;道</p><script>x</script></html>".encode("cp932"))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "big.txt").write_bytes(b"x" * 200)
    base = tmp_path.as_uri()
    wanted = spark.createDataFrame([(f"{base}/a.html",), (f"{base}/b.pdf",), (f"{base}/big.txt",), (f"{base}/gone",), ("no address",), (None,), (f"{base}/a.html",)], "url string")
    got = pages.fetched(pages.still_wanted(wanted, spark.createDataFrame([], "key string")), most_bytes=100, attempts=1).cache()
    assert got.count() == 5
    errors = {r.url.rsplit("/", 1)[-1]: r.error for r in got.filter("error IS NOT NULL").collect()}
    assert set(errors) == {"big.txt", "gone", "no address"}
    assert "100 bytes" in errors["big.txt"]
    texts = pages.document_texts(got.filter("error IS NULL"))
    assert rows(texts, "kind", "text") == [("html", "林道&道"), ("pdf", None)]
    cache = got.select(F.sha2("url", 256).alias("key"))
    assert pages.still_wanted(wanted, cache).count() == 0
    mirrored = pages.fetched(spark.createDataFrame([("x://one/a.html",)], "url string"), ["x://one", base], attempts=1)
    assert mirrored.first().error is None
    assert pages.document_texts(got.limit(0)).count() == 0


def test_chunks_tiles_and_first_rows(spark):
    ids = spark.createDataFrame([(k % 7,) for k in range(20)] + [(None,)], "id long")
    assert rows(pages.in_chunks(ids, "id", 3)) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 2)]
    assert pages.tiles((0.0, 0.0, 2.0, 4.0)) == [(0.0, 0.0, 1.0, 2.0), (0.0, 2.0, 1.0, 4.0), (1.0, 0.0, 2.0, 2.0), (1.0, 2.0, 2.0, 4.0)]
    assert "way[highway](0.0,1.0,2.0,3.0);" in pages.way_query((0.0, 1.0, 2.0, 3.0), ["[highway]"])
    tile = lambda *r: spark.createDataFrame(list(r), "id int, v string")
    assert rows(files.tiles_union([tile((1, "a"), (2, "b")), tile((2, "c"), (3, "d"))], "id"), "id", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(files.first_rows(ids.filter("id IS NOT NULL"), "id", 2)) == [(0,), (0,)]
    assert files.exactly_one(ids.filter("id IS NULL")).count() == 1
    for wrong in (ids, ids.limit(0)):
        with pytest.raises(ValueError, match="exactly one"):
            files.exactly_one(wrong)


def test_links(spark):
    page = '<li><a href="/own">o</a></li><li>x <a class="a" href="https://a.example/p#1">t</a></li><li><a href="https://a.example/p#2">t</a></li><li>none</li>'
    assert spark.range(1).select(web.result_links(F.lit(page))).first()[0] == ["https://a.example/p"]
    catalog = "<h2>A <b>市</b></h2><table><tr><th>n</th></tr><tr><td>x</td><td><a href='n'></a><a href=\"1.pdf\">P</a></td></tr></table><h2>B</h2><ul><li><a href=\"2.pdf\">y</a></li></ul>"
    assert [tuple(r) for r in spark.range(1).select(web.catalog_rows(F.lit(catalog))).first()[0]] == [("A 市", "x P", "1.pdf"), ("B", "y", "2.pdf")]
    docs = spark.createDataFrame([(1, "https://h.example/d/i.html", '<a href="../p.PDF#x">林道</a><a href="?q=.pdf">林道</a><a href="p.pdf">予算</a><a href="http://[bad/p.pdf">林道</a>'), (2, None, None), (3, "https://h.example", "")], "k int, url string, page string")
    assert rows(web.document_links(docs, "k", "url", "page", "林道"), "k", "position", "url") == [(1, 0, "https://h.example/p.PDF")]
    assert spark.range(1).select(web.encoded(F.lit("a b*~林"))).first()[0] == "a%20b%2A~%E6%9E%97"


def test_names_cells_and_preferences(spark):
    df = spark.createDataFrame([("改良（林道山線ほか）",), ("林道 川線",), ("橋",), ("林道点検診断",), (None,)], "t string")
    got = [r.p and tuple(r.p) for r in df.select(names.bracketed_name(F.col("t"), reject="点検診断").alias("p")).collect()]
    assert got == [("山線", True), ("川線", False), None, None, None]
    assert spark.range(1).select(names.first_contained(F.lit("bca"), ["c", "a"], "x"), names.first_contained(F.lit(None).cast("string"), ["c"], "x")).first()[:] == ("c", "x")
    cells = spark.createDataFrame([("山線・川線\r\n橋・川線\n\n線・川線",), (None,), ("",)], "t string")
    assert [r[0] for r in cells.select(files.split_compound(F.col("t"), "線")).collect()] == [["山線", "川線", "橋・川線", "線・川線"], None, []]
    hits = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 25.0), ("a", 3, 30.0), ("b", 1, 5.0), ("b", 2, 9.0), ("c", 1, None)], "k string, n int, s double")
    assert rows(rank.first_reaching(hits, ["k"], F.col("s"), 20, F.col("n")), "k", "n") == [("a", 2), ("b", 2), ("c", 1)]
    assert rows(rank.first_preferred(hits, ["k"], F.col("s") > 8, F.col("n")), "k", "n") == [("a", 2), ("b", 2), ("c", 1)]


def test_exports_and_caps(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", 2)], "k string, v int")
    sinks.write_document(df, str(tmp_path / "d"), F.col("k"))
    text = "\n".join(line for part in sorted((tmp_path / "d").glob("*.txt")) for line in part.read_text().splitlines())
    assert text == '[\n{"k":"a","v":2},\n{"k":"b","v":null}\n]'
    assert rows(sinks.with_errors_kept(df, spark.createDataFrame([("a", 9), ("c", None)], "k string, v int"), "k")) == [("a", 9), ("b", None), ("c", None)]
    bad = spark.createDataFrame([("r", str(k)) for k in range(5)], "rule string, key string")
    assert rows(quality.capped(bad, 3)) == [("more", "2"), ("r", "0"), ("r", "1"), ("r", "2")]
    assert quality.capped(bad, 5).count() == 5
    assert rows(quality.required(df, ["k", "x"])) == [("column x is missing", "x")]
    assert quality.too_few(df, F.col("v") > 0, 1, "r").count() == 0


def test_shared_edges_give_the_components_of_all_pairs(spark):
    members = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (3, "y"), (4, "y"), (5, "z"), (5, "z")], "v long, node string")
    edges = graph.shared_edges(members, "node")
    assert rows(edges) == [(2, 1), (3, 1), (4, 3)]
    assert rows(graph.components(members.select("v"), edges), "v", "component") == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)]
