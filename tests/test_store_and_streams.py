"""The versioned store, file sources, and streams."""

import json

import pytest
from lodestone.operators.store import TableStore
from lodestone.sources import files, html_tables
from lodestone.streaming import sync
from pyspark.sql import functions as F


def points(spark, *rows):
    return spark.createDataFrame([(i, [1.0, 0.0], s, c) for i, s, c in rows], "id string, vector array<float>, source string, content string")


def test_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "local"))
    assert store.version() == 0 and store.count() == 0
    assert store.upsert(points(spark, ("1", "a", "x"), ("2", "a", "y"), ("3", "b", "z"))) == 1
    store.upsert(points(spark, ("2", "a", "new"), ("4", None, "w")))
    assert {r.id: r.content for r in store.read().collect()} == {"1": "x", "2": "new", "3": "z", "4": "w"}
    assert {r.id: r.content for r in store.read(1).collect()}["2"] == "y"
    assert store.delete_by_source("a") == 2 and store.delete_by_source("a' OR '1'='1") == 0 and store.count() == 2
    assert store.delete_by_ids(points(spark, ("3", "b", ""), ("9", "b", ""))) == 1
    assert [r.id for r in store.get(points(spark, ("4", "", ""))).collect()] == ["4"] and store.all_ids("source").columns == ["id", "source"]
    store.reset()
    assert store.count() == 0


def test_replication_on_a_stream(spark, tmp_path):
    cloud, local = TableStore(spark, str(tmp_path / "cloud")), TableStore(spark, str(tmp_path / "local"))
    cloud.upsert(points(spark, ("1", "a", "x"), ("2", "a", "y")))
    local.upsert(points(spark, ("2", "a", "y"), ("3", "b", "z")))
    spark.range(1).write.json(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("id bigint").json(str(tmp_path / "ticks"))
    sync.replicate_on(ticks, cloud, local, str(tmp_path / "state"), once=True).awaitTermination(60)
    assert sorted(r.id for r in local.read().collect()) == ["1", "2"]
    assert sync.replicate_once(cloud, local) == {"vectors_added": 0, "vectors_deleted": 0} and local.version() == 2


def test_transitions(spark, tmp_path):
    rows = [("a", i, bool(x)) for i, x in enumerate([1, 0, 0, 1, 1, 0, 1])] + [("b", 0, True), ("b", 1, True)]
    states = spark.createDataFrame(rows, "k string, n int, online boolean").withColumn("t", F.timestamp_seconds("n"))
    assert sorted(r.n for r in sync.transitions(states, "k", "t", "online", "n").collect()) == [3, 6]
    states.coalesce(1).write.parquet(str(tmp_path / "states"))
    stream = spark.readStream.schema(states.schema).parquet(str(tmp_path / "states"))
    query = sync.transition_stream(stream, "k", "t", "online").writeStream.format("memory").queryName("came_online").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s")).start()
    query.awaitTermination(120)
    assert sorted(r.n for r in spark.table("came_online").select(F.unix_seconds("time").alias("n")).collect()) == [3, 6]


def test_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.PDF").write_bytes(b"one\ntwo")
    (folder / "bad.pdf").write_bytes(b"bad")
    (folder / "c.txt").write_bytes(b"x")

    def parser(content):
        if content == b"bad":
            raise ValueError("no page")
        return [{"content": line, "page": 1} for line in content.decode().split("\n")]

    found = files.binary_files(spark, str(folder))
    good, rest = files.accepted(found, ".pdf")
    assert sorted(r.source for r in good.collect()) == ["a.PDF", "bad.pdf"] and [r.source for r in rest.collect()] == ["c.txt"]
    with pytest.raises(LookupError):
        files.parse(good, ".pdf")
    files.register_parser(".pdf", parser, "content string, page int")
    rows, failed = files.parse(good, ".pdf")
    assert sorted((r.source, r.ord, r.content, r.page) for r in rows.collect()) == [("a.PDF", 0, "one", 1), ("a.PDF", 1, "two", 1)]
    assert [(r.source, r.error) for r in failed.collect()] == [("bad.pdf", "ValueError: no page")]


def test_small_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"docs": [{"filename": "a", "sha256": "1", "url": "u"}, {"filename": "b", "sha256": "2", "url": "v"}]}))
    assert [(r.ord, r.filename, r.url) for r in files.manifest(spark, str(tmp_path / "m.json")).orderBy("ord").collect()] == [(0, "a", "u"), (1, "b", "v")]
    (tmp_path / "h.json").write_text('{"aa": "x.pdf"}')
    assert files.hashes(spark, str(tmp_path / "h.json")).collect() == [("aa", "x.pdf")]
    (tmp_path / "t.csv").write_text('a,b\n1,"x, y"\n2,\n')
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "t.csv")).orderBy("a").collect()] == [(1, "x, y"), (2, None)]
    images = spark.createDataFrame([("s", 1, 4999, "t", "p"), ("s", 1, 5000, "a\nb", "p"), ("s", 2, 6000, None, "p")], "source string, page int, size int, page_text string, image_path string")
    assert sorted(r.content for r in files.image_blocks(images).collect()) == ["Image on page 2", "a b"]
    assert files.ocr_chunks(spark.createDataFrame([("x" * 19,), ("x" * 20,)], "content string")).count() == 1


def test_html_tables(spark):
    page = "<table><tr><th>A<th>B</tr><tr><td>1<td>2 <b>x</b></table><table></table><p>x</p><table><td>alone</table>"
    assert html_tables.tables_in(page) == [[["A", "B"], ["1", "2 x"]], [], [["alone"]]]
    got = html_tables.tables(spark.createDataFrame([("p", page), ("q", None)], "s string, h string"), "s", "h").orderBy("source").collect()
    assert [(r.source, r.rows) for r in got] == [("p::table_0", [["A", "B"], ["1", "2 x"]]), ("p::table_2", [["alone"]])]
