"""Ingest, removal, routing and conditional export."""

import pytest
from lodestone.operators import chunking
from lodestone.operators.store import TableStore
from lodestone.plans import ingest
from lodestone.sources.html_tables import tables_in


def blocks(spark, *rows):
    table = spark.createDataFrame([(s, i, 1, "text", None, t) for i, (s, t) in enumerate(rows)], "source string, ord int, page int, type string, level int, content string")
    return chunking.breadcrumbs(table, "ord")


def test_ingest(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    urls = spark.createDataFrame([("a.pdf", "http://x/a.pdf")], "source string, source_url string")
    first = ingest.ingest(store, blocks(spark, ("a.pdf", "words " * 200), ("b.pdf", "other text")), "ord", urls=urls)
    assert first["files"] == 2 and first["total_chunks"] >= 4 and first["version"] == 1
    rows = {r.id: r for r in store.read().collect()}
    assert {r.source_url for r in rows.values()} == {"http://x/a.pdf", None} and all(len(r.vector) == 64 for r in rows.values())
    ingest.ingest(store, blocks(spark, ("a.pdf", "words " * 200), ("b.pdf", "other text")), "ord", urls=urls)
    assert {r.id for r in store.read().collect()} == set(rows)
    ingest.ingest(store, blocks(spark, ("b.pdf", "changed")), "ord")
    assert [r.content for r in store.read().filter("source = 'b.pdf'").collect()] == ["changed"]
    etag, page = ingest.export_unless_same(store, None, 0, 2)
    assert page.count() == 2 and page.first().has_more
    assert ingest.export_unless_same(store, etag, 0, 2) == (etag, None) and ingest.export_unless_same(store, etag, 0, 5, "b.pdf")[1].count() == 1
    assert ingest.delete_file({"local": store}, "b.pdf") == {"local": 1}
    with pytest.raises(LookupError):
        ingest.delete_file({"local": store}, "b.pdf")
    with pytest.raises(ValueError):
        ingest.delete_file({"local": store}, "")
    assert ingest.route(None, store, True) is store


def test_uploads(spark):
    files = spark.createDataFrame([("a", "1", 0), ("a", "2", 1), ("b", "2", 2), ("c", "3", 3)], "source string, sha256 string, ord int")
    assert sorted((r.source, r.sha256) for r in ingest.latest_uploads(files).collect()) == [("a", "2"), ("c", "3")]


def test_broken_tables():
    assert tables_in("<table><tr><td>a") == [[["a"]]] or tables_in("<table><tr><td>a") == [[[]]]
