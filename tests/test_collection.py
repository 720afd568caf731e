"""From blocks to cited answers, through the store and its index; string ids all the way."""

import pytest
from lodestone.functions import models
from lodestone.operators import chunking, lexical
from lodestone.operators.inverted import InvertedIndex
from lodestone.operators.store import TableStore
from lodestone.plans import ingest, retrieve
from lodestone.streaming import sync
from pyspark.sql import functions as F


def blocks(spark, **texts):
    rows = [(f"{name}.pdf", k, 1 + k // 3, "text", None, t) for name, parts in texts.items() for k, t in enumerate(parts)]
    return chunking.breadcrumbs(spark.createDataFrame(rows, "source string, ord int, page int, type string, level int, content string"), "ord")


def asked(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "query_id string, text string").withColumn("vector", models.embed(F.col("text"), query=True))


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("collection")
    store, index = TableStore(spark, str(root / "store")), InvertedIndex(spark, str(root / "index"))
    ingest.ingest(store, blocks(spark, pumps=["The pump needs grease every month.", "Valves close by springs.", "Seals wear out and leak."], boats=["Boats have hulls of oak.", "An anchor holds the boat."]), "ord", index=index)
    return root, store, index


def test_ask_and_cite(spark, filled):
    _, store, index = filled
    queries = asked(spark, q1="when does the pump need grease", q2="anchor of the boat")
    found = retrieve.hybrid(store.read(), queries, index=index)
    assert found.schema["id"].dataType.simpleString() == "string"
    best = {r.query_id: r.source for r in retrieve.answer_passages(store.read(), queries, index=index).filter("rank = 1").collect()}
    assert best == {"q1": "pumps.pdf", "q2": "boats.pdf"}
    plain = retrieve.hybrid(store.read(), queries)
    key = lambda df: sorted((r.query_id, r.id, r["rank"], r.score) for r in df.collect())
    assert key(plain) == key(found) == key(retrieve.hybrid(store.read(), queries, index=lexical.build(store.read(), "id", "content")))
    said = {r.query_id: r for r in retrieve.ask(store.read(), queries, index=index).collect()}
    assert said["q1"]["mode"] == "grounded" and said["q1"].citations[0].startswith("[1] pumps.pdf, p. 1")


def test_offline_with_and_without_a_reranker(spark, filled):
    _, store, index = filled
    queries = asked(spark, q1="when does the pump need grease")
    plain = retrieve.offline(store.read(), queries, reranker=False, k=2, index=index).collect()
    first = retrieve.hybrid(store.read(), queries, index=index).filter("rank <= 2").collect()
    assert sorted((r.id, r["rank"]) for r in plain) == sorted((r.id, r["rank"]) for r in first) and len(plain) == 2
    assert retrieve.offline(store.read(), queries, index=index).filter("rank = 1").first().source == "pumps.pdf"


def test_the_index_follows_the_store(spark, filled):
    _, store, index = filled
    queries, find = asked(spark, q="anchor grease rudder"), lambda: {(r.id, r.score) for r in index.search(asked(spark, q="anchor grease rudder"), 10).collect()}
    same = lambda: {(r.id, r.score) for r in lexical.search(lexical.build(store.read(), "id", "content"), queries, 10, "id", "query_id").collect()}
    segments = index.version().segments
    ingest.ingest(store, blocks(spark, rudder=["A rudder steers.", "Rudder and anchor."]), "ord", index=index)
    assert index.version().segments[:1] == segments and len(index.version().segments) == 2 and index.version().of == store.version()
    assert find() == same()
    ingest.ingest(store, blocks(spark, boats=["No such word here."]), "ord", index=index)
    assert len(index.version().segments) == 1 and find() == same()
    at = index.version().version
    assert index.follow(store) == at


def test_replica_and_its_index(spark, filled, tmp_path):
    _, store, _ = filled
    local, index = TableStore(spark, str(tmp_path / "local")), InvertedIndex(spark, str(tmp_path / "index"))
    sync.replicate_once(store, local, index=index)
    assert index.version().of == local.version() == 1
    store.delete_by_source("pumps.pdf")
    # A run that was lost between the table and the index: the next one, which has nothing to pull, makes up for it.
    assert sync.replicate_once(store, local)["vectors_deleted"] > 0 and index.version().of < local.version()
    assert sync.replicate_once(store, local, index=index) == {"vectors_added": 0, "vectors_deleted": 0}
    assert index.version().of == local.version() and index.search(asked(spark, q="pump grease"), 5).count() == 0
