"""Searches give the same whichever way a query set takes, an index can be stored, and the plan answers."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import models
from lodestone.operators import context, dense, lexical
from lodestone.plans import retrieve


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(1)
    words = [f"word{i}" for i in range(60)]
    rows = [(i, None if i == 7 else "" if i == 8 else " ".join(draw.choices(words, k=draw.randint(1, 40)))) for i in range(150)]
    return spark.createDataFrame(rows + [(200 + i, rows[i][1]) for i in range(20)], "doc_id bigint, text string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    draw = random.Random(2)
    return spark.createDataFrame([(i, " ".join(f"word{draw.randint(0, 70)}" for _ in range(draw.randint(1, 6)))) for i in range(30)] + [(90, "the of"), (91, None)], "item_id bigint, text string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_bm25_both_ways(spark, texts, asked, tmp_path, monkeypatch):
    index = lexical.build(texts)
    one = rows(lexical.search(index, asked, 5))
    assert rows(lexical.search(index, asked, 5, most_terms=0)) == one and len(one) > 100
    monkeypatch.setattr(lexical, "HITS", 64)
    assert rows(lexical.search(index, asked, 5)) == one
    index.save(f"{tmp_path}/index")
    assert rows(lexical.search(lexical.Index.load(spark, f"{tmp_path}/index"), asked, 5)) == one
    counted = {(r.doc, t.token): (t.tf, r.dl) for r in index.terms.collect() for t in r.terms}
    assert counted == {(r.doc_id, r.token): (r.tf, r.dl) for r in lexical.postings(texts, "doc_id", "text").collect()}
    assert index.n_docs == 170 and abs(index.avgdl - lexical.corpus_stats(texts, "text").first().avgdl) < 1e-9


def test_bm25_edges(spark, texts, asked):
    assert lexical.bm25(texts.filter("false"), asked, 5).count() == 0
    assert lexical.bm25(texts, asked.filter("item_id >= 90"), 5).count() == 0
    assert lexical.bm25(texts.filter("doc_id IN (7, 8)"), asked, 5).count() == 0


def test_dense_both_ways(spark):
    draw = random.Random(3)
    points = spark.createDataFrame([(i, None if i == 5 else [draw.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(300)], "vec_id bigint, embedding array<float>").repartition(4)
    some = points.filter("vec_id % 9 = 0")
    one = rows(dense.top_k(points, some, 7))
    assert rows(dense.top_k(points, some, 7, most_queries=0)) == one and len(one) == 7 * 34
    assert dense.top_k(points, points.filter("false"), 7).count() == 0 and dense.top_k(points.filter("false"), some, 7).count() == 0


def test_equal_contents_take_one_place(spark, texts):
    chunks = texts.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("s").alias("source"), F.lit(1).alias("page"), F.lit("").alias("heading"), F.lit("").alias("section_path"), F.lit("").alias("parent_id"), F.lit("").alias("parent_content")).withColumn("vector", models.embed(F.col("content")))
    asked = spark.createDataFrame([(1, "word1 word2 word3"), (2, "word5"), (3, " "), (4, "x" * 3000)], "query_id bigint, text string").withColumn("vector", models.embed(F.col("text"), query=True))
    found = retrieve.hybrid(chunks, asked).collect()
    for q in (1, 2):
        own = [r.content for r in found if r.query_id == q]
        assert len(own) == len(set(own)) == 20
    assert sorted(r["rank"] for r in found if r.query_id == 1) == list(range(1, 21))
    index = lexical.build(chunks, "id", "content")
    again = retrieve.hybrid(chunks, asked, index=index)
    assert sorted((r.query_id, r.id, r["rank"]) for r in again.collect()) == sorted((r.query_id, r.id, r["rank"]) for r in found)
    said = {r.query_id: r for r in retrieve.ask(chunks, asked).collect()}
    assert set(said) == {1, 2} and all(r.answer and (r.citations or r["mode"] == "general") for r in said.values())
    assert context.valid_questions(asked).count() == 2 and retrieve.Settings(top_k=3).fetch == 20
