"""What Python workers hold and what searches return from them, in batches of bounded size."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import models
from lodestone.operators import dense, lexical, ranking


def test_best_learns_from_batches_smaller_than_k():
    """Batches of 10 points and hits, of which 60 are asked for: all that is among the best comes, and few others."""
    draw = np.random.default_rng(1)
    scores = draw.random((5, 20_000))
    dense, sparse = ranking.Best(pa.array(range(5)), 60), ranking.Best(pa.array(range(5)), 60)
    for kind in ("dense", "hits"):
        found = []
        for a in range(0, scores.shape[1], 10):
            points, part = pa.array(range(a, a + 10)), scores[:, a : a + 10]
            query, point = (x.ravel() for x in np.indices(part.shape))
            found.append(dense.candidates(points, part) if kind == "dense" else sparse.hits(points, query, point, part.ravel()))
        rows = pa.Table.from_batches(found)
        assert rows.num_rows < 20_000
        for q in range(5):
            mine = rows.filter(pa.compute.equal(rows.column("query"), q)).column("point").to_numpy()
            assert set(np.argsort(-scores[q])[:60].tolist()) <= set(mine.tolist())


def test_batches_of_texts_are_bounded_by_bytes(spark):
    """2,000 texts of 20,000 characters in one partition: no model gets them all at once."""
    models.register_embedder("sizes", lambda: lambda texts: np.array([[1, len(texts)]] * len(texts), np.float32), batch=1 << 30)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(2000).coalesce(1).select("id", F.expr("repeat('some word', 2222)").alias("content"))
    v = docs.select(models.embed(F.col("content"), "sizes").alias("v")).select((F.col("v")[1] / F.col("v")[0]).alias("n"))
    assert v.count() == 2000 and v.agg(F.max("n")).first()[0] < 500


def test_searches_bound_their_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(i, f"apple {i} pear") for i in range(30)], "doc_id bigint, text string")
    found = lexical.bm25(docs, spark.createDataFrame([(1, "apple pear")], "item_id bigint, text string"), 3)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    assert [r.doc_id for r in found.orderBy("rank").collect()] == [0, 1, 2]


def test_dense_search_bounds_its_batches(spark):
    """By itself, where no embedder has set a bound before it."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    points = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    found = dense.top_k(points, points.filter("vec_id = 3"), 2)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    assert [r.vec_id for r in found.orderBy("rank").collect()] == [3, 4]
