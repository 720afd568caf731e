"""The vector index: recall against exact search, what it reads, exact mode, appends."""

import numpy as np
import pytest
from lodestone.operators import cells, dense
from lodestone.operators.cells import VectorIndex
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(60, 24))
    rows = [(i, (centres[draw.integers(60)] + 0.4 * draw.normal(size=24)).tolist()) for i in range(4000)]
    rows += [(5000 + i, centres[0].tolist()) for i in range(300)] + [(6000, None), (6001, [0.0] * 24)]
    return spark.createDataFrame(rows, "id bigint, vector array<float>").repartition(4)


@pytest.fixture(scope="module")
def index(spark, points, tmp_path_factory):
    index = VectorIndex(spark, str(tmp_path_factory.mktemp("cells")))
    index.build(points)
    return index


def asked(points, every=20):
    return points.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vector")


def rows(df):
    return sorted(map(tuple, df.collect()))


def exact(points, queries, k):
    return rows(dense.top_k(points, queries, k, "id", "vector", "query_id"))


def test_recall_and_bytes(points, index):
    queries = asked(points)
    true, found = exact(points, queries, 10), rows(index.search(queries, 10, "id"))
    # A point of the same score is as good.
    least = {q: min(s for a, _, s, _ in true if a == q) for q, *_ in true}
    assert sum(s >= least[q] for q, _, s, _ in found) / len(true) >= 0.9
    one = queries.limit(1)
    read, all_ = index.bytes_read(index.probed(one)), index.bytes_read()
    assert 0 < read < 0.5 * all_
    plan = index.search(one, 10, "id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan


def test_more_probes_find_more_and_all_find_all(points, index):
    queries, true = asked(points, 50), set(exact(points, asked(points, 50), 10))
    shares = [len(true & set(rows(index.search(queries, 10, "id", probes=p)))) for p in (1, 8, 10**6)]
    assert shares[0] <= shares[1] <= shares[2] == len(true)
    assert set(rows(index.search(queries, 10, "id", exact=True))) == true
    assert set(rows(index.search(queries, 10, "id", exact=True, most_queries=20))) == true


def test_every_vector_is_filed_once(points, index):
    filed = index.vectors(index.version())
    assert sorted(r.id for r in filed.collect()) == sorted(r.id for r in points.filter("vector IS NOT NULL").collect())


def test_append(spark, points, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "v"))
    assert index.search(asked(points), 5, "id").count() == 0
    index.append(points.filter("id < 2000"))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    index.append(points.filter("id >= 2000"))
    assert {p: p.stat().st_mtime_ns for p in before} == before and index.version().version == 2
    assert rows(index.search(asked(points, 100), 7, "id", exact=True)) == exact(points, asked(points, 100), 7)


def test_edges(spark, points, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(points.filter("false"))
    assert index.search(asked(points), 5, "id").count() == 0 and index.probed(asked(points)) == []
    same = spark.createDataFrame([(f"p{i}", [1.0, 0.0], 7) for i in range(50)], "id string, vector array<float>, cell int")
    index.build(same)
    found = index.search(same.limit(1).select(F.lit("q").alias("query_id"), "vector"), 3, "id")
    assert rows(found) == [("q", "p0", 1.0, 1), ("q", "p1", 1.0, 2), ("q", "p10", 1.0, 3)]
    assert index.search(same.filter("false").select(F.lit("q").alias("query_id"), "vector"), 3, "id").count() == 0


def test_training():
    draw = np.random.default_rng(1)
    sample = draw.normal(size=(500, 8))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    centroids = cells.trained(sample, 20)
    assert centroids.shape == (20, 8) and np.allclose(np.linalg.norm(centroids, axis=1), 1)
    assert (cells.nearest(sample, centroids, 3)[:, 0] == (sample @ centroids.T).argmax(axis=1)).all()
    assert 1 <= cells.enough_probes(sample, centroids) <= 20


def test_recall_of_the_query(spark, sf_dir):
    from lodestone.plans import queries

    true = {(r.query_id, r.vec_id) for r in queries.dense_topk(spark, sf_dir).collect()}
    found = {(r.query_id, r.vec_id) for r in queries.dense_cells(spark, sf_dir).collect()}
    assert len(true & found) >= 0.9 * len(true)
