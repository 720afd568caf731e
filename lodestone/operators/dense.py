"""Exact cosine top-k of a query set against all vectors, in blocks.

A query set of bounded size goes to every task, and points stream past it where they are read. A larger one meets the points in a join of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import batches as held
from lodestone.operators import ranking

QUERY_BLOCK, POINT_BLOCK = 1024, 4096
#: Queries that every task may hold (their vectors, in double precision, are some 3 MB a thousand at 384 dimensions).
MOST_QUERIES = 4096
#: Scores made at a time.
SCORES = 1 << 22


def _blocks(df: DataFrame, key: str, vector: str, name: str, each: int) -> tuple[DataFrame, int]:
    """Rows gathered to blocks of about ``each``, with how many there are."""
    n = max(1, -(-df.count() // each))
    block = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    rows = df.filter(F.col(vector).isNotNull()).groupBy(block.alias(name)).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).alias("v"))).alias(f"{name}_rows"))
    return rows, n


def unit(ids: pa.Array, vectors: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Ids, and vectors scaled to length 1 as rows; one without length stays."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    size = np.linalg.norm(flat, axis=1, keepdims=True)
    return ids, np.divide(flat, size, out=np.zeros_like(flat), where=size > 0)


def _met(k: int):
    """The best of pairs of blocks."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (query, q), (point, p) = (unit(rows.field("id"), rows.field("v")) for rows in (batch.column(c)[i].values for c in ("q_rows", "p_rows")))
                yield ranking.Best(query, k).candidates(point, q @ p.T)
        held.give_back()

    return met


def _passed(query: pa.Array, q: np.ndarray, k: int):
    """The best of the points that pass by."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, each = ranking.Best(query, k), max(1, SCORES // len(query))
        for batch in batches:
            point, p = unit(batch.column("id"), batch.column("v"))
            for a in range(0, len(point), each):
                yield best.candidates(point.slice(a, each), q @ p[a : a + each].T)
        held.give_back()

    return passed


def top_k(points: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str | None = None, most_queries: int = MOST_QUERIES) -> DataFrame:
    """``query_id, vec_id, score, rank``: each query's ``k`` points of highest cosine, ties by id.

    Filter ``points`` beforehand for a filtered search. Up to ``most_queries`` queries are sent to all tasks, which return the candidates of
    their points; more are dealt to blocks that meet blocks of points in one matrix product each. Rows without a vector are no candidates.
    """
    held.bounded(points.sparkSession)
    plain = lambda df, id_: df.filter(F.col(vector).isNotNull()).select(F.col(id_).alias("id"), F.col(vector).alias("v"))
    schema = ranking.candidates(*(df.schema[c].dataType.simpleString() for df, c in ((queries, query_key or key), (points, key))))
    asked = plain(queries, query_key or key).limit(most_queries + 1).toArrow().combine_chunks()
    if asked.num_rows <= most_queries:
        if not asked.num_rows:
            return ranking.ranked(points.sparkSession.createDataFrame([], schema), k, "query_id", key)
        query, q = unit(*(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (asked.column("id"), asked.column("v"))))
        found = plain(points, key).mapInArrow(_passed(query, q, k), schema)
    else:
        blocks, n = _blocks(queries, query_key or key, vector, "q", QUERY_BLOCK)
        rows, _ = _blocks(points, key, vector, "p", POINT_BLOCK)
        pairs = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(blocks, "q").select("q_rows", "p_rows")
        found = pairs.mapInArrow(_met(k), schema)
    return ranking.ranked(found, k, "query_id", key)
