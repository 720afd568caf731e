"""The best candidates of each query as batches of points pass by, for searches that score a batch against a block of queries.

Ids of queries and points may be of any type that orders; they are carried as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores that agree to so many places are equal, and ordered by id.
PLACES = 9
_EQUAL = 2 * 10.0**-PLACES
#: Scores that a task remembers of all its batches, about.
REMEMBERED = 1 << 20


def candidates(query_type: str, point_type: str) -> str:
    """The schema of candidates."""
    return f"query {query_type}, point {point_type}, score double"


class Best:
    """Keeps, of each batch's scores, those that may be among the ``k`` best of what a task has seen."""

    def __init__(self, queries: pa.Array, k: int):
        self.queries, self.k = queries, k
        self.reach = np.full(len(queries), -np.inf)
        self._query, self._score, self._due = np.zeros(0, np.int64), np.zeros(0), 0

    def _seen(self, query: np.ndarray, score: np.ndarray) -> None:
        """Raises ``reach`` to the ``k``-th best of all batches, also where no batch has ``k`` of a query by itself. Each query and point comes once."""
        if len(self.queries) * self.k > REMEMBERED:
            return
        self._query, self._score = np.concatenate([self._query, query]), np.concatenate([self._score, score])
        if len(self._query) < self._due:
            return
        order = np.lexsort((-self._score, self._query))
        query, score = self._query[order], self._score[order]
        first = np.searchsorted(query, np.arange(len(self.queries) + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.reach[full] = np.maximum(self.reach[full], score[first[full] + self.k - 1])
        best = np.arange(len(query)) - first[query] < self.k
        self._query, self._score = query[best], score[best]
        self._due = 2 * len(self._query) + 4096

    def _rows(self, points: pa.Array, query: np.ndarray, point: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.queries.take(pa.array(query)), points.take(pa.array(point)), pa.array(score)], ["query", "point", "score"])

    def candidates(self, points: pa.Array, scores: np.ndarray, queries: np.ndarray | None = None) -> pa.RecordBatch:
        """Of scores of all ``points``, a row a query; ``queries`` are the rows' numbers if they are not all."""
        queries = np.arange(len(self.queries)) if queries is None else queries
        if scores.shape[1] >= self.k:
            self.reach[queries] = np.maximum(self.reach[queries], np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
        # Equal scores at the cut all stay, for the ranking by id to come.
        row, column = np.nonzero(scores >= self.reach[queries][:, None] - _EQUAL)
        query, score = queries[row], scores[row, column]
        self._seen(query, score)
        some = np.flatnonzero(score >= self.reach[query] - _EQUAL)
        return self._rows(points, query[some], column[some], score[some])

    def hits(self, points: pa.Array, query: np.ndarray, point: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        """Of what each hit adds to the score of its query and point; only points of positive score are candidates."""
        cell = query.astype(np.int64) * len(points) + point
        cell, at = np.unique(cell, return_inverse=True)
        score = np.bincount(at, part, minlength=len(cell))
        some = np.flatnonzero(score > 0)
        query, point, score = cell[some] // max(1, len(points)), cell[some] % max(1, len(points)), score[some]
        order = np.lexsort((-score, query))
        first = np.searchsorted(query, np.arange(len(self.queries) + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.reach[full] = np.maximum(self.reach[full], score[order[first[full] + self.k - 1]])
        some = np.flatnonzero(score >= self.reach[query] - _EQUAL)
        query, point, score = query[some], point[some], score[some]
        self._seen(query, score)
        some = np.flatnonzero(score >= self.reach[query] - _EQUAL)
        return self._rows(points, query[some], point[some], score[some])


def ranked(found: DataFrame, k: int, query_key: str, point_key: str) -> DataFrame:
    """``query_key, point_key, score, rank`` of the ``k`` best candidates of each query, ties by id."""
    order = Window.partitionBy("query").orderBy(F.round("score", PLACES).desc(), "point")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select(F.col("query").alias(query_key), F.col("point").alias(point_key), F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))
