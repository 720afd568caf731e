"""A vector index in a folder that all executors share: lists of vectors by their nearest centroid, of which a search reads a few.

Centroids are learned on the driver from a sample of at most ``SAMPLE`` vectors a centroid; every vector is filed. A query is compared with all centroids
and then, exactly, with the vectors of the nearest ones. How many of them a search probes by default is measured on the sample. With
``exact`` all are probed, and the result is that of ``dense.top_k``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import dense, ranking
from lodestone.operators.commits import Commits
from lodestone.operators.stages import stored

#: Centroids at most (what every task holds: 6 MB at 384 dimensions), and sampled vectors for each.
MOST_CELLS, SAMPLE = 4096, 16
ROUNDS = 8
#: What share of a sampled vector's ten nearest ones the default probes have to find among the sample.
RECALL = 0.97
#: Rows of a shuffle partition.
PART = 500_000


@dataclass(frozen=True)
class Version:
    """Where centroids and vectors are, and how many centroids a search probes."""

    version: int
    centroids: str = ""
    cells: int = 0
    probes: int = 0
    segments: tuple[str, ...] = ()


def trained(sample: np.ndarray, cells: int, seed: int = 1) -> np.ndarray:
    """Centroids of vectors of length 1, by rounds of assignment to the most similar one; a centroid that has none starts anew at a vector."""
    draw = np.random.default_rng(seed)
    different = np.unique(sample, axis=0)
    centroids = different[draw.permutation(len(different))[:cells]]
    for _ in range(ROUNDS):
        cell = nearest(sample, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        none = np.linalg.norm(sums, axis=1) == 0
        sums[none] = different[draw.integers(len(different), size=none.sum())]
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centroids


def nearest(vectors: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The most similar centroids of each vector, best first."""
    out = np.empty((len(vectors), probes), np.int64)
    for a in range(0, len(vectors), 4096):
        scores = vectors[a : a + 4096] @ centroids.T
        some = np.argpartition(-scores, probes - 1, axis=1)[:, :probes]
        order = np.argsort(-np.take_along_axis(scores, some, axis=1), axis=1, kind="stable")
        out[a : a + 4096] = np.take_along_axis(some, order, axis=1)
    return out


def enough_probes(sample: np.ndarray, centroids: np.ndarray, k: int = 10, asked: int = 512) -> int:
    """The least number of probes that finds ``RECALL`` of the nearest vectors of some sampled ones. In the whole table they are nearer still."""
    queries = sample[:: max(1, len(sample) // asked)][:asked]
    ranks = np.argsort(nearest(queries, centroids, len(centroids)), axis=1)
    own = nearest(sample, centroids, 1)[:, 0]
    best = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, : k + 1]
    needed = np.sort(np.take_along_axis(ranks, own[best], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(RECALL * len(needed)))])


class VectorIndex:
    """``root/vectors/<segment>/cell=<c>`` and ``root/centroids/<name>``, with a log of versions that is written last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = Commits(spark, root)

    def version(self, number: int | None = None) -> Version:
        v = self.commits.version() if number is None else number
        return Version(v, **(told := self.commits.read(v)) | {"segments": tuple(told["segments"])}) if v else Version(0)

    def build(self, points: DataFrame, key: str = "id", vector: str = "vector", cells: int | None = None) -> int:
        """A version of ``points`` alone (rows without a vector are left out); ``cells``: about the root of their number by default."""
        base, rows = self.version(), self._plain(points, key, vector)
        n = rows.count()
        cells = min(MOST_CELLS, max(1, int(n**0.5))) if cells is None else cells
        # Rows that a hash picks, about a fifth more than needed; never more than twice as many.
        share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(1.2 * SAMPLE * cells / max(1, n) * (1 << 30))
        table = (rows.filter(share) if n > 2 * SAMPLE * cells else rows).limit(2 * SAMPLE * cells).toArrow().combine_chunks()
        if not table.num_rows:
            return self.commits.commit(base.version + 1, {"centroids": "", "cells": 0, "probes": 0, "segments": []})
        _, sample = dense.unit(*(table.column(c).chunk(0) for c in ("id", "v")))
        centroids = trained(sample, cells)
        name = str(uuid.uuid4())
        self.spark.createDataFrame(pa.table({"cell": pa.array(range(len(centroids))), "v": pa.array(list(centroids))})).coalesce(1).write.parquet(f"{self.root}/centroids/{name}")
        segment = self._filed(rows, centroids, n)
        return self.commits.commit(base.version + 1, {"centroids": name, "cells": len(centroids), "probes": enough_probes(sample, centroids), "segments": [segment]})

    def append(self, points: DataFrame, key: str = "id", vector: str = "vector") -> int:
        """Files more vectors under the centroids that are there; what is filed is not read."""
        base, rows = self.version(), self._plain(points, key, vector)
        if not base.cells:
            return self.build(points, key, vector)
        segment = self._filed(rows, self._centroids(base), rows.count())
        return self.commits.commit(base.version + 1, {"centroids": base.centroids, "cells": base.cells, "probes": base.probes, "segments": [*base.segments, segment]})

    @staticmethod
    def _plain(points: DataFrame, key: str, vector: str) -> DataFrame:
        return points.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v"))

    def _centroids(self, at: Version) -> np.ndarray:
        table = self.spark.read.parquet(f"{self.root}/centroids/{at.centroids}").orderBy("cell").toArrow()
        return np.stack(table.column("v").to_numpy())

    def _filed(self, rows: DataFrame, centroids: np.ndarray, n: int) -> str:
        """A new segment. A cell of very many vectors is dealt to several tasks and files."""
        segment = str(uuid.uuid4())

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = nearest(dense.unit(batch.column("id"), batch.column("v"))[1], centroids, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

        kept = stored(rows.mapInArrow(assigned, f"id {rows.schema['id'].dataType.simpleString()}, v array<float>, cell int"))
        kept.repartitionByRange(n // PART + 1, "cell", F.xxhash64("id")).write.partitionBy("cell").parquet(f"{self.root}/vectors/{segment}")
        return segment

    def vectors(self, at: Version, cells: list[int] | None = None) -> DataFrame:
        """``id, v, cell`` of some cells."""
        parts = None
        for segment in at.segments:
            part = self.spark.read.parquet(f"{self.root}/vectors/{segment}")
            parts = part if parts is None else parts.unionByName(part)
        return parts if cells is None else parts.filter(F.col("cell").isin(cells))

    def bytes_read(self, cells: list[int] | None = None) -> int:
        """The size of the files that a search of these cells reads (None: of all)."""
        files = self.vectors(self.version(), cells).select("_metadata.file_path", "_metadata.file_size").distinct()
        return files.agg(F.sum("file_size")).first()[0] or 0

    def probed(self, queries: DataFrame, probes: int | None = None, vector: str = "vector") -> list[int]:
        """The cells that a search for these (at most ``dense.MOST_QUERIES``) reads."""
        at = self.version()
        table = self._plain(queries.withColumn("_id", F.lit(0)), "_id", vector).limit(dense.MOST_QUERIES).toArrow().combine_chunks()
        if not table.num_rows or not at.cells:
            return []
        _, q = dense.unit(table.column("id").chunk(0), table.column("v").chunk(0))
        return np.unique(nearest(q, self._centroids(at), min(at.cells, probes or at.probes))).tolist()

    def search(self, queries: DataFrame, k: int, key: str = "vec_id", query_key: str = "query_id", vector: str = "vector", probes: int | None = None, exact: bool = False, most_queries: int = dense.MOST_QUERIES) -> DataFrame:
        """``query_id, key, score, rank``: each query's ``k`` vectors of highest cosine among those probed, ties by id.

        A query set of more than ``most_queries`` is searched in parts of about so many, each of which every task may hold.
        """
        at, asked = self.version(), self._plain(queries, query_key, vector)
        if not at.segments:
            return ranking.ranked(self.spark.createDataFrame([], ranking.candidates(asked.schema["id"].dataType.simpleString(), "string")), k, "query_id", key)
        points = self.vectors(at)
        schema = ranking.candidates(*(df.schema["id"].dataType.simpleString() for df in (asked, points)))
        centroids, probes = self._centroids(at), at.cells if exact else min(at.cells, probes or at.probes)
        parts = -(-asked.count() // most_queries) or 1
        found = self.spark.createDataFrame([], schema)
        for part in range(parts):
            table = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow().combine_chunks()
            if table.num_rows:
                query, q = dense.unit(table.column("id").chunk(0), table.column("v").chunk(0))
                cell = nearest(q, centroids, probes)
                found = found.unionByName(self.vectors(at, np.unique(cell).tolist()).mapInArrow(_met(query, q, cell, at.cells, k), schema))
        return ranking.ranked(found, k, "query_id", key)


def _met(query: pa.Array, q: np.ndarray, cell: np.ndarray, cells: int, k: int):
    """The best of the points that pass by, each met by the queries that probe its cell."""
    by_cell = np.argsort(cell.ravel(), kind="stable")
    first = np.searchsorted(cell.ravel()[by_cell], np.arange(cells + 1))
    probing = by_cell // cell.shape[1]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = ranking.Best(query, k)
        for batch in batches:
            at = batch.column("cell").to_numpy()
            ids, p = dense.unit(batch.column("id"), batch.column("v"))
            for c in np.unique(at):
                rows, some = np.flatnonzero(at == c), probing[first[c] : first[c + 1]]
                each = max(1, dense.SCORES // len(some))
                for a in range(0, len(rows), each):
                    part = rows[a : a + each]
                    yield best.candidates(ids.take(pa.array(part)), q[some] @ p[part].T, some)

    return met
