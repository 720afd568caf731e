"""Replication, export and comparison of collections, by set-based joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.keys import content_hash, sorted_hash


def to_pull(cloud: DataFrame, local: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """Rows of ``cloud`` that ``local`` lacks; with ``version`` also those that differ there."""
    if version is None:
        return cloud.join(local.select(key), key, "left_anti")
    return cloud.join(local.select(key, version), [key, version], "left_anti")


def stale(cloud: DataFrame, local: DataFrame, key: str = "id", origin: Column | None = None) -> DataFrame:
    """Rows of ``local`` that ``cloud`` lacks; ``origin`` tells which of them came from it (default: all)."""
    mine = local if origin is None else local.filter(origin)
    return mine.join(cloud.select(key), key, "left_anti")


def synced(cloud: DataFrame, local: DataFrame, key: str = "id", version: str | None = None, origin: Column | None = None) -> DataFrame:
    """``local`` after a pull: stale rows gone, new and changed ones as in ``cloud``. A second run changes nothing."""
    new = to_pull(cloud, local, key, version)
    kept = local.join(stale(cloud, local, key, origin).select(key), key, "left_anti").join(new.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def _joined_md5(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """md5 of each source's values joined by ``|``, from rows sorted by source and value; holds one source's state only."""
    source, digest = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([source], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["source", "hash"])
    for batch in batches:
        for name, value in zip(batch.column("source").to_pylist(), batch.column("h").to_pylist()):
            if digest is not None and name == source:
                digest.update(b"|")
            else:
                if digest is not None:
                    yield row()
                source, digest = name, hashlib.md5()
            digest.update(value.encode())
    if digest is not None:
        yield row()


def source_hashes(chunks: DataFrame) -> DataFrame:
    """``source, hash``: md5 over the sorted md5 values of a source's contents.

    A source's values are streamed in order and never gathered, as those of a large source would pass the size of a row.
    """
    each = chunks.filter("source IS NOT NULL AND source <> ''").select("source", F.md5(F.coalesce("content", F.lit(""))).alias("h"))
    return each.repartition("source").sortWithinPartitions("source", "h").mapInArrow(_joined_md5, "source string, hash string")


def fingerprint(points: DataFrame, key: str = "id", leaf: int = 1000) -> DataFrame:
    """One row ``etag``, whatever the order of rows: md5 of the sorted ids of each of 4096 buckets, then of those.

    A bucket of more than about ``leaf`` ids (as the number of all ids tells) is a tree itself, of 16 children a node, so that no task
    ever gathers more than a leaf.
    """
    name = F.md5(F.col(key).cast("string"))
    depth, n = 3, points.count()
    while 16**depth * leaf < n:
        depth += 1
    each = points.groupBy(F.substring(name, 1, depth).alias("b")).agg(sorted_hash(F.col(key).cast("string"), ",").alias("h"))
    joined = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ","))
    while depth > 3:
        depth -= 1
        each = each.groupBy(F.substring("b", 1, depth).alias("p")).agg(joined.alias("h")).withColumnRenamed("p", "b")
    return each.agg(joined.alias("etag"))


def exact_fingerprint(points: DataFrame, key: str = "id", most: int = 1_000_000) -> DataFrame:
    """The etag over one sorted list of all ids, for collections of at most ``most`` that are compared with clients of that form."""
    if points.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} ids; fingerprint() has no limit")
    return points.agg(sorted_hash(F.col(key).cast("string"), ",").alias("etag"))


def overlap(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """One row: distinct content keys of ``chunks``, of ``points`` (both ``source, page, content``), and of both."""
    keys = lambda df: df.select(content_hash(F.col("source"), F.col("page"), F.col("content")).alias("k")).distinct()
    both = keys(chunks).withColumn("c", F.lit(1)).join(keys(points).withColumn("p", F.lit(1)), "k", "full_outer")
    return both.agg(F.count("c").alias("n_chunks"), F.count("p").alias("n_points"), F.count(F.col("c") + F.col("p")).alias("n_both"))


def diff(server: DataFrame, client: DataFrame) -> DataFrame:
    """``source, status`` of ``source, hash`` tables: ``add`` (new or changed), ``delete`` (client only), ``unchanged``."""
    both = server.withColumnRenamed("hash", "s").join(client.withColumnRenamed("hash", "c"), "source", "full_outer")
    status = F.when(F.col("s").isNull(), "delete").when(F.col("s").eqNullSafe(F.col("c")), "unchanged").otherwise("add")
    return both.select("source", status.alias("status"))


def export(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """Chunks with their vector by content hash; chunks without one keep a null, equal keys share one vector."""
    keyed = chunks.withColumn("hash", content_hash(F.col("source"), F.col("page"), F.col("content")))
    vectors = points.filter("vector IS NOT NULL").groupBy(content_hash(F.col("source"), F.col("page"), F.col("content")).alias("hash")).agg(F.max_by("vector", "id").alias("embedding"))
    return keyed.join(vectors, "hash", "left")


def page_of(rows: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """``limit`` rows from ``offset`` on in ``order``, each with ``total`` and ``has_more``."""
    if not 1 <= limit <= 3000 or offset < 0:
        raise ValueError("limit must lie in 1..3000 and offset must not be negative")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(order).offset(offset).limit(limit).crossJoin(F.broadcast(total)).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def export_page(rows: DataFrame, order: str, key: str, offset: int, limit: int) -> DataFrame:
    """``page_of``, less rows whose ``key`` an earlier row of the page has; ``total`` and ``has_more`` are of all rows."""
    return first_of(page_of(rows, order, offset, limit), order, key)


def first_of(rows: DataFrame, order: str, *by: str) -> DataFrame:
    """The first row in ``order`` for each ``by``: dedup of files by hash, of chunks by key."""
    over = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(over)).filter("_n = 1").drop("_n")


def urls(chunks: DataFrame, order: str) -> DataFrame:
    """``source_url, filename`` of each address: its first source, or the address's last part; blank ones are left out."""
    each = chunks.filter("trim(source_url) <> ''").groupBy("source_url").agg(F.min_by("source", order).alias("source"))
    return each.select("source_url", F.coalesce(F.nullif("source", F.lit("")), F.element_at(F.split("source_url", "/"), -1)).alias("filename"))


def downloads(sources: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries (the last of a name) of known sources whose file is not there."""
    named = manifest.groupBy("filename").agg(F.max_by("url", "ord").alias("url"))
    return named.join(sources.select(F.col("source").alias("filename")).distinct(), "filename", "left_semi").join(files.select("filename"), "filename", "left_anti")


def membership(names: DataFrame, points: DataFrame, key: str = "source") -> tuple[DataFrame, DataFrame]:
    """``names`` that some point has, and those that none has."""
    have = points.select(key).distinct()
    return names.join(have, key, "left_semi"), names.join(have, key, "left_anti")


def last_log(log: DataFrame, keep: int = 50) -> DataFrame:
    return log.orderBy(F.col("timestamp").desc()).limit(keep)


def sources(rows: DataFrame) -> DataFrame:
    """Distinct sources, blanks left out, in order."""
    return rows.select("source").filter("source IS NOT NULL AND source <> ''").distinct().orderBy("source")


def stats(points: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: rows, sources, parents, vectors and their dimension."""
    distinct = lambda c: F.count_distinct(F.nullif(F.col(c), F.lit("")))
    return points.agg(F.count(F.lit(1)).alias("n_chunks"), distinct("source").alias("n_sources"), distinct("parent_id").alias("n_parents"), F.count(vector).alias("n_vectors"), F.max(F.size(vector)).alias("dimension"))
