"""Ingest, removal and export of files: from blocks to a published version of the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import keys, models
from lodestone.operators import chunking, replicate
from lodestone.operators.inverted import InvertedIndex
from lodestone.operators.stages import stored
from lodestone.operators.store import TableStore


def latest_uploads(files: DataFrame) -> DataFrame:
    """Of ``source, sha256, ord`` uploads: the last of each name, and of equal contents the first name."""
    named = files.groupBy("source").agg(F.max_by(F.struct("sha256", "ord"), "ord").alias("f")).select("source", "f.sha256", "f.ord")
    return replicate.first_of(named, "ord", "sha256")


def points(blocks: DataFrame, *order: str, strategy: str = "hierarchical", embedder: str = "hashed_stand_in", urls: DataFrame | None = None) -> DataFrame:
    """Chunks of blocks with vectors and ids that a repeated ingest gives again; ``urls``: ``source, source_url``."""
    chunks = chunking.chunker(strategy)(blocks, *order)
    if urls is not None:
        chunks = chunks.join(urls.select("source", "source_url"), "source", "left")
    key = keys.chunk_id(F.col("source"), F.col("page"), F.col("parent_id"), F.col("chunk_index"), F.col("content"))
    return chunks.withColumns({"id": key, "vector": models.embed(F.col("content"), embedder)})


def ingest(store: TableStore, blocks: DataFrame, *order: str, strategy: str = "hierarchical", embedder: str = "hashed_stand_in", urls: DataFrame | None = None, index: InvertedIndex | None = None) -> dict[str, int]:
    """Replaces all chunks of the blocks' sources by new ones, in one commit, which the ``index`` then follows. Returns counts of the version's new rows."""
    sources = stored(blocks.select("source").distinct())
    version = store.replace_sources(points(blocks, *order, strategy=strategy, embedder=embedder, urls=urls), sources)["version"]
    if index is not None:
        index.follow(store)
    new = store.read(version).join(sources, "source", "left_semi")
    counts = new.agg(F.count(F.lit(1)).alias("total_chunks"), F.count_distinct("parent_id").alias("total_parents"), F.count_distinct("source").alias("files")).first()
    return counts.asDict() | {"version": version}


def delete_file(stores: dict[str, TableStore | None], source: str, online: bool = True) -> dict[str, int]:
    """Removes a file from each store; raises if none has it, if a store is not configured (None), or offline. Returns how many rows went from each."""
    if not source:
        raise ValueError("a file name is needed")
    if not online:
        raise ConnectionError("files are deleted online only")
    if missing := [name for name, store in stores.items() if store is None]:
        raise ConnectionError(f"not configured: {', '.join(missing)}")
    gone = {name: store.delete_by_source(source) for name, store in stores.items()}
    if not any(gone.values()):
        raise LookupError(f"no chunks of {source}")
    return gone


def route(cloud: TableStore | None, local: TableStore, online: bool) -> TableStore:
    """The cloud store if there is one and it can be reached, else the local one."""
    return cloud if cloud is not None and online else local


def export_unless_same(store: TableStore, etag: str | None, offset: int, limit: int, source: str | None = None) -> tuple[str, DataFrame | None]:
    """The collection's etag and a page of the export; no page if a first, unfiltered one is asked for with the same etag."""
    rows = store.read()
    now = replicate.fingerprint(rows).first()["etag"]
    if etag == now and offset == 0 and source is None:
        return now, None
    chosen = rows if source is None else rows.filter(F.col("source") == F.lit(source))
    return now, replicate.page_of(chosen, "id", offset, limit)
