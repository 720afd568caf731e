"""An inverted BM25 index in a folder that all executors share: appended to without a rebuild, read by the tokens that are asked for.

Postings are gathered by token and block of documents, and filed by a bucket of the token. A block's row tells the most that the token can add to
a score in it (its greatest frequency and least length), whatever the collection's statistics come to be. A search first reads these few
columns of its tokens' buckets, scores each query's most promising blocks, and then only the blocks that can still reach the
``k``-th score found there. What it skips can't be in the result, which is that of ``lexical.search``.

A posting is a place in its block and a frequency. A block is of documents that follow each other in one task, so that their postings are
gathered where they are made. They travel as compressed packets: to the bucket's files when the index is made, and to the block's scoring in a search.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import batches as held
from lodestone.operators import lexical, ranking
from lodestone.operators.commits import Commits
from lodestone.operators.stages import stored
from lodestone.operators.store import TableStore

BUCKETS, BLOCK = 64, 1024
#: Postings of a shuffle partition.
PART = 4_000_000
#: Blocks' documents are taken from so many blocks' worth of consecutive ones, by classes of length, of which there are at most ``CLASSES``.
SPREAD, CLASSES = 4, 64
#: Postings that a task gathers before it sends them.
SENT = 1 << 20
_POSTINGS = "bucket int, token string, block bigint, n bigint, max_tf int, min_dl int, docs array<struct<row:int,tf:int>>"
#: Query terms, or pairs of a query's term and a block, that every task may hold.
MOST_TERMS = 200_000
#: Blocks that are scored for the first bound.
SEEDS = 4


@dataclass(frozen=True)
class Version:
    """Segments, how many documents and tokens they have, the idf that stands for negative ones, and the version of the store that it follows."""

    version: int
    buckets: int
    segments: tuple[str, ...] = ()
    n_docs: int = 0
    n_tokens: int = 0
    floor: float = 0.0
    of: int = 0

    @property
    def avgdl(self) -> float:
        return self.n_tokens / self.n_docs if self.n_docs else 0.0


class InvertedIndex:
    """``root/postings/<segment>/bucket=<b>``, ``root/vocabulary/<segment>/bucket=<b>`` and ``root/documents/<segment>``, with a log of versions that is written last.

    Documents are rows of an id, of any type that orders and the same for all appends, and a text; rows of one id are documents of their own.
    A reader goes on with its version whatever is appended; a writer whose version is no longer the newest gets a ``Conflict``.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, block: int = BLOCK):
        self.spark, self.root, self.block, self._buckets = spark, root.rstrip("/"), block, buckets
        self.commits = Commits(spark, root)

    def version(self, number: int | None = None) -> Version:
        """The newest version or that of a number; the number of buckets is what the first append chose."""
        v = self.commits.version() if number is None else number
        if not v:
            return Version(0, self._buckets)
        told = self.commits.read(v)
        return Version(v, told["buckets"], tuple(told["segments"]), told["n_docs"], told["n_tokens"], told["floor"], told["of"])

    def append(self, docs: DataFrame, key: str = "id", content: str = "content") -> int:
        """Adds a segment of ``docs``. Earlier segments are not read, but for their vocabularies: the floor of idf is of all tokens."""
        return self._put(self.version(), docs, key, content, keep=True)

    def rebuild(self, docs: DataFrame, key: str = "id", content: str = "content") -> int:
        """A version of ``docs`` alone, which takes the place of the newest when it is whole."""
        return self._put(self.version(), docs, key, content, keep=False)

    def follow(self, store: TableStore) -> int:
        """Brings the index to the store's newest version: by an append if rows have only come, else by a rebuild, which readers see when it is whole."""
        base, now = self.version(), store.version()
        if base.of == now:
            return base.version
        new = store.added_since(base.of)
        return self._put(base, store.read(now) if new is None else new, "id", "content", new is not None, now)

    def _put(self, base: Version, docs: DataFrame, key: str, content: str, keep: bool, of: int = 0) -> int:
        segment = str(uuid.uuid4())
        n_docs, n_tokens = self._segment(segment, docs, key, content, base.buckets)
        kept = base if keep else Version(base.version, base.buckets)
        segments = (*kept.segments, segment) if n_tokens else kept.segments
        n_docs, n_tokens = kept.n_docs + n_docs, kept.n_tokens + n_tokens
        floor = 0.0
        if segments:
            df = self._vocabulary(segments).groupBy("token").agg(F.sum("df").alias("df"))
            floor = df.agg(lexical.FLOOR * F.avg(_raw(F.col("df"), n_docs))).first()[0]
        return self.commits.commit(base.version + 1, {"buckets": base.buckets, "segments": segments, "n_docs": n_docs, "n_tokens": n_tokens, "floor": floor, "of": of})

    def _segment(self, segment: str, docs: DataFrame, key: str, content: str, buckets: int) -> tuple[int, int]:
        cores = self.spark.sparkContext.defaultParallelism
        docs = docs.select(F.col(key).alias("id"), F.col(content).alias("content"))
        docs = docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
        # Documents of like lengths share a block, so that its least length tells something.
        chunk, row = self.block * SPREAD, F.col("row")
        block = F.floor(row / F.lit(chunk)) * CLASSES + F.floor(2 * F.log2(F.greatest(F.col("dl"), F.lit(1))))
        counted = lexical.counted(docs, "id", "content").withColumn("row", F.monotonically_increasing_id())
        counted = counted.select("doc", "dl", block.cast("bigint").alias("block"), (row % chunk).cast("int").alias("row"), "terms")
        counted.write.option("compression", "zstd").parquet(f"{self.root}/documents/{segment}")
        rows = self.spark.read.parquet(f"{self.root}/documents/{segment}")
        n_docs, n_tokens, n_postings = rows.agg(F.count(F.lit(1)), F.sum("dl"), F.sum(F.size("terms"))).first()
        if not n_postings:
            return n_docs, 0
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), n_postings // PART + 1)
        held.bounded(self.spark)
        packets = rows.filter("dl > 0").select("block", "row", "dl", "terms").mapInArrow(_sent(buckets, parts), "part int, postings binary")
        postings = packets.repartitionById(parts, "part").mapInArrow(_filed, _POSTINGS)
        postings.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/postings/{segment}")
        known = self.spark.read.parquet(f"{self.root}/postings/{segment}").groupBy("bucket", "token").agg(F.sum("n").alias("df"))
        known.repartitionByRange(max(1, parts // 16), "bucket", "token").write.partitionBy("bucket").parquet(f"{self.root}/vocabulary/{segment}")
        return n_docs, n_tokens

    def _read(self, kind: str, segments: tuple[str, ...], buckets: list[int] | None) -> DataFrame:
        parts = None
        for number, segment in enumerate(segments):
            part = self.spark.read.parquet(f"{self.root}/{kind}/{segment}").withColumn("segment", F.lit(number))
            parts = part if parts is None else parts.unionByName(part)
        return parts if buckets is None else parts.filter(F.col("bucket").isin(buckets))

    def _vocabulary(self, segments: tuple[str, ...], buckets: list[int] | None = None) -> DataFrame:
        return self._read("vocabulary", segments, buckets)

    def postings(self, at: Version, buckets: list[int] | None = None) -> DataFrame:
        """``segment, bucket, token, block, n, max_tf, min_dl, docs`` (``row`` in the block, ``tf``) of some buckets."""
        return self._read("postings", at.segments, buckets)

    def documents(self, at: Version) -> DataFrame:
        """``segment, block, row, doc, dl`` of all documents."""
        return self._read("documents", at.segments, None).select("segment", "block", "row", "doc", "dl")

    def asked(self, at: Version, queries: DataFrame, query_key: str, content: str) -> tuple[DataFrame, list[int]]:
        """``query, token, weight`` of tokens that the index knows, stored, and their buckets."""
        terms = stored(lexical.query_terms(queries, query_key, content).select(F.col(query_key).alias("query"), "token", "times", _bucket(F.col("token"), at.buckets).alias("bucket")))
        buckets = [r[0] for r in terms.select("bucket").distinct().collect()]
        known = self._vocabulary(at.segments, buckets).join(terms.select("token").distinct(), "token").groupBy("token").agg(F.sum("df").alias("df"))
        raw = _raw(F.col("df"), at.n_docs)
        idf = F.when(raw < 0, F.lit(at.floor)).otherwise(raw)
        return stored(terms.join(known, "token").select("query", "token", (F.col("times") * idf).alias("weight"))), sorted(buckets)

    def reachable(self, at: Version, asked: DataFrame, buckets: list[int], k: int, most_terms: int = MOST_TERMS) -> tuple[DataFrame, DataFrame]:
        """``query, segment, block, bound`` of all blocks that hold a query's token, and of those that can hold one of its ``k`` best."""
        tokens = _bounded(stored(asked.select("token").distinct().withColumn("code", F.monotonically_increasing_id())), most_terms)
        few = _bounded(stored(asked.join(tokens, "token").select("code", "query", "weight")), most_terms)
        heads = self.postings(at, buckets).select("segment", "token", "block", "max_tf", "min_dl").join(tokens, "token")
        # By block before queries come in: each task has tokens of all blocks, and sums of its own of each query and block would be as many as tasks times blocks.
        heads = heads.select("segment", "block", "code", "max_tf", "min_dl").repartition("segment", "block").join(few, "code")
        most = F.sum(F.greatest("weight", F.lit(0.0)) * lexical.saturated(F.col("max_tf"), F.col("min_dl"), at.avgdl)).alias("bound")
        bounds = stored(heads.groupBy("query", "segment", "block").agg(most).filter("bound > 0"))
        best = Window.partitionBy("query").orderBy(F.col("bound").desc(), "segment", "block")
        seeds = bounds.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= SEEDS).drop("n")
        found = self.scored(at, asked, seeds, buckets, most_terms, k)
        kth = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc()))).filter(F.col("n") == k)
        left = bounds.join(kth.select("query", F.col("score").alias("least")), "query", "left")
        # Scores that agree to some places are equal, so that a block just below may hold one.
        return bounds, stored(left.filter(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - 2 * 10.0**-ranking.PLACES).drop("least"))

    def scored(self, at: Version, asked: DataFrame, pairs: DataFrame, buckets: list[int], most_terms: int = MOST_TERMS, k: int = 1 << 40) -> DataFrame:
        """``query, point, score`` of documents of positive score in the blocks of ``pairs`` (``query, segment, block``); each query's ``k`` best are among them."""
        key = ["segment", "block"]
        blocks = _bounded(stored(pairs.select(*key).distinct()), most_terms)
        hits = self.postings(at, buckets).select("segment", "token", "block", "docs").join(blocks, key, "left_semi")
        if asked.count() > most_terms:
            return self._joined(at, hits, pairs.select("query", "segment", "block").join(asked, "query"))
        held.bounded(self.spark)
        few = asked.toArrow()
        tokens = F.broadcast(asked.select("token").distinct())
        packets = hits.join(tokens, "token", "left_semi").mapInArrow(_to_blocks(few), "segment int, block bigint, n int, postings binary")
        gathered = packets.groupBy(*key).agg(F.collect_list(F.struct("n", "postings")).alias("packets"))
        wanted = pairs.groupBy(*key).agg(F.collect_set("query").alias("queries"))
        docs = self.documents(at).join(blocks, key, "left_semi").groupBy(*key).agg(F.collect_list(F.struct("row", "doc", "dl")).alias("docs"))
        schema = ranking.candidates(asked.schema["query"].dataType.simpleString(), docs.schema["docs"].dataType.elementType["doc"].dataType.simpleString())
        return gathered.join(wanted, key).join(docs, key).select("packets", "queries", "docs").mapInArrow(_block_scores(few, at.avgdl, k), schema)

    def _joined(self, at: Version, hits: DataFrame, wanted: DataFrame) -> DataFrame:
        """Scores by joins of postings with the terms of more queries than a task may hold."""
        each = hits.join(wanted, ["segment", "token", "block"]).select("query", "segment", "block", "weight", F.explode("docs").alias("d"))
        each = each.select("query", "segment", "block", "weight", "d.row", "d.tf").join(self.documents(at), ["segment", "block", "row"])
        part = F.col("weight") * lexical.saturated(F.col("tf"), F.col("dl"), at.avgdl)
        return each.groupBy("query", "segment", "block", "row", F.col("doc").alias("point")).agg(F.sum(part).alias("score")).select("query", "point", "score").filter("score > 0")

    def search(self, queries: DataFrame, k: int, doc_key: str = "id", query_key: str = "query_id", content: str = "text", version: int | None = None, most_terms: int = MOST_TERMS) -> DataFrame:
        """``query_key, doc_key, score, rank``: for each query the ``k`` best documents of positive score, ties by document."""
        at = self.version(version)
        if not at.segments:
            none = self.spark.createDataFrame([], ranking.candidates(queries.schema[query_key].dataType.simpleString(), "string"))
            return ranking.ranked(none, k, query_key, doc_key)
        asked, buckets = self.asked(at, queries, query_key, content)
        _, pairs = self.reachable(at, asked, buckets, k, most_terms)
        return ranking.ranked(self.scored(at, asked, pairs, buckets, most_terms, k), k, query_key, doc_key)


def _sent(buckets: int, parts: int):
    """Packets of gathered postings by the partition that files their bucket. A block whose documents a task has not all at once comes as several rows, which searches add up."""

    def packets(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        lists = pa.chunked_array([b.column("terms") for b in batches]).combine_chunks()
        n, flat = lists.value_lengths().to_numpy(), lists.flatten()
        coded = flat.field("token").dictionary_encode()
        tokens = coded.dictionary
        hashes = [xxhash.xxh64_intdigest(t, 42) for t in tokens.cast(pa.binary()).to_pylist()]
        bucket = np.array([(h - (1 << 64) if h >> 63 else h) % buckets for h in hashes], np.int32)
        # Where there are fewer partitions than buckets, a partition files several; else a bucket has several partitions.
        several = parts // buckets
        part = bucket % parts if not several else bucket * several + (np.array(hashes, np.uint64) >> np.uint64(32)).astype(np.int64) % several
        block, row, dl = (np.repeat(np.concatenate([b.column(c).to_numpy() for b in batches]), n) for c in ("block", "row", "dl"))
        code = coded.indices.to_numpy()
        order = np.lexsort((row, block, code, part[code]))
        code, part = code[order], part[code[order]]
        columns = [pa.array(bucket[code]), tokens.take(pa.array(code)), pa.array(block[order]), pa.array(row[order]), flat.field("tf").take(pa.array(order)), pa.array(dl[order])]
        whole = pa.RecordBatch.from_arrays(columns, ["bucket", "token", "block", "row", "tf", "dl"])
        cut = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])).tolist()
        blobs = [_written(list(_gathered(iter([whole.slice(a, b - a)]), ("row", "tf")))) for a, b in zip(cut, cut[1:])]
        return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["part", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, last = [], 0, None
        for batch in batches:
            chunk = batch.column("block").to_numpy() // CLASSES
            cut = np.concatenate(([0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)])).tolist()
            for a, b in zip(cut, cut[1:]):
                if b > a:
                    # Sent where a chunk ends, if that is soon.
                    if kept and size >= (SENT // 2 if chunk[a] != last else 2 * SENT):
                        yield packets(kept)
                        kept, size = [], 0
                    kept.append(batch.slice(a, b - a))
                    size += len(kept[-1].column("terms").flatten())
                    last = chunk[a]
        if kept:
            yield packets(kept)
        held.give_back()

    return run


def _written(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.Table.from_batches(batches).combine_chunks())
    return sink.getvalue().to_pybytes()


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of packets."""
    for batch in batches:
        for blob in batch.column("postings").to_pylist():
            yield from pa.ipc.open_stream(blob)
    held.give_back()


def _to_blocks(asked: pa.Table):
    """Packets by block of ``segment, token, block, docs``, with tokens as their places among those that are asked for."""
    tokens = pc.unique(asked.column("token"))

    def packets(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        segment, block = (table.column(c).to_numpy() for c in ("segment", "block"))
        docs = table.column("docs").combine_chunks()
        n, flat = docs.value_lengths().to_numpy(), docs.flatten()
        code = pc.index_in(table.column("token"), value_set=tokens).to_numpy()
        order = np.lexsort((code, block, segment))
        start = np.concatenate(([0], np.cumsum(n)))[order]
        n = n[order]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(start - ends[:-1], n) + np.arange(ends[-1])
        row, tf = (flat.field(c).to_numpy()[at].astype(np.int32) for c in ("row", "tf"))
        token = np.repeat(code[order], n).astype(np.int32)
        segment, block = segment[order], block[order]
        cut = np.concatenate(([0], np.flatnonzero((np.diff(segment) != 0) | (np.diff(block) != 0)) + 1, [len(order)]))
        blobs = []
        for a, b in zip(ends[cut[:-1]].tolist(), ends[cut[1:]].tolist()):
            step = np.diff(token[a:b], prepend=np.int32(0))
            blobs.append(pa.compress(b"".join(np.ascontiguousarray(x[a:b].view(np.uint8).reshape(-1, 4).T).tobytes() for x in (row, tf)) + step.tobytes(), codec="zstd", asbytes=True))
        columns = [pa.array(segment[cut[:-1]], pa.int32()), pa.array(block[cut[:-1]], pa.int64()), pa.array(np.diff(ends[cut]), pa.int32()), pa.array(blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["segment", "block", "n", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                size += len(batch.column("docs").flatten())
            if size >= SENT:
                yield packets(kept)
                kept, size = [], 0
        if kept:
            yield packets(kept)
        held.give_back()

    return run


def _unpacked(n: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, row and frequency of each posting of a packet."""
    planes = np.frombuffer(pa.decompress(blob, 12 * n, codec="zstd", asbytes=True), np.uint8)
    row, tf = (np.ascontiguousarray(planes[i : i + 4 * n].reshape(4, -1).T).view(np.int32).reshape(-1) for i in (0, 4 * n))
    return np.cumsum(planes[8 * n :].view(np.int32)), row, tf


def _block_scores(asked: pa.Table, avgdl: float, k: int):
    """Scores of a block's documents (a row of ``packets, queries, docs``) for the queries that want it."""
    tokens, queries = pc.unique(asked.column("token")), pc.unique(asked.column("query"))
    token = pc.index_in(asked.column("token"), value_set=tokens).to_numpy()
    order = np.argsort(token, kind="stable")
    query = pc.index_in(asked.column("query"), value_set=queries).to_numpy()[order]
    weight = asked.column("weight").to_numpy()[order]
    first = np.searchsorted(token[order], np.arange(len(tokens) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = ranking.Best(queries, k)
        for batch in batches:
            for i in range(batch.num_rows):
                wants = np.zeros(len(queries), bool)
                wants[pc.index_in(batch.column("queries")[i].values, value_set=queries).to_numpy()] = True
                docs = batch.column("docs")[i].values
                by = np.argsort(docs.field("row").to_numpy())
                points, rows, dl = docs.field("doc").take(pa.array(by)), docs.field("row").to_numpy()[by], docs.field("dl").to_numpy()[by]
                at, row, tf = (np.concatenate(x) for x in zip(*(_unpacked(x["n"], x["postings"]) for x in batch.column("packets")[i].as_py())))
                # Only terms of queries that want the block.
                of = np.flatnonzero(wants[query])
                start = np.searchsorted(of, first)
                by = np.argsort(row, kind="stable")
                at, doc, tf = at[by], np.searchsorted(rows, row[by]), tf[by]
                value = lexical.saturated(tf, dl[doc], avgdl)
                n = start[at + 1] - start[at]
                # Whole documents, as many as have about so many hits.
                cut = np.searchsorted(doc, np.arange(len(rows) + 1))
                hits = np.concatenate(([0], np.cumsum(n)))[cut]
                a = 0
                while a < len(rows):
                    b = max(a + 1, int(np.searchsorted(hits, hits[a] + lexical.HITS, side="right")) - 1)
                    part = slice(cut[a], cut[b])
                    m = n[part]
                    entry = of[np.repeat(start[at[part]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                    if len(entry):
                        yield best.hits(points.slice(a, b - a), query[entry], np.repeat(doc[part] - a, m), np.repeat(value[part], m) * weight[entry])
                    a = b
        held.give_back()

    return run


def _gathered(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = ("doc", "row", "tf", "dl")) -> Iterator[pa.RecordBatch]:
    """Postings that follow each other and are of one token and block as one row. The last ones of a batch may go on in the next."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest and _key(rest[0], 0) == _key(batch, batch.num_rows - 1):
            rest.append(batch)
            continue
        whole = pa.concat_batches([*rest, batch])
        new = np.zeros(whole.num_rows - 1, bool)
        for c in ("block", "token", "bucket"):
            column = whole.column(c)
            new |= pc.not_equal(column.slice(1), column.slice(0, whole.num_rows - 1)).to_numpy(zero_copy_only=False)
        at = np.concatenate(([0], np.flatnonzero(new) + 1))
        rest = [whole.slice(int(at[-1]))]
        if len(at) > 1:
            yield _rows(whole.slice(0, int(at[-1])), at, names)
    if rest:
        whole = pa.concat_batches(rest)
        yield _rows(whole, np.array([0, whole.num_rows]), names)


def _key(batch: pa.RecordBatch, row: int) -> list:
    return [batch.column(c)[row].as_py() for c in ("bucket", "token", "block")]


def _rows(postings: pa.RecordBatch, at: np.ndarray, names: tuple[str, ...]) -> pa.RecordBatch:
    """A row for each run of ``postings`` that starts at one of ``at`` (the last is their end)."""
    first = pa.array(at[:-1])
    tf, dl = postings.column("tf").to_numpy(), postings.column("dl").to_numpy()
    docs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([postings.column(c) for c in names], names))
    keys = [postings.column(c).take(first) for c in ("bucket", "token", "block")]
    most = [pa.array(np.maximum.reduceat(tf, at[:-1]), pa.int32()), pa.array(np.minimum.reduceat(dl, at[:-1]), pa.int32())]
    return pa.RecordBatch.from_arrays([*keys, pa.array(np.diff(at), pa.int64()), *most, docs], ["bucket", "token", "block", "n", "max_tf", "min_dl", "docs"])


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _raw(df: Column, n_docs: int) -> Column:
    """idf before negative ones are replaced."""
    return F.log(F.lit(n_docs) - df + 0.5) - F.log(df + 0.5)


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """A stored table, sent to all tasks if it is small enough."""
    return F.broadcast(rows) if rows.count() <= most else rows
