"""Language-model scoring by deleted interpolation (list item 5).

The model mixes three estimates of the next token: its bigram's and its own relative frequency among training tokens, and one over
the vocabulary. Weights depend on how often the context was seen (buckets by powers of two) and are learned by expectation-
maximisation on held-out counts: one fold of the training documents, whose tokens are deleted from the estimates for that. The
model then uses the counts of all training documents.

Counts of a large corpus fit nowhere whole. Documents are written once as shards of token numbers; each shard asks the partition
that owns a word or bigram (by hash) for its counts, each distinct one once a shard, and gets them back in the order it asked. So
nothing is capped, a very common word costs one entry a shard, and what moves grows with the input. Only totals and a
histogram of bounded size (bucket by two rounded log ratios) come to the driver.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import arrays, components

FOLDS = 7
HELD_OUT = 2
#: The training fold that mixture weights are learned on.
TUNING = 3
SHARD_BYTES = 8 << 20
#: Steps of the histogram in a log10 ratio, and the longest ratio it tells apart (as many steps).
STEP, RANGE = 50, 1000
BUCKETS = 48
#: A bigram is known by so many bits of its hash, a word by all 64.
_PAIR_BITS = np.uint64(((1 << 56) - 1) << 8)
_END = np.array([0x9E3779B97F4A7C15], np.uint64)
_SHARDS = "shard bigint, docs binary, folds binary, lengths binary, words binary, tokens binary"
_ASKED = "part int, shard bigint, keys binary, train binary, tuning binary"
_TOLD = "shard bigint, part int, train binary, tuning binary, vocabulary bigint"


def _pack(x: np.ndarray, sorted_: bool = False) -> bytes:
    if sorted_:
        x = np.diff(x, prepend=x.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(arrays.planes(x))


def _unpack(blob: bytes, dtype, sorted_: bool = False) -> np.ndarray:
    x = arrays.from_planes(zstandard.ZstdDecompressor().decompress(blob), dtype)
    return np.cumsum(x, dtype=dtype) if sorted_ else x


def _pack_counts(x: np.ndarray) -> bytes:
    """Mostly small numbers: a byte each, by Huffman codes and runs; larger ones follow."""
    large = x[x >= 255].astype(np.int64).tobytes()
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_RLE)
    return len(large).to_bytes(8, "little") + large + coder.compress(np.minimum(x, 255).astype(np.uint8).tobytes()) + coder.flush()


def _unpack_counts(blob: bytes) -> np.ndarray:
    n = 8 + int.from_bytes(blob[:8], "little")
    x = np.frombuffer(zlib.decompress(blob[n:], -15), np.uint8).astype(np.int64)
    x[x == 255] = np.frombuffer(blob[8:n], np.int64)
    return x


@arrays.tidy
def _to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pass, a shard of the tuning fold's rows, with an odd number, from which weights are learned, and one of the others."""
    number = TaskContext.get().partitionId() << 32
    for batch, _, _ in arrays.passes(batches, "text", SHARD_BYTES):
        tuning = batch.column("fold").to_numpy() == TUNING
        for odd, some in enumerate((~tuning, tuning)):
            if some.any():
                yield _shard(number + odd, batch.filter(pa.array(some)))
        number += 2


def _shard(number: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = arrays.text_bytes(batch.column("text"))
    data = arrays.LOWER[data]
    start, end, first = arrays.words(data, offsets)
    lengths = np.diff(first) + 1
    # Every row's words and then an end.
    hashes = np.full(len(start) + batch.num_rows, _END[0])
    hashes[np.arange(len(start)) + np.repeat(np.arange(batch.num_rows), np.diff(first))] = arrays.span_hashes(data, start, end)
    words, tokens, n = np.unique(hashes, return_inverse=True, return_counts=True)
    # Frequent words get small numbers; those of one power of two stay in order of their hash. Both keep the shard small.
    order = np.argsort(-np.floor(np.log2(n)).astype(np.int64), kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    ids = batch.column("doc_id")
    docs = np.concatenate((ids.fill_null(0).to_numpy(), np.asarray(ids.is_valid()).astype(np.int64)))
    packed = (_pack(docs), _pack(batch.column("fold").to_numpy().astype(np.uint8)), _pack(lengths.astype(np.uint32)), _pack(words[order], True), _pack(place[tokens]))
    return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x], pa.binary()) for x in packed)], ["shard", "docs", "folds", "lengths", "words", "tokens"])


@dataclass
class _Shard:
    """A shard, unpacked: of each token its word and its bigram, numbered in the order in which counts are asked."""

    number: int
    doc_id: np.ndarray
    known: np.ndarray
    folds: np.ndarray
    lengths: np.ndarray
    words: np.ndarray
    word_order: np.ndarray
    token: np.ndarray
    pairs: np.ndarray
    pair_order: np.ndarray
    pair: np.ndarray
    context: np.ndarray

    @classmethod
    def read(cls, x: dict) -> _Shard:
        docs = _unpack(x["docs"], np.int64).reshape(2, -1)
        lengths, words, token = _unpack(x["lengths"], np.uint32).astype(np.int64), _unpack(x["words"], np.uint64, True), _unpack(x["tokens"], np.uint32).astype(np.int64)
        context = np.empty_like(token)
        context[1:] = token[:-1]
        context[np.cumsum(lengths) - lengths] = np.flatnonzero(words == _END[0])[0]  # a document starts after an end
        keys, pair = np.unique(context * len(words) + token, return_inverse=True)
        pairs = arrays.mixed(words[keys // len(words)] * np.uint64(3) ^ arrays.mixed(words[keys % len(words)])) & _PAIR_BITS
        return cls(x["shard"], docs[0], docs[1].astype(bool), _unpack(x["folds"], np.uint8), lengths, words, np.argsort(words), token, pairs, np.argsort(pairs), pair, context)

    def fold_of_token(self) -> np.ndarray:
        return np.repeat(self.folds, self.lengths)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ascending with the key, so that what is sorted by key is sorted by part."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _ask(parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                s = _Shard.read(x)
                fold = s.fold_of_token()
                out = []
                for offset, keys, order, index in ((0, s.words, s.word_order, s.token), (parts, s.pairs, s.pair_order, s.pair)):
                    train = np.bincount(index[fold != HELD_OUT], minlength=len(keys))[order].astype(np.uint32)
                    tuning = np.bincount(index[fold == TUNING], minlength=len(keys))[order].astype(np.uint32)
                    keys = keys[order]
                    part = _part(keys, parts)
                    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
                    for a, b in zip(edges[:-1], edges[1:]):
                        out.append((offset + int(part[a]), s.number, _pack(keys[a:b] >> np.uint64(8 if offset else 0), True), _pack_counts(train[a:b]), _pack_counts(tuning[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["part", "shard", "keys", "train", "tuning"])

    return arrays.tidy(ask)


@arrays.tidy
def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[dict]] = {}
    for batch in batches:
        for x in batch.to_pylist():
            held.setdefault(x["part"], []).append(x)
    for part in list(held):
        group = held.pop(part)
        keys = [_unpack(x["keys"], np.uint64, True) for x in group]
        ends = np.cumsum([len(k) for k in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        fresh = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
        which = np.empty(len(keys), np.int64)
        which[order] = np.cumsum(fresh) - 1
        del keys, order
        totals = []
        for name in ("train", "tuning"):
            each = np.concatenate([_unpack_counts(x[name]) for x in group])
            totals.append(np.bincount(which, each, minlength=int(fresh.sum())).astype(np.int64))
        vocabulary = int((totals[0] > 0).sum())
        for i, (x, b) in enumerate(zip(group, ends)):
            own = which[(ends[i - 1] if i else 0) : b]
            row = (x["shard"], part, _pack_counts(totals[0][own]), _pack_counts(totals[1][own]), vocabulary if i == 0 else 0)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()))], ["shard", "part", "train", "tuning", "vocabulary"])


def _counts(s: _Shard, told: list[dict], parts: int):
    """(train, tuning) counts of the shard's words and of its bigrams, by number."""
    told = sorted(told, key=lambda t: t["part"])
    out = []
    for pairs, order in ((False, s.word_order), (True, s.pair_order)):
        own = [t for t in told if (t["part"] >= parts) == pairs]
        for name in ("train", "tuning"):
            x = np.empty(len(order), np.int64)
            x[order] = np.concatenate([_unpack_counts(t[name]) for t in own])
            out.append(x)
    return out


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context not seen, else 1 and the power of two that its count reaches."""
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))).astype(np.int64), BUCKETS - 1), 0)


@dataclass(frozen=True)
class Model:
    """``tokens``: training tokens; ``vocabulary``: distinct ones; ``weights``: of uniform, own and bigram share, by bucket."""

    tokens: int
    vocabulary: int
    weights: np.ndarray


def _histogram(parts: int, tokens: int, vocabulary: int):
    """Of the tuning fold's tokens, with their fold's counts deleted: how many by bucket and both estimates' ratio to uniform."""

    def step(ratio: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            x = np.rint(STEP * np.log10(ratio))
        return np.where(ratio > 0, np.clip(x, -RANGE, RANGE) + RANGE + 1, 0).astype(np.int64)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                s = _Shard.read(x)
                word, word_out, pair, pair_out = _counts(s, x["told"], parts)
                context = (word - word_out)[s.context]
                own = (word - word_out)[s.token] * ((vocabulary + 1) / max(tokens, 1))
                both = (pair - pair_out)[s.pair] / np.maximum(context, 1) * (vocabulary + 1)
                cell = (_bucket(context) * (2 * RANGE + 2) + step(own)) * (2 * RANGE + 2) + step(both)
                cells, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n.astype(np.int64))], ["cell", "n"])

    return arrays.tidy(histogram)


def learned(cells: np.ndarray, n: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights (bucket by uniform, own, bigram) that expectation-maximisation finds for the histogram.

    A bucket without held-out tokens gets all buckets' weights; context never seen gives the bigram none.
    """
    side = 2 * RANGE + 2
    bucket, own, both = cells // (side * side), cells // side % side, cells % side
    ratio = lambda s: np.where(s > 0, 10.0 ** ((s - RANGE - 1) / STEP), 0.0)
    odds = np.stack((np.ones(len(cells)), ratio(own), ratio(both)), axis=1)

    def fit(some: np.ndarray, start: np.ndarray) -> np.ndarray:
        w, x, m = start, odds[some], n[some].astype(float)
        for _ in range(rounds if m.sum() else 0):
            share = x * w
            new = (m[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / m.sum()
            if np.abs(new - w).max() < 1e-9:
                break
            w = new
        return w

    every = fit(np.ones(len(cells), bool), np.full(3, 1 / 3))
    seen = fit(bucket > 0, every)
    unseen = np.array([seen[0] + 1e-9, seen[1] + 1e-9, 0.0])
    out = np.array([fit(bucket == b, seen if b else unseen / unseen.sum()) for b in range(BUCKETS)])
    out = np.maximum(out, 1e-12)  # every estimate keeps a little, so no text is impossible
    out[0, 2] = 0
    return out / out.sum(axis=1, keepdims=True)


def _score(parts: int, model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = model.tokens, model.vocabulary
        for batch in batches:
            for x in batch.to_pylist():
                s = _Shard.read(x)
                word, _, pair, _ = _counts(s, x["told"], parts)
                context = word[s.context]
                w = model.weights[_bucket(context)]
                likely = w[:, 0] / (v + 1) + w[:, 1] * word[s.token] / max(n, 1) + w[:, 2] * pair[s.pair] / np.maximum(context, 1)
                base = np.log10((word + 1) / (n + 1 * (v + 1)))
                at = np.cumsum(s.lengths) - s.lengths
                columns = [pa.array(s.doc_id, mask=~s.known), pa.array(s.folds == HELD_OUT), pa.array(s.lengths), pa.array(np.add.reduceat((word > 0)[s.token].astype(np.int64), at)), pa.array(np.add.reduceat(base[s.token], at)), pa.array(np.add.reduceat(np.log10(likely), at))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return arrays.tidy(score)


def score(docs: DataFrame, bytes_each: int = 24 << 20) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are the words of the text with A-Z lowered, and an end. Training documents are those whose crc32 of the id as text leaves
    no ``HELD_OUT`` on division by ``FOLDS`` (a null id counts as an empty text). ``base_score`` is add-one smoothing over the unigrams;
    ``score`` is the mixture's log10 probability of the text. Null and empty texts are an end alone. Repeated rows train and are
    scored each; other columns are ignored. Without training documents all estimates but the uniform one are zero. An empty
    table gives an empty result. Words are compared by a 64-bit hash, bigrams by 56 bits of one.
    """
    components.ensure_checkpoint_dir(docs)
    arrays.session_limits(docs, SHARD_BYTES)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("fold", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int"))
    parts = arrays.shuffle_parts(docs, F.col("text"), bytes_each)
    shards = _stored(docs.mapInArrow(_to_shards, _SHARDS), parts)
    told = shards.mapInArrow(_ask(parts), _ASKED).repartition(parts, "part").mapInArrow(_tell, _TOLD).checkpoint()
    vocabulary = told.filter(F.col("part") < parts).agg(F.sum("vocabulary")).first()[0] or 0
    tokens, tuning = shards.mapInArrow(_totals, "train bigint, tuning bigint").agg(F.sum("train"), F.sum("tuning")).first()
    tokens, tuning = tokens or 0, tuning or 0

    def answered(some: Column) -> DataFrame:
        by_shard = told.filter(some).groupBy("shard").agg(F.collect_list(F.struct("part", "train", "tuning")).alias("told"))
        return shards.filter(some).join(by_shard, "shard")

    cells = answered(F.col("shard") % 2 == 1).mapInArrow(_histogram(parts, tokens - tuning, vocabulary), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas()
    model = Model(tokens, vocabulary, learned(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.int64)))
    out = answered(F.lit(True)).mapInArrow(_score(parts, model), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def _stored(shards: DataFrame, buckets: int) -> DataFrame:
    """The shards as files in the shared checkpoint folder, bucketed so that joins by shard do not move them.

    Only a named table can be bucketed; the name goes once the plan knows the files and their buckets. Spark bounds the buckets of a table; a
    larger input has larger ones, which the join sorts with spills.
    """
    spark, name = shards.sparkSession, f"shards_{uuid.uuid4().hex}"
    buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    shards.write.format("parquet").bucketBy(buckets, "shard").option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolves the name
    spark.sql(f"DROP TABLE {name}")
    return table


@arrays.tidy
def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in zip(batch.column("folds").to_pylist(), batch.column("lengths").to_pylist()):
            folds, lengths = _unpack(x[0], np.uint8), _unpack(x[1], np.uint32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int(lengths[folds != HELD_OUT].sum())]), pa.array([int(lengths[folds == TUNING].sum())])], ["train", "tuning"])
