"""SimHash near-duplicates with pivot distance tables (list item 9).

A text's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Texts of one fingerprint are one class;
classes whose fingerprints differ in at most ``DISTANCE`` bits are linked, and linked classes are one component.

Two fingerprints within three bits agree on one of four blocks of the bits that a bucket has not fixed, so classes are dealt to
buckets by block; a bucket of more than ``MOST`` classes is dealt again by four blocks of its remaining bits, until all are small
(with ten bits left there are no more than 1,024 fingerprints). Within a bucket, Hamming distances to ``PIVOTS`` fixed reference
fingerprints are tabulated, pairs whose table rows differ by more than three somewhere are discarded (triangle inequality), and
survivors are verified. A bucket returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import arrays, components

SHINGLE = 3
SEED = 42
DISTANCE = 3
MOST = 1024
PIVOTS = 24


def of_texts(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Each row's fingerprint."""
    data = arrays.LOWER[data]
    data = np.where(arrays.SPACE[data], np.uint8(0x20), data)
    start, end, first = arrays.words(data, offsets)
    count = np.diff(first)
    out = np.zeros(len(count), np.uint64)
    if not len(start):
        return out
    flat, digest = data.tobytes(), xxhash.xxh64_intdigest
    # Each word's shingle ends `width - 1` words later, or with a short text's last word.
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    base = np.repeat(first[:-1], n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a = base + nth
    b = np.minimum(a + width, np.repeat(first[1:], n)) - 1
    gaps = np.concatenate(([0], np.cumsum(start[1:] - end[:-1] != 1)))
    plain = gaps[b] == gaps[a]  # words one byte apart: the shingle is a slice of the text
    h = np.fromiter((digest(flat[s:e], SEED) for s, e in zip(start[a].tolist(), end[b].tolist())), np.uint64, len(a))
    for i in np.flatnonzero(~plain):
        h[i] = digest(b" ".join(flat[start[k] : end[k]] for k in range(a[i], b[i] + 1)), SEED)
    some = np.flatnonzero(n)
    edges = np.concatenate(([0], np.cumsum(n[some])))
    for i in range(0, len(some), 2000):
        rows = some[i : i + 2000]
        lo, hi = edges[i], edges[min(i + 2000, len(some))]
        bits = np.unpackbits(h[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, edges[i : i + len(rows)] - lo, axis=0, dtype=np.int32)
        out[rows] = np.packbits(2 * ones > n[rows][:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def _fingerprint(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in arrays.passes(batches, "text"):
            found = of_texts(data, offsets, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "bits"])

    return arrays.tidy(run)


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, bits`` of every row: the 64-bit fingerprint as a signed long.

    Letters A-Z are lowered; a text of fewer words than ``width`` is one shingle, one without words (or null) has fingerprint 0.
    """
    arrays.session_limits(docs)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_fingerprint(width), "doc_id bigint, bits bigint")


def _blocks(free: int) -> list[int]:
    """The set bits of ``free`` cut to ``DISTANCE + 1`` masks of even size."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    k = DISTANCE + 1
    return [sum(bits[len(bits) * i // k : len(bits) * (i + 1) // k]) for i in range(k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


PIVOT_BITS = np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(PIVOTS)], np.uint64)


def linked(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices of fingerprints within ``DISTANCE`` bits, by the pivot table and then exactly."""
    table = np.bitwise_count(bits[:, None] ^ PIVOT_BITS[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    near = table[order, 0]
    # Sorted by the first pivot, the rows within reach of each one are those up to here.
    reach = np.searchsorted(near, near + DISTANCE, side="right")
    n = reach - np.arange(len(bits)) - 1
    i = np.repeat(np.arange(len(bits)), n)
    j = i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a, b = order[i], order[j]
    for k in range(1, PIVOTS):
        if len(a) < 64:
            break
        keep = np.abs(table[a, k] - table[b, k]) <= DISTANCE
        a, b = a[keep], b[keep]
    keep = (np.abs(table[a] - table[b]).max(axis=1, initial=0) <= DISTANCE) & (np.bitwise_count(bits[a] ^ bits[b]) <= DISTANCE)
    return a[keep], b[keep]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` is connected to by the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


@arrays.tidy
def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("members")
        values, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
        left, right = [], []
        for x, y in zip(at[:-1], at[1:]):
            bits = np.sort(values[x:y].view(np.uint64))
            label = forest(len(bits), *linked(bits))
            moved = np.flatnonzero(label != np.arange(len(bits)))
            left.append(bits[moved])
            right.append(bits[label[moved]])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left).view(np.int64)), pa.array(np.concatenate(right).view(np.int64))], ["a", "b"])


def links(classes: DataFrame, most: int = MOST) -> DataFrame:
    """From distinct ``bits``: edges ``a, b`` that connect exactly the fingerprints connected by links of ``DISTANCE`` bits."""
    spark = classes.sparkSession
    masks = {0: _blocks((1 << 64) - 1)}
    rows = classes.select("bits", F.lit(0).cast("bigint").alias("mask"))
    found = []
    while True:
        # A bounded table: what each bucket's mask grows to, four for each mask in use.
        pairs = [(_signed(m), _signed(m | b)) for m, bs in masks.items() for b in bs]
        grown = arrays.small_table(spark, mask=pa.array([m for m, _ in pairs], pa.int64()), next=pa.array([n for _, n in pairs], pa.int64()))
        rows = rows.join(F.broadcast(grown), "mask").select("bits", F.col("next").alias("mask"), F.col("bits").bitwiseAND(F.col("next")).alias("value"))
        sizes = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        small = rows.join(sizes.filter(F.col("n") <= most), ["mask", "value"]).groupBy("mask", "value").agg(F.collect_list("bits").alias("members"))
        found.append(small.select("members").mapInArrow(_bucket_links, "a bigint, b bigint"))
        large = sizes.filter(F.col("n") > most).select("mask", "value")
        if large.isEmpty():
            break
        rows = rows.join(large, ["mask", "value"], "left_semi").select("bits", "mask").checkpoint()
        masks = {m | b: _blocks(((1 << 64) - 1) & ~(m | b)) for m, bs in masks.items() for b in bs}
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One row per input row: ``doc_id, bits, component_id`` (the smallest ``doc_id`` reachable by links).

    Null ``doc_id`` is kept and never the smallest, unless a component has no other: its ``component_id`` is then null. Equal
    rows, ids and texts may repeat; texts without words link like any others by fingerprint 0. Columns besides ``doc_id`` and
    ``text`` are ignored. An empty table gives an empty result.
    """
    components.ensure_checkpoint_dir(docs)
    marked = fingerprints(docs, width).checkpoint()
    classes = marked.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).checkpoint()
    roots = components.connected(links(classes))
    placed = classes.join(roots, classes["bits"] == roots["node"], "left").select("bits", "least", "copies", F.coalesce("root", "bits").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = placed.join(least, "root").select("bits", "copies", "component_id")
    return components.of_class(marked, by_class, "bits").select("doc_id", "bits", "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``docs`` less every document that is not the smallest ``doc_id`` of its component.

    Rows that repeat one ``doc_id`` are one document and go or stay together (they go if any of them would). Rows without an id
    can't be told apart by one and stay. All columns pass unchanged.
    """
    found = near_duplicates(docs, width)
    gone = found.filter(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti")
