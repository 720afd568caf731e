"""Mixing sources to target weights (list item 8).

Each source's words, document after document, are cut into blocks of ``BLOCK`` words. The mix is a row of slots, dealt to output
shards. How many slots a source has in the whole mix follows from its target; how many of them lie in each shard is drawn: a multinomial
draw over the shards, made as binomial splits down a tree of shards, each seeded by its place, so that any part of the tree can be made
by any task. A source's slots, numbered over all shards, are mapped to its blocks by a pseudorandom permutation for each pass over them. A block is so
taken once more only when all of its source's are, and three times at most. Slots and blocks meet by a join on source and
block number. The plan is a table with a row a source; only sums over it come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import arrays, components

BLOCK = 64
SHARD_SLOTS = 1 << 14
#: Shards whose slots of one source are made by one task at a time.
RANGE = 16
SEED = 7
MOST = 3
WEIGHTS = (1, 2, 3)
_ROUNDS = arrays.mixed(np.arange(1, 5, dtype=np.uint64))
_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Plan:
    """``sources``: ``name, source, number, copies`` (documents), ``words, target, blocks, slots``; and sums of rows and slots."""

    sources: DataFrame
    rows: int
    slots: int


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, the words of the whole text (null: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("bigint"))


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``name``, a key of the source that is never null and sorts as sources do, null last."""
    return docs.withColumn("name", F.when(F.col("source").isNull(), "t").otherwise(F.concat(F.lit("s"), "source")))


def _numbered(own: DataFrame) -> DataFrame:
    """``own`` with ``number``, from 0 in order of ``name``: a range sort, then each partition's rows after those before it."""
    placed = own.repartitionByRange("name").sortWithinPartitions("name").withColumn("place", F.monotonically_increasing_id()).checkpoint()
    placed = placed.withColumn("part", F.shiftright("place", 33))
    # As many rows as the sort has partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(heads), "part").withColumn("number", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "place", "before")


def level(sources: DataFrame, most: int = MOST) -> float:
    """Words for each unit of ``weight`` such that all ``words`` are shared out though no source has above ``most`` times its own.

    Each pass shares what sources at their most leave among the others, until no more reach it: one aggregate over the sources a pass.
    """
    out, before = 0.0, None
    while True:
        over = F.col("words") * most < F.col("weight") * out
        n, total, held, free = sources.agg(F.count(F.when(over, 1)), F.sum("words"), F.sum(F.when(over, F.col("words") * most)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == before or not free:
            return out
        before, out = n, (total - (held or 0)) / free


def planned(sizes: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS) -> Plan:
    """The plan for ``name, source, size`` rows; ``weights`` repeat over the sources in order of code points, null last."""
    own = sizes.groupBy("name").agg(F.first("source").alias("source"), F.sum("size").alias("words"), F.count(F.lit(1)).alias("copies"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    sources = _numbered(own).withColumn("weight", weight).checkpoint()
    target = F.least(F.col("words") * float(MOST), F.col("weight") * level(sources))
    # A source's last block may be short: the slots that its target needs are by its blocks' mean length.
    need = F.col("target") * F.col("blocks") / F.greatest("words", F.lit(1))
    # A part of a slot is one by its odds, or many small sources' would all be lost or all be won.
    chance = F.pmod(F.xxhash64("number"), F.lit(1 << 20)) / F.lit(1 << 20)
    sources = sources.withColumns({"target": target, "blocks": F.ceil(F.col("words") / block)}).withColumn("slots", F.floor(need + chance)).drop("weight")
    rows, slots = sources.agg(F.sum("copies"), F.sum("slots")).first()
    return Plan(sources, rows or 0, slots or 0)


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 ... size-1 for each key: four Feistel rounds, walked until they land inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    x, key, size = index.astype(np.uint64), arrays.mixed(key.astype(np.uint64)), size.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half[todo], x[todo] & low[todo]
        for k in range(4):
            left, right = right, left ^ (arrays.mixed(right + key[todo] + _ROUNDS[k]) & low[todo])
        x[todo] = left << half[todo] | right
        todo = todo[x[todo] >= size[todo]]
    return x.astype(np.int64)


def _ranges(shards: int, seed: int):
    """Of each source the ranges of shards with slots: how many, and the number in the source of the first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["number", "blocks", "first", "shards", "count", "start"]
        for batch in batches:
            for number, blocks, n in zip(*(batch.column(c).to_pylist() for c in ("number", "blocks", "slots"))):
                out, todo = [], [(0, shards, n, 0)]
                while todo:
                    low, high, count, start = todo.pop()
                    if high - low <= RANGE:
                        out.append((number, blocks, low, high - low, count, start))
                    else:
                        middle = (low + high + 1) // 2
                        left = int(np.random.default_rng([seed, number, low, high]).binomial(count, (middle - low) / (high - low)))
                        todo += [(a, b, c, s) for a, b, c, s in ((low, middle, left, start), (middle, high, count - left, start + left)) if c]
                    if len(out) >= 10_000 or (out and not todo):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names)
                        out = []

    return arrays.tidy(run)


def _slots(seed: int, rows: int = 1 << 16):
    """The slots of each range: its multinomial draw over its shards, and the blocks that fill them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blocks, first, shards, count, start in zip(*(c.to_pylist() for c in batch.columns)):
                drawn = np.random.default_rng([seed, number, first]).multinomial(count, np.full(shards, 1 / shards))
                shard = np.repeat(np.arange(first, first + shards), drawn)
                for a in range(0, count, rows):
                    nth = start + np.arange(a, min(a + rows, count), dtype=np.int64)
                    size, own = np.full(len(nth), blocks, np.int64), np.full(len(nth), number, np.int64)
                    block = permuted(nth % size, size, own * MOST + nth // size + np.int64(seed) * 1_000_003)
                    yield pa.RecordBatch.from_arrays([pa.array(shard[a : a + rows]), pa.array(own), pa.array(block)], ["shard", "number", "block"])

    return arrays.tidy(run)


def slots(plan: Plan, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """``shard, number, block``: every slot of the mix, with the source and the block that fill it.

    Slots grow with the corpus, but the planner can't tell what a draw makes of a row: joins with them need a hint not to broadcast them.
    """
    shards = max(1, -(-plan.slots // shard_slots))
    each = plan.sources.filter("slots > 0").select("number", "blocks", "slots").repartition("number")
    ranges = each.mapInArrow(_ranges(shards, seed), "number bigint, blocks bigint, first bigint, shards bigint, count bigint, start bigint")
    return ranges.repartition("number", "first").mapInArrow(_slots(seed), "shard bigint, number bigint, block bigint")


def located(docs: DataFrame, plan: Plan, rows_each: int = 2_000) -> DataFrame:
    """``docs`` (with ``doc_id, name, size``) with ``number, source_size, target`` of the source, and ``at``, its words before each row.

    Order within a source is by bucket of the id's hash, then ``doc_id``; a window sums each bucket, so a large source is many
    small windows.
    """
    docs = components.of_class(docs, plan.sources.select("name", "copies", "number", F.col("words").alias("source_size"), "target"), "name").drop("name")
    buckets = max(1, plan.rows // rows_each)
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
    own = docs.groupBy("number", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select("number", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("number", "bucket").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return docs.join(own, ["number", "bucket"]).withColumn("at", (F.col("base") + F.col("within")).cast("bigint")).drop("base", "within", "bucket")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each row with words once for every block it reaches into: ``block``, ``first`` (its word that the piece starts with), ``n``."""
    reach = F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))
    each = rows.filter("size > 0").withColumn("block", F.explode(reach))
    first = F.greatest(F.col("block") * block - F.col("at"), F.lit(0))
    return each.withColumns({"first": first, "n": F.least((F.col("block") + 1) * block - F.col("at"), F.col("size")) - first})


def _slim(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), *more)


def _prepared(docs: DataFrame, block: int, weights: tuple[int, ...], *more: Column) -> tuple[DataFrame, Plan]:
    components.ensure_checkpoint_dir(docs)
    rows = _named(sized(_slim(docs, *more)).withColumn("tie", F.xxhash64("text")))
    return rows, planned(rows, block, weights)


def _times(plan: Plan, seed: int) -> DataFrame:
    """``number, block, times`` of the blocks that slots take."""
    return slots(plan, seed=seed).groupBy("number", "block").agg(F.count(F.lit(1)).cast("int").alias("times")).hint("merge")


def taken(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken`` (words the mix takes, repeats counted).

    ``target`` is the source's. Null and empty texts have size 0 and are not taken; a null source is a source of its own, last in
    order. Repeated rows count each; null ids come first in their source. Without words every target is 0. Columns besides
    ``doc_id, source, text`` are ignored. An empty table gives an empty result. Equal inputs give equal results.
    """
    # Texts are read once, for their sizes.
    components.ensure_checkpoint_dir(docs)
    rows = _named(sized(_slim(docs)).withColumn("tie", F.xxhash64("text")).drop("text")).checkpoint()
    plan = planned(rows, block, weights)
    placed = located(rows, plan).checkpoint()
    keys = ["number", "at", "doc_id", "size", "source_size", "target"]
    found = pieces(placed, block).join(_times(plan, seed), ["number", "block"], "left").groupBy(keys).agg(F.sum(F.coalesce("times", F.lit(0)) * F.col("n")).alias("taken"))
    none = placed.filter("size = 0").select(*keys, F.lit(0).cast("bigint").alias("taken"))
    return found.unionByName(none).select("doc_id", "size", "source_size", "target", "taken")


def mixed_blocks(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mix itself, one row per slot: ``shard, source, block, text`` (the block's words, joined by a space)."""
    rows, plan = _prepared(docs, block, weights)
    each = pieces(located(rows, plan), block).select("number", "block", "at", "first", "n", "text")
    cut = _cut_words(each, "number bigint, block bigint, at bigint")
    texts = cut.groupBy("number", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("text"))
    filled = slots(plan, seed=seed).hint("merge").join(texts, ["number", "block"])
    return components.of_class(filled, plan.sources.select("number", "source", F.col("slots").alias("copies")), "number").select("shard", "source", "block", "text")


def _cut_words(each: DataFrame, keys: str) -> DataFrame:
    names = [k.split()[0] for k in keys.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in arrays.passes(batches, "text"):
            start, end, first = arrays.words(data, offsets)
            a = batch.column("first").to_numpy() + first[:-1]
            index = np.arange(len(start))
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            keep = (index >= a[row]) & (index < (a + batch.column("n").to_numpy())[row])
            texts = pa.array(arrays.kept_words(data, offsets, start, end, first, keep), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), texts], [*names, "text"])

    arrays.session_limits(each)
    return each.select(*names, "first", "n", "text").mapInArrow(cut, f"{keys}, text string")


def mixed_documents(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mix as documents: for each time that words of one are taken, a row with those words, joined by a space.

    A document of which some blocks are taken twice gives two rows: all words taken at least once, and those taken at least
    twice. One that is not taken gives none. Columns of ``docs`` pass; ``n_chars``, where there is one, is the new text's.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    carried = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)), F.lit(0).alias("pad")).alias("carried")
    rows, plan = _prepared(docs, block, weights, carried)
    placed = located(rows, plan).drop("source_size", "target")
    # Where words stand does not depend on the texts themselves, so that these are counted again rather than kept.
    spans = pieces(placed.select("number", "at", "size"), block).join(_times(plan, seed), ["number", "block"])
    spans = spans.groupBy("number", "at").agg(F.collect_list(F.struct(F.col("first").cast("bigint").alias("first"), F.col("n").cast("bigint").alias("n"), "times")).alias("spans"))
    found = placed.join(spans, ["number", "at"]).filter("size > 0").select("doc_id", "source", "text", "carried", "spans")
    arrays.session_limits(docs)
    kind = found.schema["carried"].dataType.simpleString()
    out = found.mapInArrow(_copies, f"doc_id bigint, source string, text string, carried {kind}")
    back = {c: F.col(f"carried.c{i}") for i, c in enumerate(rest)} | {"text": F.col("text"), "source": F.col("source"), "doc_id": F.col("doc_id")}
    if "n_chars" in back:
        back["n_chars"] = F.length("text").cast("bigint")
    return out.select(*(back[c].alias(c) for c in docs.columns))


@arrays.tidy
def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in arrays.passes(batches, "text"):
        start, end, first = arrays.words(data, offsets)
        times = np.zeros(len(start), np.int8)
        for row, spans in enumerate(batch.column("spans").to_pylist()):
            for s in spans:
                a = first[row] + s["first"]
                times[a : a + s["n"]] = s["times"]
        for k in range(1, int(times.max(initial=0)) + 1):
            some = np.add.reduceat(np.append(times >= k, False), first[:-1]) > 0 if len(start) else np.zeros(batch.num_rows, bool)
            some &= np.diff(first) > 0
            texts = pa.array(arrays.kept_words(data, offsets, start, end, first, times >= k), pa.binary()).cast(pa.string())
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), texts, batch.column("carried")], ["doc_id", "source", "text", "carried"])
            yield out.filter(pa.array(some))
