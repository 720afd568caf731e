"""Near-dedup by the Jaccard similarity of word shingles, exact: every pair of at least ``SHARE`` is found and no other is linked.

Texts of equal shingle sets are one class. Classes meet by SimHash: those of one fingerprint, and those whose fingerprints the buckets and pivot
tables of ``simhash`` link. These pairs are verified on their whole sets.

SimHash of so few bits misses some pairs, so classes also meet in an exact way. A class's shingles are put in one order for all (rare first, by a sketch
of bounded size), and two classes of similarity s share one of the first ``n - ceil(s * n) + 1`` of each. Classes meet by these; pairs whose sizes or
places rule out the similarity are discarded, and all others are verified on their whole sets.

Of a shingle that more than ``MOST`` classes have in front, first those two are compared with all others that stand in front of most such
shingles: of a group of near copies these are the least changed. Of the other pairs, those that links have joined by then are left out, as
they change no group, and the rest meet by fingerprints of ``WIDE`` bits, each the parity of a part of a set: two sets differ in at least as
many shingles as their fingerprints in bits. Hamming distances to pivots are tabulated, pairs whose table rows differ by more shingles than the
similarity allows are discarded (triangle inequality), then those whose fingerprints do; survivors are verified. None of this loses a link.

Nearly all shingles in front are those of one class. They travel as packets, sorted and packed by the partition where equal ones meet, which passes on
those of two classes or more and drops the rest, so that nothing of the size of all fronts is stored or shuffled again.

No shingle's classes meet in one place. Those of a shingle that the sketch counts more than ``GATHERED`` times are gathered in parts of about that many at
most, and those of a shingle with more than ``BLOCK`` are dealt to blocks: its least changed classes go to each block, and of the rest each block meets each other block in a task's row of its own, unless links
have made the shingle's classes one group by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import arrays, components, simhash

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
SHARE = (4, 5)
MOST = 64
#: Classes of one shingle that are gathered together, and those that one block of them holds, about.
GATHERED = 1 << 20
BLOCK = 1 << 13
WIDE = 512
PIVOTS = 4
#: Bits of the filter over classes whose sets are to be compared.
FILTER_BITS = 1 << 24
#: Counters of the sketch, and how many of them a row holds.
SLOTS, ROW = 1 << 17, 1 << 10
#: Pairs in one batch, and classes a task remembers to have seen.
PAIRS = 1 << 16
#: Entries of fronts that a task sends at a time, and those of a partition in which they meet, about.
SENT, MET = 1 << 19, 1 << 20
#: Bits of a shingle's hash by which classes meet: others that share them make candidates, not links.
TOKEN_BITS = 48
_MET = "token bigint, part int, members array<struct<node:bigint,place:bigint>>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, ascending: letters A-Z lowered; fewer words than ``width`` are one shingle."""
    data = arrays.LOWER[data]
    start, end, first = arrays.words(data, offsets)
    unit = arrays.span_hashes(data, start, end)
    whole, at = arrays.window_hashes(unit, first, width)
    cut = np.searchsorted(at, first)
    out = []
    for i, n in enumerate(np.diff(first).tolist()):
        if n >= width:
            out.append(np.unique(whole[cut[i] : cut[i + 1]]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(unit[first[i] : first[i + 1]].tobytes())] if n else [], np.uint64))
    return out


def _node(shingles: np.ndarray) -> int:
    x = xxhash.xxh64_intdigest(shingles.tobytes())
    return x - (1 << 64) if x >> 63 else x


def parities(shingles: np.ndarray) -> bytes:
    """A fingerprint: of each of ``WIDE`` parts of the hashes' range, whether the set has an odd number there."""
    return np.packbits(np.bincount((shingles % WIDE).astype(np.int64), minlength=WIDE) & 1 == 1).tobytes()


def _nodes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in arrays.passes(batches, "text"):
            sets = shingle_sets(data, offsets, width)
            columns = [batch.column("doc_id"), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([parities(s) for s in sets], pa.binary()), pa.array(simhash.of_texts(data, offsets, width).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "bits", "print"])

    return arrays.tidy(run)


def _once(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """By pass, class and set of each text that this task has not just seen; copies in other tasks come again."""
    seen: set[int] = set()
    for _, data, offsets in arrays.passes(batches, "text"):
        found = {_node(s): s for s in shingle_sets(data, offsets, width)}
        yield [(k, s) for k, s in found.items() if k not in seen]
        seen = found.keys() | (seen if len(seen) < PAIRS else set())


def _counted(numbers: Iterator[np.ndarray]) -> pa.RecordBatch:
    total = np.zeros(SLOTS, np.uint32)
    for x in numbers:
        total += np.bincount((x % SLOTS).astype(np.int64), minlength=SLOTS).astype(np.uint32)
    rows = total.reshape(-1, ROW)
    some = np.flatnonzero(rows.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([arrays.planes(rows[i]) for i in some], pa.binary())], ["part", "counts"])


def _count_shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _counted(s for found in _once(batches, width) for _, s in found)

    return arrays.tidy(run)


@arrays.tidy
def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, out = batch.column("part"), []
        for blobs in batch.column("all").to_pylist():
            total = np.zeros(ROW, np.float64)
            for blob in blobs:
                total += arrays.from_planes(blob, np.uint32)
            out.append(np.minimum(8 * np.log2(total + 1), 255).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([parts, pa.array(out, pa.binary())], ["part", "levels"])


def _sketch(counts: DataFrame) -> np.ndarray:
    """How common what was counted is, by counter, in steps of an eighth of a doubling. The driver gets a byte a counter."""
    out = np.zeros(SLOTS, np.uint8)
    for r in counts.groupBy("part").agg(F.collect_list("counts").alias("all")).mapInArrow(_levels, "part bigint, levels binary").collect():
        out[r.part * ROW : (r.part + 1) * ROW] = np.frombuffer(r.levels, np.uint8)
    return out


def _fronts(levels: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _once(batches, width):
            tokens, nodes, places = [], [], []
            for node, s in found:
                n = len(s)
                k = n - -(-n * SHARE[0] // SHARE[1]) + 1 if n else 0
                # Ascending already, so a stable sort by level leaves hashes to break ties.
                tokens.append(s[np.argsort(levels[(s % SLOTS).astype(np.int64)], kind="stable")[:k]])
                nodes.append(np.full(k, node, np.int64))
                places.append((n << 32) + np.arange(k, dtype=np.int64))
            if tokens:
                joined = [np.concatenate(x) for x in (tokens, nodes, places)]
                yield pa.RecordBatch.from_arrays([pa.array(joined[0].view(np.int64)), *map(pa.array, joined[1:])], ["token", "node", "place"])

    return arrays.tidy(run)


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """``FILTER_BITS`` bits, of which each of ``nodes`` (``node``) sets one. The driver gets a word of 64 for each that has any."""
    bit = F.pmod("node", F.lit(FILTER_BITS))
    words = nodes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _wanted(asked: np.ndarray, width: int):
    """Sets of the classes whose bit is set: all that are asked for, and by chance some others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _once(batches, width):
            held = [(k, s.tobytes()) for k, s in found if int(asked[k % FILTER_BITS >> 6]) >> k % 64 & 1]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([s for _, s in held], pa.binary())], ["node", "shingles"])

    return arrays.tidy(run)


def _possible(n: np.ndarray, place: np.ndarray, m: int, at: int) -> np.ndarray:
    """Whether sets of ``n`` and of ``m`` shingles whose first common one stands at those places can be similar enough."""
    most = np.minimum(n - place, m - at)
    return (SHARE[0] + SHARE[1]) * most >= SHARE[0] * (n + m)


def _cross(n: np.ndarray, place: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indices of different roots that size and place do not rule out, by kinds of size and place."""
    kinds, kind = np.unique(np.stack([n, place], axis=1), axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    members = np.split(np.argsort(kind, kind="stable"), np.cumsum(np.bincount(kind))[:-1])
    for k, mine in enumerate(members):
        others = np.flatnonzero(_possible(kinds[k:, 0], kinds[k:, 1], int(kinds[k, 0]), int(kinds[k, 1]))) + k
        for o in others.tolist():
            theirs = members[o]
            r = root[theirs]
            if root[mine[0]] == r[0] and (r == r[0]).all() and (root[mine] == r[0]).all():
                continue
            for i in mine.tolist():
                j = theirs[(r != root[i]) & (theirs > i if o == k else True)]
                if len(j):
                    yield np.full(len(j), i), j


def _most(both: np.ndarray) -> np.ndarray:
    """In how many shingles similar sets of ``both`` shingles together can differ: both less twice the least number in common."""
    return both + 2 * (-both * SHARE[0] // (SHARE[0] + SHARE[1]))


def near(bits: np.ndarray, n: np.ndarray):
    """A test of index ``i`` against indices ``j``: whether their fingerprints (rows of ``bits``) leave it open that their sets are similar."""
    pivots = np.concatenate([np.zeros((1, bits.shape[1]), np.uint64), bits[np.argsort(n, kind="stable")[:: max(1, len(n) // (PIVOTS - 1))]][: PIVOTS - 1]])
    table = np.stack([np.bitwise_count(bits ^ p).sum(axis=1, dtype=np.int32) for p in pivots], axis=1)

    def test(i: int, j: np.ndarray) -> np.ndarray:
        most = _most(n[i] + n[j])
        open_ = np.abs(table[i] - table[j]).max(axis=1) <= most
        j, most = j[open_], most[open_]
        return j[np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int32) <= most]

    return test


def _small(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of a bucket of few classes."""
    node, n, place = columns
    return _cross(n, place, node)


def _stars(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of a block with the classes that all blocks of its shingle are compared with."""
    node, n, place, star = columns
    others = np.flatnonzero(~star)
    for i in np.flatnonzero(star).tolist():
        j = others[_possible(n[others], place[others], int(n[i]), int(place[i])) & (node[others] != node[i])]
        yield np.full(len(j), i), j


def _rest(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of a block, or of two blocks (``side`` 1 and 2) with each other, that no link has joined yet."""
    _, n, place, root, bits, side = columns
    test = near(bits, n)
    for i, j in _cross(n, place, root):
        one = int(i[0])
        j = test(one, j[side[j] != side[one]] if side[one] else j)
        if len(j):
            yield i[: len(j)], j


def _pairs(candidates):
    """Distinct ``a, b`` of each batch of ``candidates`` of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, held = [], [], 0

        def written() -> pa.RecordBatch:
            a, b = np.concatenate(left), np.concatenate(right)
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            lists = batch.column("members")
            at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            node, packed, *more = (np.frombuffer(b"".join(x.to_pylist()), np.uint64).reshape(-1, WIDE // 64) if pa.types.is_binary(x.type) else x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            columns = [node, packed >> 32, packed & 0xFFFFFFFF, *more]
            for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
                for i, j in candidates([c[x:y] for c in columns]):
                    left.append(node[x + i])
                    right.append(node[x + j])
                    held += len(j)
                    if held >= PAIRS:
                        yield written()
                        left, right, held = [], [], 0
        if held:
            yield written()

    return arrays.tidy(run)


@arrays.tidy
def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            keep.append(SHARE[1] * common >= SHARE[0] * ((len(x) + len(y)) // 8 - common))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


@arrays.tidy
def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose fingerprints leave it open that their sets are similar."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, WIDE // 64) for c in ("x", "y"))
        most = _most(batch.column("n").to_numpy())
        keep = pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32) <= most)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """The pairs ``a, b`` of at least ``SHARE``: first by fingerprints (of ``classes``), what they leave open by whole sets.

    Sets are dealt by class once, for both sides.
    """
    side = lambda c, v: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(v))
    marked = pairs.distinct().join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("n"))
    pairs = marked.mapInArrow(_open, "a bigint, b bigint").checkpoint()
    asked = _bitmap(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    sets = texts.mapInArrow(_wanted(asked, width), "node bigint, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    whole = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return whole.select("a", "b", "x", "y").mapInArrow(_similar, "a bigint, b bigint").checkpoint()


def met_by_simhash(classes: DataFrame) -> DataFrame:
    """Candidates ``a, b`` (``node`` of ``classes``) by SimHash's rule: classes of one fingerprint (``print``) with the first of them, first ones with those that links connect them to."""
    prints = classes.groupBy("print").agg(F.min("node").alias("one"), F.count(F.lit(1)).alias("copies")).checkpoint()
    same = components.of_class(classes.select("node", "print"), prints, "print").filter("node <> one").select(F.col("one").alias("a"), F.col("node").alias("b"))
    end = lambda c: prints.select(F.col("print").alias(f"print_{c}"), F.col("one").alias(f"one_{c}"))
    links = simhash.links(prints.select(F.col("print").alias("bits"))).select(F.col("a").alias("print_a"), F.col("b").alias("print_b")).distinct()
    far = links.join(end("a"), "print_a").join(end("b"), "print_b").select(F.col("one_a").alias("a"), F.col("one_b").alias("b"))
    return same.unionByName(far).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _packed(token: np.ndarray, node: np.ndarray, place: np.ndarray) -> bytes:
    """Entries by token, of which a packet keeps the steps."""
    order = np.argsort(token, kind="stable")
    columns = np.diff(token[order], prepend=np.uint64(0)), node[order], place[order]
    return pa.compress(b"".join(map(arrays.planes, columns)), codec="zstd", asbytes=True)


def _unpacked(n: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blob = pa.decompress(blob, 24 * n, codec="zstd", asbytes=True)
    step, node, place = (arrays.from_planes(blob[i : i + 8 * n], kind) for i, kind in ((0, np.uint64), (8 * n, np.int64), (16 * n, np.int64)))
    return np.cumsum(step, dtype=np.uint64), node, place


def _packets(parts: int, split: int, common: np.ndarray | None):
    """Entries of fronts by the partition where they meet. Those of common shingles (by counter; without any, all) are dealt to ``split`` parts by class."""

    def packets(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        token, node, place = (np.concatenate(x) for x in zip(*held))
        short = token.view(np.uint64) & np.uint64((1 << TOKEN_BITS) - 1)
        key = (short >> np.uint64(TOKEN_BITS - 32)) * np.uint64(parts) >> np.uint64(32)
        if split > 1:
            # Keys from `parts` on are of common shingles: a block of keys for each part, shifted so that a shingle's parts meet in different partitions.
            dealt = node.view(np.uint64) % np.uint64(split)
            wide = np.ones(len(token), bool) if common is None else common[(token.view(np.uint64) % np.uint64(SLOTS)).astype(np.int64)]
            key = np.where(wide, np.uint64(parts) * (dealt + np.uint64(1)) + (key + dealt) % np.uint64(parts), key)
        order = np.argsort(key, kind="stable")
        some = np.split(order, np.flatnonzero(np.diff(key[order])) + 1)
        columns = [pa.array([key[i[0]] for i in some], pa.int64()), pa.array([len(i) for i in some], pa.int32()), pa.array([_packed(short[i], node[i], place[i]) for i in some], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["key", "n", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(c).to_numpy() for c in ("token", "node", "place")))
                n += batch.num_rows
            if n >= SENT:
                yield packets(held)
                held, n = [], 0
        if held:
            yield packets(held)

    return arrays.tidy(run)


def _met(parts: int):
    """``token, part, members`` of shingles in front of several classes (``part`` -1), and of any common one's part."""

    def rows(key: int, packets: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        token, node, place = (np.concatenate(x) for x in zip(*(_unpacked(*x) for x in packets)))
        order = np.argsort(token, kind="stable")
        if key < parts:
            same = token[order][1:] == token[order][:-1]
            order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        order = order[np.lexsort((place[order], node[order], token[order]))]
        token, node, place = token[order], node[order], place[order]
        # Copies of a class come from several tasks. Should two of its shingles share their bits, the first place rules out least.
        one = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))[: len(token)]
        token, node, place = token[one], node[one], place[one]
        at = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))[: len(token)])
        size = np.diff(np.append(at, len(token)))
        if key < parts:
            left = np.repeat(size > 1, size)
            token, node, place, size = token[left], node[left], place[left], size[size > 1]
        ends = np.concatenate(([0], np.cumsum(size)))
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + PAIRS, side="right")) - 1)
            x, y = int(ends[i]), int(ends[j])
            members = pa.ListArray.from_arrays(pa.array(ends[i : j + 1] - x, pa.int32()), pa.StructArray.from_arrays([pa.array(node[x:y]), pa.array(place[x:y])], ["node", "place"]))
            yield pa.RecordBatch.from_arrays([pa.array(token[ends[i:j]].view(np.int64)), pa.array(np.full(j - i, key // parts - 1), pa.int32()), members], ["token", "part", "members"])
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for key, n, blob in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "entries"))):
                held.setdefault(key, []).append((n, blob))
        for key in list(held):
            yield from rows(key, held.pop(key))

    return arrays.tidy(run)


def _gathered(fronts: DataFrame, classes: int, most: int, gathered: int, entries: int = 0, levels: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
    """Of shingles in front of 2 to ``most`` classes ``members``; of those in front of more, a row a class: ``token, node, place, total``.

    No row has more than about ``gathered`` members, and none of a shingle with more than that meets another in a task. ``entries``: how many rows
    ``fronts`` has, about. ``levels``: the sketch that has counted the shingles (without it, any may be in front of more than ``gathered``).
    """
    split = -(-max(classes, 1) // gathered)
    common = None if levels is None else levels >= int(8 * np.log2(gathered + 1))
    parts = max(int(fronts.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries // MET + 1)
    sent = fronts.mapInArrow(_packets(parts, split, common), "key bigint, n int, entries binary")
    met = sent.repartitionById(parts, (F.col("key") % parts).cast("int")).mapInArrow(_met(parts), _MET).checkpoint()
    whole = met.filter("part < 0").withColumn("total", F.size("members").cast("bigint"))
    few = whole.filter(F.col("total") <= most).select("members")
    large = whole.filter(F.col("total") > most).select("token", "members", "total")
    wide = met.filter("part >= 0")
    if split > 1 and not wide.isEmpty():
        sizes = wide.groupBy("token").agg(F.sum(F.size("members").cast("bigint")).alias("total")).filter("total > 1")
        every = F.explode(F.sequence(F.lit(0), F.lit(split - 1))).alias("part")
        told = wide.join(sizes.select("token", "total", every), ["token", "part"]).checkpoint()
        few = few.unionByName(told.filter(F.col("total") <= most).groupBy("token").agg(F.flatten(F.collect_list("members")).alias("members")).select("members"))
        large = large.unionByName(told.filter(F.col("total") > most).select("token", "members", "total"))
    return few, large.select("token", "total", F.explode("members").alias("m")).select("token", "m.node", "m.place", "total")


def _members(rows: DataFrame, key: tuple[str, ...], *columns: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.collect_list(F.struct("node", "place", *columns)).alias("members")).select("members")


def _blocks() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))


def _with_stars(large: DataFrame) -> DataFrame:
    """``members`` of each block of a shingle, with the two classes (one of either half of them) that stand in most large buckets."""
    times = large.groupBy("node").agg(F.count(F.lit(1)).alias("times"))
    best = large.join(times, "node").groupBy("token", "blocks", F.pmod(F.xxhash64("node"), F.lit(2))).agg(F.max(F.struct("times", "node", "place")).alias("s"))
    stars = best.select("token", _blocks().alias("block"), "s.node", "s.place", F.lit(True).alias("star"))
    return _members(large.select("token", "block", "node", "place", F.lit(False).alias("star")).unionByName(stars), ("token", "block"), "star")


def _by_blocks(placed: DataFrame) -> DataFrame:
    """``members`` of a shingle's only block, or of each two of its blocks; not of shingles of many blocks whose classes have one root."""
    one = placed.filter("blocks = 1").withColumns({"low": F.lit(0), "high": F.lit(0), "side": F.lit(0)}).drop("blocks", "block")
    more = placed.filter("blocks > 1")
    open_ = more.groupBy("token", "blocks").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("token", _blocks().alias("block"))
    more = more.join(open_, ["token", "block"], "left_semi").withColumn("other", _blocks())
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    more = more.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "side": side}).drop("blocks", "block", "other")
    return _members(one.unionByName(more), ("token", "low", "high"), "root", "bits", "side")


def groups(docs: DataFrame, width: int = SHINGLE, most: int = MOST, gathered: int = GATHERED, block: int = BLOCK) -> DataFrame:
    """``doc_id, component_id`` of every row with an id: the smallest ``doc_id`` reachable by pairs of at least ``SHARE``.

    Texts without words (or null) are one class. Classes are compared by a 64-bit hash of their sets, shingles by a 64-bit hash; a chance
    collision of two classes joins them wrongly with a probability of 2^-64 a pair. Repeated ids are one document for the caller.
    Sets are made again from the texts for each use: they are larger than the texts, and few are needed at once.
    What SimHash links has one root when the blocks of common shingles meet, which then leave its pairs out.
    ``most``, ``gathered`` and ``block`` (see the module) choose how classes meet, not what is found.
    """
    components.ensure_checkpoint_dir(docs)
    arrays.session_limits(docs)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    texts = slim.select("text")
    every = slim.mapInArrow(_nodes(width), "doc_id bigint, node bigint, n bigint, bits binary, print bigint").checkpoint()
    classes = every.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("print").alias("print")).checkpoint()
    levels = _sketch(texts.mapInArrow(_count_shingles(width), "part bigint, counts binary"))
    fronts = texts.mapInArrow(_fronts(levels, width), "token bigint, node bigint, place bigint")
    n_classes, total = classes.agg(F.count(F.lit(1)), F.sum("n")).first()
    total = total or 0
    entries = total - total * SHARE[0] // SHARE[1] + n_classes
    few, large = _gathered(fronts, n_classes, most, gathered, entries, levels)
    blocks = F.ceil(F.col("total") / block).cast("int")
    large = large.select("token", "node", "place", blocks.alias("blocks"), F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int").alias("block"))
    first = few.mapInArrow(_pairs(_small), "a bigint, b bigint")
    stars = _with_stars(large).mapInArrow(_pairs(_stars), "a bigint, b bigint")
    found = _verified(met_by_simhash(classes).unionByName(first).unionByName(stars), texts, classes, width)
    roots = components.connected(found)
    if not large.isEmpty():
        wide = classes.join(large.select("node").distinct(), "node", "left_semi")
        placed = large.join(wide.join(roots, "node", "left").select("node", "bits", F.coalesce("root", "node").alias("root")), "node")
        rest = _by_blocks(placed).mapInArrow(_pairs(_rest), "a bigint, b bigint")
        roots = components.connected(found.unionByName(_verified(rest, texts, classes, width)))
    placed = classes.join(roots, "node", "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return components.of_class(every.select("doc_id", "node"), placed.join(least, "root").select("node", "copies", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``docs`` less every document that is not the smallest ``doc_id`` of its group.

    Rows that repeat one ``doc_id`` go or stay together (they go if any of them would); rows without an id stay. All columns pass unchanged.
    """
    gone = groups(docs, width).filter(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti")
