"""Repeated windows of consecutive units (words, lines) over a whole corpus, found by one shuffle of window hashes.

Every task resolves repeats among a pass of its documents first and sends each distinct window once. Windows that repeat are
remembered from pass to pass, so one that a third of the corpus holds costs about an entry a task. Entries travel as packed byte
planes, by hash, to the partition that knows the earliest owner of each window; what comes back are only the positions that repeat
an earlier window and, if asked for, where that one stands.

Texts themselves are not sorted. Documents without a repeat stream through: a filter of bounded size tells them from those with
one, which meet their positions in a hash join. It has as many partitions as the index, so that the positions which a task holds are
those of ``bytes_each`` of text, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import arrays, components

#: From a pass of text to unit hashes and each row's first unit.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Order of a null document id: after all others.
LAST = np.iinfo(np.int64).max

#: Bytes of text among which repeats are resolved before anything is sent.
SENT_BYTES = 4 << 20
#: Repeating windows that a task remembers between passes; beyond, the older ones are sent again.
REMEMBERED = 1 << 18
#: Bits of the filter over documents with repeats, in words of 64 (the table that is broadcast has no more rows than words).
FILTER_BITS = 1 << 24
_BLOBS = ("hash", "owner", "row_key", "entries", "at", "source")
_PACKED = "part int, " + ", ".join(f"{n} binary" for n in _BLOBS) + ", found boolean"
_SCHEMA = pa.schema([("part", pa.int32()), *((n, pa.binary()) for n in _BLOBS), ("found", pa.bool_())])
_HITS = "owner bigint, row_key bigint, hits binary"
#: A window's source: the owner, the low half of its row's key, and the position there.
_SOURCE = (np.int64, np.uint32, np.uint32)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``owner`` (the document id, null last) and ``row_key`` (a 64-bit hash that tells rows of one id apart by text)."""
    return docs.withColumns({"owner": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(LAST))), "row_key": F.xxhash64("text")})


def _packed(part: int, hashes: np.ndarray, row: np.ndarray, at: np.ndarray, owner: np.ndarray, key: np.ndarray, found: bool, source: tuple[np.ndarray, ...] = ()) -> dict:
    """Entries in order of ``row``, with each row's owner and key once; positions and owners as differences."""
    edge = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    rows, counts = row[edge], np.diff(np.append(edge, len(row))).astype(np.uint32)
    step = np.diff(at, prepend=np.uint32(0))
    step[edge] = at[edge]
    blobs = (arrays.planes(hashes)[: 7 * len(hashes)], arrays.planes(np.diff(owner[rows], prepend=0)), arrays.planes(key[rows]), arrays.planes(counts), arrays.planes(step), b"".join(arrays.planes(x) for x in source))
    return {"part": part, **dict(zip(_BLOBS, blobs)), "found": found}


def _unpacked(group: list[dict]):
    """Hashes, row, position and source of each entry, and each row's owner and key."""
    counts = [arrays.from_planes(x["entries"], np.uint32) for x in group]
    owner = np.concatenate([np.cumsum(arrays.from_planes(x["owner"], np.int64)) for x in group])
    key = np.concatenate([arrays.from_planes(x["row_key"], np.int64) for x in group])
    # What an entry keeps of its hash are 56 bits; the partition, which depends on all 64, adds to them.
    hashes = np.concatenate([arrays.from_planes(x["hash"] + bytes(len(x["hash"]) // 7), np.uint64) for x in group])
    at = []
    for x, n in zip(group, counts):
        total = np.cumsum(arrays.from_planes(x["at"], np.uint32), dtype=np.uint32)
        first = np.concatenate((np.zeros(1, np.int64), np.cumsum(n, dtype=np.int64)[:-1]))
        before = np.concatenate((np.zeros(1, np.uint32), total))[first]
        at.append(total - np.repeat(before, n))
    source = tuple(map(np.concatenate, zip(*(_split(x["source"]) for x in group))))
    counts = np.concatenate(counts)
    return hashes, np.repeat(np.arange(len(counts), dtype=np.int32), counts), np.concatenate(at), source, owner, key


def _split(blob: bytes) -> tuple[np.ndarray, ...]:
    n, at, out = len(blob) // sum(np.dtype(t).itemsize for t in _SOURCE), 0, []
    for t in _SOURCE:
        size = n * np.dtype(t).itemsize
        out.append(arrays.from_planes(blob[at : at + size], t))
        at += size
    return tuple(out)


def _by_part(part: np.ndarray):
    """Each partition with entries, and which they are, in their order."""
    order = np.argsort(part, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
        yield int(part[some[0]]), some


def _home(owner: np.ndarray, key: np.ndarray, parts: int) -> np.ndarray:
    """The partition that gathers a row's hits."""
    return (arrays.mixed(owner.astype(np.uint64) ^ arrays.mixed(key.view(np.uint64))) % np.uint64(parts)).astype(np.int32)


def _repeats(hashes: np.ndarray, owner: np.ndarray, key: np.ndarray, at: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Entries that repeat an earlier one, and for each the first entry of its window.

    Earlier is a smaller owner; ``within``, also a smaller position in the same row. Rows of one owner are not earlier than each other.
    """
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    shared = np.zeros(len(order), bool)  # only windows of two entries need the full order
    shared[1:] |= same
    shared[:-1] |= same
    i = order[shared]
    i = i[np.lexsort((at[i], key[i], owner[i], hashes[i]))]
    fresh = np.concatenate(([True], hashes[i][1:] != hashes[i][:-1]))[: len(i)]
    place = lambda starts: np.flatnonzero(starts)[np.cumsum(starts) - 1]
    lead = i[place(fresh)]
    late = owner[i] > owner[lead]
    if within and len(i):
        fresh = fresh | np.concatenate(([True], (owner[i][1:] != owner[i][:-1]) | (key[i][1:] != key[i][:-1])))
        late |= at[i] > at[i[place(fresh)]]
    return i[late], lead[late]


class _Known:
    """Windows that a task has seen to repeat, with their first place so far."""

    def __init__(self):
        self.hashes, self.owner, self.key, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which windows are known from a smaller owner, and where they stand here."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        held = (self.hashes[at] == hashes) & (self.owner[at] < owner) if len(self.hashes) else np.zeros(len(hashes), bool)
        return held, at[held]

    def learn(self, *new: np.ndarray) -> None:
        old = (self.hashes, self.owner, self.key, self.at) if len(self.hashes) + len(new[0]) <= REMEMBERED else tuple(x[:0] for x in new)
        hashes, owner, key, at = (np.concatenate(x) for x in zip(old, new))
        order = np.lexsort((at, key, owner, hashes))
        order = order[np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))[: len(order)]]
        self.hashes, self.owner, self.key, self.at = hashes[order], owner[order], key[order], at[order]


def _low(key: np.ndarray) -> np.ndarray:
    return key.view(np.uint64).astype(np.uint32)


def _send(units: Units, width: int, parts: int, within: bool, sourced: bool, sent_bytes: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch, data, offsets in arrays.passes(batches, "text", sent_bytes):
            row_owner = batch.column("owner").to_numpy(zero_copy_only=False)
            row_key = batch.column("row_key").to_numpy(zero_copy_only=False)
            unit, first = units(data, offsets)
            hashes, start = arrays.window_hashes(unit, first, width)
            if not len(hashes):
                continue
            row = np.searchsorted(first, start, side="right") - 1
            at = (start - first[row]).astype(np.uint32)
            owner, key = row_owner[row], row_key[row]
            late, lead = _repeats(hashes, owner, key, at, within)
            one = np.ones(len(hashes), bool)
            one[late] = False
            one = np.flatnonzero(one)
            held, where = known.find(hashes[one], owner[one])
            found, sent = np.concatenate((late, one[held])), one[~held]
            order = np.argsort(found)
            source = (np.concatenate((owner[lead], known.owner[where])), np.concatenate((_low(key[lead]), _low(known.key[where]))), np.concatenate((at[lead], known.at[where]))) if sourced else ()
            found, source = found[order], tuple(x[order] for x in source)
            leads = np.unique(lead)
            known.learn(hashes[leads], owner[leads], key[leads], at[leads])
            part = (arrays.mixed(hashes[sent]) % np.uint64(parts)).astype(np.int32)
            out = [_packed(p, hashes[sent[i]], row[sent[i]], at[sent[i]], row_owner, row_key, False) for p, i in _by_part(part)]
            home = _home(row_owner, row_key, parts)[row[found]]
            out += [_packed(p, hashes[:0], row[found[i]], at[found[i]], row_owner, row_key, True, tuple(x[i] for x in source)) for p, i in _by_part(home)]
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return arrays.tidy(send)


def _resolve(parts: int, within: bool, sourced: bool):
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            passed = [x for x in batch.to_pylist() if x["found"] or held.setdefault(x["part"], []).append(x)]
            if passed:
                yield pa.RecordBatch.from_pylist(passed, _SCHEMA)
        for part in list(held):
            hashes, row, at, _, owner, key = _unpacked(held.pop(part))
            late, lead = _repeats(hashes, owner[row], key[row], at, within)
            order = np.lexsort((at[late], row[late]))
            late, lead = late[order], lead[order]
            home = _home(owner, key, parts)[row[late]]
            source = (owner[row[lead]], _low(key[row[lead]]), at[lead]) if sourced else ()
            out = [_packed(p, hashes[:0], row[late[j]], at[late[j]], owner, key, True, tuple(x[j] for x in source)) for p, j in _by_part(home)]
            for a in range(0, len(out), 500):
                yield pa.RecordBatch.from_pylist(out[a : a + 500], _SCHEMA)

    return arrays.tidy(resolve)


@arrays.tidy
def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document with hits."""
    held: dict[int, list] = {}
    for batch in batches:
        for x in batch.to_pylist():
            held.setdefault(x["part"], []).append(x)
    for part in list(held):
        _, row, at, source, owner, key = _unpacked(held.pop(part))
        owner, key = owner[row], key[row]
        order = np.lexsort((at, key, owner))
        owner, key, at, source = owner[order], key[order], at[order], tuple(x[order] for x in source if len(x))
        edge = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]))))
        ends = np.append(edge[1:], len(at))
        for a in range(0, len(edge), 5000):
            e, packed = edge[a : a + 5000], []
            for x, y in zip(e, ends[a : a + 5000]):
                some, i = np.unique(at[x:y], return_index=True)
                packed.append(b"".join(arrays.planes(v) for v in (np.diff(some, prepend=np.uint32(0)), *(s[x:y][i] for s in source))))
            yield pa.RecordBatch.from_arrays([pa.array(owner[e]), pa.array(key[e]), pa.array(packed, pa.binary())], ["owner", "row_key", "hits"])


def repeats(docs: DataFrame, units: Units, width: int, within: bool, sourced: bool = False, bytes_each: int = 24 << 20, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``docs`` with ``owner``, ``row_key`` and ``hits``: packed starts (units) of windows that an earlier document holds.

    ``within``: a window also repeats if it stands earlier in the same row. A window never repeats one of another row of the same id, null
    ids being one id. ``sourced``: each start comes with the place of the window that it repeats. ``hits`` is null where there are none.
    """
    components.ensure_checkpoint_dir(docs)
    arrays.session_limits(docs, sent_bytes)
    docs = keyed(docs)
    parts = arrays.shuffle_parts(docs, F.col("text"), bytes_each)
    sent = docs.select("owner", "row_key", "text").mapInArrow(_send(units, width, parts, within, sourced, sent_bytes), _PACKED)
    found = sent.repartitionById(parts, "part").mapInArrow(_resolve(parts, within, sourced), _PACKED)
    hits = found.repartitionById(parts, "part").mapInArrow(_gather, _HITS).checkpoint()
    return _attached(docs, hits, parts)


def _attached(docs: DataFrame, hits: DataFrame, parts: int) -> DataFrame:
    """``docs`` with their ``hits``. Only rows that the filter can't rule out are shuffled; of others it says with certainty that they have none."""
    columns = docs.columns
    bit = F.pmod(F.xxhash64("owner", "row_key"), F.lit(FILTER_BITS))
    words = hits.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_bit % 64 AS int)))").alias("_bits"))
    marked = docs.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6)).join(F.broadcast(words), "_word", "left")
    marked = marked.withColumn("_maybe", F.expr("coalesce(_bits & shiftleft(1L, cast(_bit % 64 AS int)), 0L) <> 0"))
    without = marked.filter(~F.col("_maybe")).select(*columns, F.lit(None).cast("binary").alias("hits"))
    dealt = lambda df: df.repartition(parts, "owner", "row_key")
    rest = dealt(marked.filter("_maybe").select(*columns)).join(dealt(hits).hint("shuffle_hash"), ["owner", "row_key"], "left")
    return without.unionByName(rest)


def starts(hits: bytes | None, sourced: bool = False) -> np.ndarray:
    """The window starts of one row, unpacked, ascending."""
    if not hits:
        return np.zeros(0, np.int64)
    n = len(hits) // (4 + sourced * sum(np.dtype(t).itemsize for t in _SOURCE))
    return np.cumsum(arrays.from_planes(hits[: 4 * n], np.uint32), dtype=np.int64)


def origins(hits: bytes) -> tuple[np.ndarray, ...]:
    """Owner, row (half a key) and position of the window that each start repeats."""
    n = len(hits) // (4 + sum(np.dtype(t).itemsize for t in _SOURCE))
    return _split(hits[4 * n :])
