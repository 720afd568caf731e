"""Packing token ids into windows by online sum of squares (list item 6).

Each task packs the documents of its partition one after another. The windows it holds open are counted by fill level; a document's
ids go to the level (or to a new window) that makes the sum of squared counts smallest, which keeps levels of every
size in stock. Full windows' worth of a long document are cut off first. When the partition ends, what the open windows hold is
moved together, cut where a window is full, and the rest is cut into pieces whose sizes are powers of two, so nothing is padded.
Memory: the open windows (a few a level, as filling up the most common level lowers the sum most) and one pass of text.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import arrays

SIZE = 2048
END_ID = 1
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


#: Fixed value: how byte-level BPE of this family cuts a text before it merges bytes.
_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranked(path: str):
    """A merge-by-rank encoder of the same vocabulary and the strings it must not see, or None where ids do not rank merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, pre = said["model"], said.get("pre_tokenizer") or {}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    ids = [model["vocab"].get(a + b) for a, b in pairs]
    if model.get("type") != "BPE" or said.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or ids != sorted(set(ids)):
        return None
    # Byte-level files write bytes that do not print as the code points from 256 on, in order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    added = [t["content"] for t in said.get("added_tokens", [])]
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    return tiktoken.Encoding("pieces", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={}), added


class Encoder(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes; as a dictionary, those of pieces, each with a space before it.

    Byte-level BPE cuts a text before every space that a non-space follows, so a text that is cut at single spaces between
    non-spaces has the ids of its pieces, each with its leading space, one after another. Recent pieces are kept.
    """

    # A space beside white space or an end; one at the start is looked for apart, as patterns that begin with the space search faster.
    _odd = re.compile(r" (?:(?=\s|\Z)|(?<=\s ))")
    _cut = re.compile(r"(?<=\S) (?=\S)")
    # The pattern engine of the encoder by rank recurses over white space; long runs go to the tokenizer itself.
    _blank = re.compile(r"\s{1000}")
    _most, _longest = 100_000, 100

    def __init__(self, path: str):
        self.path = path
        self.ranked, added = _ranked(path) or (None, [])
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.before: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self):
        """The tokenizer itself, for texts that merging by rank does not cover; it takes as much memory again."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> bytes:
        if self.ranked and not self.added.search(text) and not self._blank.search(text):
            ids = array("I", self.ranked.encode_ordinary(text))
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, piece: str) -> bytes:
        found = self.before.get(piece)
        if found is None:
            found = self.ids(" " + piece)
        if len(piece) <= self._longest:
            if len(self) >= self._most:
                self.before = dict(self)
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        head, *rest = self._cut.split(text) if text[:1] == " " or self._odd.search(text) else text.split(" ")
        return self.ids(head) + b"".join(map(self.__getitem__, rest))


class Packer:
    """Windows of one partition. A piece is (doc_id, start, ids, doc_tokens); placed, it also has a window and an offset there."""

    def __init__(self, size: int, first_id: int):
        self.size, self.next_id = size, first_id
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(size)]

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        """Places a document's ids; yields pieces of windows that this closes."""
        total, start = len(ids) // 4, 0
        while total - start >= self.size:
            yield doc_id, start, ids[4 * start : 4 * (start + self.size)], total, self._new(), 0
            start += self.size
        n = total - start
        if n:
            piece = (doc_id, start, ids[4 * start :], total)
            # Squares after the move less squares before, for each level with room; a new window starts at level 0.
            after = self.counts[n:].copy()
            after[-1] = 0
            change = 2 * (after - self.counts[: self.size - n + 1]) + 2
            change[0] = 2 * after[0] + 1
            if n < self.size:
                change[-1] -= 1  # a full window leaves the counts
            change[1:][self.counts[1 : self.size - n + 1] == 0] = np.iinfo(np.int64).max
            level = len(change) - 1 - int(change[::-1].argmin())
            window, pieces = self.open[level].pop() if level else (self._new(), [])
            pieces.append(piece)
            if level:
                self.counts[level] -= 1
            if level + n == self.size:
                yield from self._placed(window, pieces)
            else:
                self.open[level + n].append((window, pieces))
                self.counts[level + n] += 1

    @staticmethod
    def _placed(window: int, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, ids, total, window, at
            at += len(ids) // 4

    def finish(self) -> Iterator[tuple]:
        """Moves what open windows hold together, so that every window is full or a power of two."""
        pieces = [p for level in reversed(self.open) for _, held in level for p in held]
        left = sum(len(p[2]) for p in pieces) // 4
        windows = [self.size] * (left // self.size) + [1 << b for b in reversed(range(self.size.bit_length())) if left % self.size >> b & 1]
        at, window = 0, self._new() if windows else -1
        for doc_id, start, ids, total in pieces:
            while ids:
                take = min(len(ids) // 4, windows[0] - at)
                yield doc_id, start, ids[: 4 * take], total, window, at
                start, ids, at = start + take, ids[4 * take :], at + take
                if at == windows[0]:
                    windows.pop(0)
                    at, window = 0, self._new()


def _pack(path: str, size: int, end_id: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

        def batch(placed: list[tuple]) -> pa.RecordBatch:
            doc_id, start, ids, total, window, at = zip(*placed)
            return pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip((doc_id, start, [len(i) // 4 for i in ids], ids, total, window, at), kinds)], schema=kinds)

        packer = Packer(size, TaskContext.get().partitionId() << 40)
        # Made anew for each task: workers outlive it, and other stages' tasks would have to live beside its vocabulary.
        encode, end = Encoder(path).encode, struct.pack("<I", end_id)
        for part, _, _ in arrays.passes(batches, "text", 1 << 20):
            rows = zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
            placed = [p for d, t in rows for p in packer.add(d, encode(t or "") + end)]
            if placed:
                yield batch(placed)
        placed = list(packer.finish())
        for i in range(0, len(placed), 1000):
            yield batch(placed[i : i + 1000])

    return arrays.tidy(pack)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the path of a byte-level BPE file, readable on every executor. A document is its text's ids and ``end_id``;
    null and empty texts are that id alone. Each id lies in one piece, each sequence's pieces follow without gap from 0.
    Repeated rows are packed each; null ids stay null. Columns besides ``doc_id`` and ``text`` are ignored. An empty table
    gives no piece. Sequences never span partitions of the input, so no shuffle is needed.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    arrays.session_limits(docs)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_pack(tokenizer, size, end_id), SCHEMA)
