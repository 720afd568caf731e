"""Fill-in-the-middle transformation of documents (list item 11).

One Aho-Corasick automaton goes over a text once and reports its events: line breaks, which are the characters that change what a unit is, and
sentinels. Between two events all characters are alike, so a gap's number of units follows from its length, and the events alone, with running
counts, tell where the unit of any rank ends. No list of units is ever made.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import arrays

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
_BREAK = "\n"
_SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class Units(NamedTuple):
    """The units of one text: where each line break ends, and how many units end up to there; ``width`` limits a unit's characters."""

    ends: list[int]
    counts: list[int]
    length: int
    width: int | None

    @property
    def tail(self) -> int:
        """Units after the last break."""
        rest = self.length - (self.ends[-1] if self.ends else 0)
        return -(-rest // (self.width or max(1, rest)))

    @property
    def n(self) -> int:
        return (self.counts[-1] if self.counts else 0) + self.tail

    def end(self, rank: int) -> int:
        """Where the ``rank``-th unit ends (from 1; 0 is the text's start)."""
        i = bisect_left(self.counts, rank)
        if i < len(self.counts) and self.counts[i] == rank:
            return self.ends[i]
        start, before = (self.ends[i - 1], self.counts[i - 1]) if i else (0, 0)
        return min(self.length, start + (rank - before) * (self.width or self.length))


def automaton(sentinels: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds breaks (value 0) and sentinels (value 1)."""
    found = ahocorasick.Automaton()
    for word, value in ((_BREAK, 0), *((s, 1) for s in sentinels)):
        found.add_word(word, value)
    found.make_automaton()
    return found


def units(text: str, found: ahocorasick.Automaton, width: int | None = None) -> tuple[Units, bool]:
    """The units of ``text``, ``[^\\n]*\\n|[^\\n]+`` (with ``width`` w: ``[^\\n]{0,w-1}\\n|[^\\n]{1,w}``), and whether a sentinel is in it."""
    events = list(found.iter(text))
    ends = [at + 1 for at, value in events if not value]
    if width:
        counts = list(accumulate((b - a - 1) // width + 1 for a, b in zip([0, *ends], ends)))
    else:
        counts = list(range(1, len(ends) + 1))
    return Units(ends, counts, len(text), width), len(ends) < len(events)


def check_sentinels(sentinels: tuple[str, ...]) -> None:
    """Raises unless what is put together can always be taken apart: no sentinel may begin as another (or itself) ends, or lie in it."""
    if len(sentinels) != 3 or not all(sentinels) or len(set(sentinels)) < 3 or _BREAK in sentinels:
        raise ValueError("three different sentinels are needed, none of them empty or a line break")
    for a in sentinels:
        for b in sentinels:
            if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"{b!r} begins as {a!r} ends, so texts could not be restored")


def _draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transformed(text: str, doc_id: int | None, found: ahocorasick.Automaton, sentinels: tuple[str, ...], seed: int, rate: int, spm: int, width: int | None):
    """One row of the result, after ``doc_id``."""
    all_, taken = units(text, found, width)
    h = _draws(seed, doc_id)
    if not text or taken or h[2] % 100 >= rate:
        return all_.n, "plain", None, None, text
    a, b = sorted(all_.end(x % (all_.n + 1)) for x in h[:2])
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = sentinels
    if h[3] % 100 < spm:
        return all_.n, "spm", a, b - a, "".join((s, suffix, p, prefix, m, middle))
    return all_.n, "psm", a, b - a, "".join((p, prefix, s, suffix, m, middle))


def transform(docs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, seed: int = 7, rate: int = 100, spm: int = 50, width: int | None = None) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document.

    ``rate`` and ``spm`` are percentages: of documents that are transformed, and of those in which the suffix goes first. Units are lines, of at
    most ``width`` characters if that is given. Each row depends on its own id and text only, so rows of one id and text agree wherever
    they are, and a lost task gives the same again. A null text is empty, and empty texts, like texts that hold a sentinel, stay plain
    (their ``prefix_chars`` and ``middle_chars`` are null); a null id draws as an empty one. Other columns are not read. A text is never cut: the longest
    one, its events and its output bound a task's memory. There is no shuffle.
    """
    check_sentinels(sentinels)
    arrays.session_limits(docs)

    @arrays.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(sentinels)
        for batch, _, _ in arrays.passes(batches, "text"):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = [transformed(t or "", i, found, sentinels, seed, rate, spm, width) for i, t in zip(ids, texts)]
            n, form, prefix, middle, output = zip(*rows)
            whole = [pa.array(x, pa.int64()) for x in (ids, n, prefix, middle)]
            yield pa.RecordBatch.from_arrays([whole[0], whole[1], pa.array(form), whole[2], whole[3], pa.array(output, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made of."""
    part = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
