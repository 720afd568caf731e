"""Substring dedup by relative Lempel-Ziv parsing (list item 4).

Reference blocks are runs of documents, as many as a task reads at a time; each block's phrases of ``min_words`` words are indexed with the
document and the word that they start at, and the index of all blocks is dealt by phrase. A document is parsed against all of them: its
phrases are looked up, and a greedy factor (first word, end, source document, its first word) starts at a phrase that an earlier document holds and
grows, word by word, as long as the next phrase continues the source. Where a factor ends, the phrases that cross its boundary are
looked up as well: where they stand in another source, the next factor begins inside the last one. Factors are so at least a phrase long, each is a
verbatim copy from one document, and their union, the duplicate spans, holds every word of every phrase that an earlier document has.

Of several sources of a phrase the index names the earliest that it knows of: a factor follows its source only while the index names
it, so a longer copy may be told as several overlapping factors. Phrases are compared by a 64-bit hash of all their words.
Memory is bounded by the index partition (``bytes_each`` of text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import arrays, windows

MIN_WORDS = 13
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FACTORS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64()), ("at", pa.int64())]))


def _word_units(data: np.ndarray, offsets: np.ndarray):
    start, end, first = arrays.words(data, offsets)
    return arrays.span_hashes(data, start, end), first


def spans(at: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Unions of the windows that start at ``at`` (ascending), as (first, end); spans that touch are one."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > width)
    return list(zip(at[np.concatenate(([0], cut + 1))].tolist(), (at[np.append(cut, len(at) - 1)] + width).tolist()))


def factors(at: np.ndarray, owner: np.ndarray, row: np.ndarray, place: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (first word, end, source document, its first word) of the phrases that start at ``at`` and repeat those at ``place``."""
    if not len(at):
        return []
    follows = (np.diff(at) == 1) & (np.diff(owner) == 0) & (row[1:] == row[:-1]) & (np.diff(place.astype(np.int64)) == 1)
    first = np.concatenate(([0], np.flatnonzero(~follows) + 1))
    last = np.append(first[1:], len(at)) - 1
    return list(zip(at[first].tolist(), (at[last] + width).tolist(), owner[first].tolist(), place[first].tolist()))


def _cut(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in arrays.passes(batches, "text"):
            start, end, first = arrays.words(data, offsets)
            keep = np.ones(len(start), bool)
            gone, sources = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            hits = batch.column("hits")
            for row in np.flatnonzero(np.asarray(hits.is_valid())).tolist():
                packed = hits[row].as_py()
                at = windows.starts(packed, sourced=True)
                for a, b, owner, place in factors(at, *windows.origins(packed), width):
                    keep[first[row] + a : first[row] + b] = False
                    sources[row].append({"start": a, "end": b, "source": owner, "at": place})
                gone[row] = [{"start": a, "end": b} for a, b in spans(at, width)]
            removed = np.diff(np.concatenate(([0], np.cumsum(~keep)))[first])
            texts = pa.array(arrays.kept_words(data, offsets, start, end, first, keep), pa.binary()).cast(pa.string())
            columns = [batch.column("doc_id"), texts, pa.array(np.diff(first)), pa.array(removed), pa.array(gone, _SPANS), pa.array(sources, _FACTORS)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_words", "n_removed", "spans", "factors"])

    return arrays.tidy(cut)


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: ``doc_id, text`` (kept words joined by a space), ``n_words, n_removed, spans, factors``.

    Removes each word in a window of ``min_words`` words that also starts in a document of a smaller ``doc_id``; windows are
    judged on the input. ``spans`` are the removed words (first, end exclusive), ``factors`` the copies that they are made of: the words ``start``
    to ``end`` stand in document ``source`` from its word ``at`` on. Null or empty text: no words, empty text. Texts shorter than a
    window stay. Null ``doc_id``: after all others, kept null. Rows of one ``doc_id`` (null too) never remove each other's words; repeated
    rows stay repeated. Where a source's id repeats, one of its rows holds the factor. An empty table gives none. Columns other than ``doc_id`` and
    ``text`` are ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = windows.repeats(docs, _word_units, min_words, within=False, sourced=True).select("doc_id", "text", "hits")
    kinds = "doc_id bigint, text string, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, factors array<struct<start:bigint,end:bigint,source:bigint,at:bigint>>"
    return marked.mapInArrow(_cut(min_words), kinds)
