"""Line dedup by overlapping three-line windows (list item 3).

A line is what stands between two newlines; lines without a word are left out of windows and stay. Windows of three
consecutive lines are hashed, and repeated ones found over the whole corpus in order of (doc_id, line): every occurrence
but the first marks its three lines, and the union of marked positions is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import arrays, windows

WIDTH = 3
#: Lines are few beside bytes, so that an index partition may stand for more text than one of words.
BYTES_EACH = 96 << 20
#: Windows that repeat are remembered from pass to pass, so little is lost by resolving repeats among less text at a time.
SENT_BYTES = 1 << 20


def lines(data: np.ndarray, offsets: np.ndarray):
    """Byte start and end of every line, each row's first line, and which lines have a word. An empty row has one line."""
    newline = np.flatnonzero(data == 0x0A)
    start, end = np.concatenate((newline + 1, offsets[:-1])), np.concatenate((newline, offsets[1:]))
    # A newline at the very end of a row opens a line there; stable sorts keep it before the next row's first line.
    row = np.concatenate((np.searchsorted(offsets, newline, side="right") - 1, np.arange(len(offsets) - 1)))
    fresh = np.concatenate((np.ones(len(newline), np.int8), np.zeros(len(offsets) - 1, np.int8)))
    order = np.lexsort((start, fresh, row))
    start, row_of_start = start[order], row[order]
    order = np.lexsort((end, 1 - fresh, row))
    end = end[order]
    first = np.searchsorted(row_of_start, np.arange(len(offsets)))
    solid = np.concatenate(([0], np.cumsum(~arrays.SPACE[data])))
    return start, end, first, solid[end] > solid[start]


def _line_units(data: np.ndarray, offsets: np.ndarray):
    start, end, first, solid = lines(data, offsets)
    return arrays.span_hashes(data, start[solid], end[solid]), np.concatenate(([0], np.cumsum(solid)))[first]


def _cut(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in arrays.passes(batches, "text"):
            start, end, first, solid = lines(data, offsets)
            gone = np.zeros(batch.num_rows, np.int64)
            hits, column = batch.column("hits"), batch.column("text")
            some = np.flatnonzero(np.asarray(hits.is_valid())).tolist()
            if some:
                texts = column.to_pylist()
                for row in some:
                    a, b = first[row], first[row + 1]
                    keep = np.ones(b - a, bool)
                    own = np.flatnonzero(solid[a:b])
                    keep[own[arrays.covered(len(own), windows.starts(hits[row].as_py()), width)]] = False
                    gone[row] = (~keep).sum()
                    s, e = start[a:b][keep], end[a:b][keep]
                    texts[row] = b"\n".join(data[x:y].tobytes() for x, y in zip(s.tolist(), e.tolist())).decode()
                column = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("ref"), column, pa.array(np.diff(first)), pa.array(gone)], ["ref", "text", "n_lines", "n_removed"])

    return arrays.tidy(cut)


def remove_repeated_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with ``text`` less repeated lines, and ``n_lines, n_removed``.

    Null text stays null and has one empty line, as has an empty text. Texts of fewer than ``width`` lines with a word stay.
    Null ``doc_id`` comes after all others. Of rows with one ``doc_id`` (null too) none is later than another, so they keep what they share;
    what repeats within one of them goes.
    Other columns pass through, but for input columns named ``n_lines`` or ``n_removed``, which the results replace.
    An empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_removed")]
    ref = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)))
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), ref.alias("ref"))
    marked = windows.repeats(slim, _line_units, width, within=True, bytes_each=BYTES_EACH, sent_bytes=SENT_BYTES).select("ref", "text", "hits")
    kind = slim.schema["ref"].dataType.simpleString()
    out = marked.mapInArrow(_cut(width), f"ref {kind}, text string, n_lines bigint, n_removed bigint")
    return out.select(F.col("ref.doc_id").alias("doc_id"), "text", *(F.col(f"ref.c{i}").alias(c) for i, c in enumerate(rest)), "n_lines", "n_removed")
