"""Vectorised word and line segmentation of Arrow text columns, shared by the operators here.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. These bytes are ASCII, so cutting UTF-8 at them is cutting text at them,
and a whole batch of documents is segmented and hashed by a few numpy passes without making Python strings.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one pass works on at a time (a longer document is a pass of its own).
PASS_BYTES = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def session_limits(df: DataFrame, batch_bytes: int = 2 * PASS_BYTES) -> None:
    """Arrow batches by bytes and not only by rows, so that long texts do not make huge batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def tidy(run):
    """``run``, a function of batches, after which a task's worker gives freed memory back: idle workers stay beside those of later stages."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied


def small_table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A table of the driver's, made through Arrow: rows of tuples would start Python workers of another kind in every executor."""
    return spark.createDataFrame(pa.table(columns))


def shuffle_parts(df: DataFrame, text: Column, bytes_each: int) -> int:
    """How many shuffle partitions hold about ``bytes_each`` of text each; never fewer than the session's setting."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // bytes_each) + 1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's byte offsets (one more than rows); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def passes(batches: Iterator[pa.RecordBatch], column: str, limit: int = PASS_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch cut to runs of rows of at most ``limit`` bytes of text (one row at least), with its bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
            yield batch.slice(row, stop - row), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
            row = stop


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end of each run of true bytes that ends at rows' ends too, and each row's first run (one more than rows)."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    start, last = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    start[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    begin = np.flatnonzero(start)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(begin, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and each row's first word (one more than rows)."""
    return runs(~SPACE[data], offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), _R if kind == "up" else _R_INVERSE, np.uint64)
        full[0] = 1
        have = _powers[kind] = np.multiply.accumulate(full)
    return have


def powers(n: int, down: bool = False) -> np.ndarray:
    """The first ``n`` powers of the multiplier, or of its inverse."""
    return _power("down" if down else "up", n)[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (ascending, not overlapping); equal spans have equal hashes wherever they stand."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PASS_BYTES, side="right")))
        base = int(start[i])
        piece = data[base : int(end[j - 1])]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _power("up", len(piece))[: len(piece)], out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = mixed((sums[e] - sums[s]) * _power("down", len(piece) + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def window_hashes(unit: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` units within one row, and the index of its first unit."""
    n = len(unit) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.zeros(n, np.uint64)
    for k in range(width):
        whole = whole * _R + unit[k : k + n]
    row_end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + width <= row_end[:n])
    return mixed(whole[at]), at


def covered(n: int, at: np.ndarray, width: int) -> np.ndarray:
    """Which of ``n`` units lie in a window of ``width`` that starts at one of ``at``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + width, n), -1)
    return np.cumsum(step[:-1]) > 0


def covered_spans(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` bytes lie in one of the spans, which do not overlap."""
    step = np.zeros(n + 1, np.int8)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1], dtype=np.int8) > 0


def planes(x: np.ndarray) -> bytes:
    """The array's bytes, all first bytes before all second ones: the shuffle's compression then finds the zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def from_planes(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def kept_words(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """Each row's kept words, joined by one space."""
    step = np.zeros(len(data) + 1, np.int8)
    row_end = np.repeat(offsets[1:], np.diff(first))
    np.add.at(step, start[keep], 1)
    np.add.at(step, np.minimum(end + 1, row_end)[keep], -1)
    mask = np.cumsum(step[:-1], dtype=np.int8) > 0
    plain = np.where(SPACE[data], np.uint8(0x20), data)[mask].tobytes()
    at = np.concatenate(([0], np.cumsum(mask)))[offsets]
    return [plain[a:b].removesuffix(b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
