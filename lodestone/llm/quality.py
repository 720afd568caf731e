"""Quality rules: gradient-boosted trees over document statistics (list item 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import arrays, boosting, components, line_dedup

WINDOW = 8
#: At most so many labelled documents train the trees (those of least hash of their id).
TRAIN_ROWS = 20_000
#: Documents whose probability of being good is at least this stay.
KEEP_AT = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The trees' features, and which way the score may move with each.
FEATURES = {"words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "distinct": 0, "digits": 0, "capitals": -1, "marks": -1, "beyond_ascii": 0, "line_words": 0}


def _flags(codes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


_SYMBOLS = _flags(b"#*$%&|<>")
_DIGITS = _flags(b"0123456789")
_CAPITALS = _flags(range(65, 91))
_MARKS = _flags(c for c in range(33, 127) if not chr(c).isalnum())


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def _repeated(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values within rows: which occur again (any of them), and which have an equal one before."""
    own = arrays.mixed(key ^ arrays.mixed(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    some, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    some[order[1:][same]] = True
    some[order[:-1][same]] = True
    return some, later


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in arrays.passes(batches, "text"):
        start, end, first = arrays.words(data, offsets)
        n = np.diff(first)
        word_row = np.repeat(np.arange(len(n)), n)
        unit = arrays.span_hashes(data, start, end)
        inside = ~arrays.SPACE[data]
        chars = _per_row(inside & ((data & 0xC0) != 0x80), offsets)
        hashes, at = arrays.window_hashes(unit, first, WINDOW)
        again = at[_repeated(hashes, word_row[at])[0]]
        repeats = _per_row(arrays.covered(len(unit), again, WINDOW), first)
        a, b, line_first, solid = line_dedup.lines(data, offsets)
        line_row = np.repeat(np.arange(len(n)), np.diff(line_first))[solid]
        dup = np.bincount(line_row[_repeated(arrays.span_hashes(data, a[solid], b[solid]), line_row)[1]], minlength=len(n))
        n_lines = np.bincount(line_row, minlength=len(n))
        known = np.bincount(word_row[_repeated(unit, word_row)[1]], minlength=len(n))
        symbols = _per_row(_SYMBOLS[data], offsets)
        w, c, size = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(n_lines, 1)
        marks, capitals, digits = (_per_row(t[data], offsets) for t in (_MARKS, _CAPITALS, _DIGITS))
        beyond = _per_row(data >= 0xC0, offsets)
        shares = [n, chars / w, symbols / w, dup / size, repeats / w, (n - known) / w, digits / c, capitals / c, marks / c, beyond / c, n / size]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n, chars, symbols, dup, repeats)), *(pa.array(x.astype(np.float64)) for x in shares)], ["doc_id", *COUNTS, *FEATURES])


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts and the features of each row's whole text; a null or empty text has zeros."""
    arrays.session_limits(docs)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(arrays.tidy(_statistics), f"doc_id bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, {', '.join(f'{c} double' for c in FEATURES)}")


def train(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> boosting.Forest:
    """Trees for ``labels.quality`` (1 good, 0 bad; null is no label) from at most ``rows`` labelled documents of ``stats``."""
    each = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"))
    some = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = stats.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), *(F.min(c).alias(c) for c in FEATURES)).orderBy("doc_id").toPandas()
    return boosting.fit(found[list(FEATURES)].to_numpy(float), found["quality"].to_numpy(float), np.array(list(FEATURES.values())))


def judged(stats: DataFrame, forest: boosting.Forest, keep_at: float = KEEP_AT) -> DataFrame:
    """``stats`` with ``base_failed``, ``good`` (the trees' probability) and ``kept``."""

    @F.pandas_udf("double")
    def good(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in columns], axis=1)
        return pd.Series(np.concatenate([forest.probability(x[i : i + 2000]) for i in range(0, len(x), 2000)] or [np.zeros(0)]))

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = stats.withColumns({"base_failed": failed, "good": good(*FEATURES)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("good") >= keep_at))


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per input row: ``doc_id``, counts, features, ``base_failed``, ``good``, ``kept``.

    A text of under 20 words, or with over 30 % of its words in repeated 8-word windows, fails the base rules and is not kept;
    null and empty texts fail so. All others get the trees' verdict; without usable labels they are kept. Ties at ``keep_at``
    are kept. Null ids are judged, but never train; rows of one id train once. Columns besides ``doc_id`` and ``text`` (of
    labels: ``doc_id`` and ``quality``) are ignored. An empty table gives an empty result.
    """
    components.ensure_checkpoint_dir(docs)
    stats = statistics(docs).checkpoint()
    return judged(stats, train(stats, labels, train_rows), keep_at)


def keep_good(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """``docs``, all columns, less those that ``quality`` does not keep; the trees judge each batch as it passes, without a shuffle."""
    arrays.session_limits(docs)
    labelled = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    some = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    forest = train(statistics(slim.join(F.broadcast(some), "doc_id", "left_semi")), labels, train_rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in arrays.passes(batches, "text"):
            slim = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], ["doc_id", "text"])
            stats = next(_statistics(iter([slim])))
            n, again = (stats.column(c).to_numpy() for c in ("n_words", "n_repeat_words"))
            good = forest.probability(np.stack([stats.column(c).to_numpy() for c in FEATURES], axis=1)) >= keep_at
            yield batch.filter(pa.array((n >= 20) & (100 * again <= 30 * n) & good))

    return docs.mapInArrow(arrays.tidy(judge), docs.schema)
