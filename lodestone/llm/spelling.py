"""Spelling variant grouping (list item 13): words one edit apart, and the common form that rare ones lead to.

A word's two halves are its segments. One edit leaves one of them whole: the first at the start of the other word, or the second at its end. Words
are dealt to shards by their first and by their last three characters, so that each shard's automaton holds every segment that its words can
show, and is scanned by those words; hits are checked for place and length, the other half by its own halves, then the distance. Words of an end
that very many share are not dealt: they meet by hashes of what is left when a character is taken away, of which no more words share one
than an alphabet allows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import arrays, components

#: Least characters and occurrences of a word, how much more often its form must occur, and which runs lose a character.
LEAST_CHARS, LEAST_N, TIMES, EVERY = 6, 5, 5, 199
#: Words of a shard; the most words of an end, and those of one segment and length in it, that are dealt to one.
SHARD, HOT, ALIKE = 16_384, 65_536, 8_192
#: Ends that every task may hold; more are joined.
MOST_ENDS = 1 << 17
_END = 3
#: Runs of more bytes are hashed one by one.
_SHORT = 64


def _crc_table() -> np.ndarray:
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1)
    return state.astype(np.uint32)


_TABLE = _crc_table()


def _crcs(crc: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The crc32 of each span of ``data`` that goes on from ``crc``."""
    out = crc.astype(np.uint32)
    short = np.flatnonzero(size <= _SHORT)
    short = short[np.argsort(-size[short], kind="stable")]
    at, left, state = start[short], -size[short], ~out[short]
    for k in range(int(size[short[0]]) if len(short) else 0):
        m = int(np.searchsorted(left, -k, side="left"))
        state[:m] = _TABLE[(state[:m] ^ data[at[:m] + k]) & 0xFF] ^ (state[:m] >> np.uint32(8))
    out[short] = ~state
    for i in np.flatnonzero(size > _SHORT):
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]].tobytes(), int(out[i]))
    return out


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and characters of each run of lower-cased letters. In UTF-8, U+00C0 to U+00FF are a byte C3 and another."""
    lead = data == 0xC3
    inside = ((data >= 97) & (data <= 122)) | lead
    inside[1:] |= lead[:-1]
    start, end, first = arrays.runs(inside, offsets)
    leads = np.concatenate(([0], np.cumsum(lead)))
    return start, end, np.repeat(np.arange(len(first) - 1), np.diff(first)), end - start - (leads[end] - leads[start])


def _counts(ids: list[int | None], data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """``word, n`` of some documents."""
    data = arrays.LOWER[data]
    start, end, row, chars = _runs(data, offsets)
    some = np.flatnonzero(chars >= LEAST_CHARS)
    start, end, row, chars = start[some], end[some], row[some], chars[some]
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = _crcs(before[row], data, start, end - start).astype(np.int64)
    hit = h % EVERY == 0
    whole = data[arrays.covered_spans(len(data), start[~hit], end[~hit])].tobytes()
    at = np.concatenate(([0], np.cumsum(end[~hit] - start[~hit]))).astype(np.int64)
    shortened = []
    for i in np.flatnonzero(hit & (chars > LEAST_CHARS)):
        run, gone = data[start[i] : end[i]].tobytes().decode(), int(h[i] % chars[i])
        shortened.append(run[:gone] + run[gone + 1 :])
    words = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(whole))
    found = pc.value_counts(pa.concat_arrays([words, pa.array(shortened, pa.large_string())]))
    return pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts").cast(pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of words of at least six characters that occur at least five times in all texts."""
    arrays.session_limits(docs)

    @arrays.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in arrays.passes(batches, "text"):
            yield _counts(batch.column("doc_id").to_pylist(), data, offsets)

    each = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_N)


def one_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character makes ``a`` of ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def meets(word: str, other: str, kind: int) -> bool:
    """Whether this kind of end tells that the words are near: the first (0) if the other's first half is whole, else the second (1)."""
    half = other[: len(other) // 2]
    return word.startswith(half) if kind == 0 else not word.startswith(half) and word.endswith(other[len(half) :])


def _segment(word: str, kind: int) -> tuple[str, str]:
    """A word's segment of a kind, and its other half."""
    h = len(word) // 2
    return (word[h:], word[:h]) if kind else (word[:h], word[h:])


def scanned(words: list[str], ns: list[int], kinds: list[int]) -> Iterator[tuple[str, int, int, str]]:
    """``word, n_near, best_n, best`` of a shard's words that have near ones."""
    found, held = ahocorasick.Automaton(), defaultdict(lambda: (defaultdict(list), defaultdict(list)))
    for j, (w, kind) in enumerate(zip(words, kinds)):
        segment, other = _segment(w, kind)
        found.add_word(segment, len(segment))
        # The other half holds the edit, which leaves one of its own halves whole.
        first, second = held[kind, segment, len(w)]
        first[other[: len(other) // 2]].append(j)
        second[other[len(other) // 2 :]].append(j)
    found.make_automaton()
    for v, kind in zip(words, kinds):
        near, size = [], len(v)
        for at, length in found.iter(v):
            if at + 1 != (size if kind else length):  # not at the end, or not at the start
                continue
            segment, rest = (v[size - length :], v[: size - length]) if kind else (v[:length], v[length:])
            for k in (size - 1, size, size + 1):
                if (kind, segment, k) not in held:
                    continue
                (first, second), q = held[kind, segment, k], (k - length) // 2
                head, tail = rest[:q], rest[len(rest) - (k - length - q) :]
                for j in first.get(head, ()):
                    if one_apart(words[j], v) and (not kind or meets(v, words[j], kind)):
                        near.append((-ns[j], words[j]))
                for j in second.get(tail, ()):
                    if not _segment(words[j], kind)[1].startswith(head) and one_apart(words[j], v) and (not kind or meets(v, words[j], kind)):
                        near.append((-ns[j], words[j]))
        if near:
            n, best = min(near)
            yield v, len(near), -n, best


_NEAR = "word string, n_near bigint, best_n bigint, best string"


def _by_automaton(ends: DataFrame, n_ends: int, shard: int) -> DataFrame:
    """``_NEAR`` from shards of about so many words."""
    shards = n_ends // shard + 1

    def scan(table: pa.Table) -> pa.Table:
        rows = list(scanned(*(table.column(c).to_pylist() for c in ("word", "n", "kind"))))
        return pa.table(dict(zip(("word", "n_near", "best_n", "best"), map(list, zip(*rows)))) if rows else {"word": [], "n_near": [], "best_n": [], "best": []}, schema=pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]))

    dealt = ends.withColumn("shard", F.pmod(F.xxhash64("kind", "end"), F.lit(shards)))
    # A number of its own, as words are few bytes and much work: they must not be put together to a few tasks.
    return dealt.select("shard", "word", "n", "kind").repartition(shards, "shard").groupBy("shard").applyInArrow(scan, _NEAR)


def _less_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, h``: hashes of each word, and of all that is left of it when one character is taken away."""
    for batch in batches:
        for i, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
            c = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            to = np.concatenate(([np.uint64(0)], np.cumsum(c * arrays.powers(len(c)))))
            left = to[:-1] + (to[-1] - to[1:]) * arrays.powers(2, down=True)[1]
            h = np.unique(arrays.mixed(np.append(left, to[-1]))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i)), pa.array(h)], ["id", "h"])


def _by_deletion(ends: DataFrame) -> DataFrame:
    """``_NEAR`` from words of ends that very many share. Hashes and ids meet; words are joined to the pairs that are left."""
    hot = ends.select("id", "word", "n").distinct()
    less = hot.select("id", "word").mapInArrow(_less_one, "id bigint, h bigint").join(ends.select("id", "kind", "end"), "id")
    other = less.select(F.col("id").alias("other"), "h", "kind", "end")
    pairs = less.join(other, ["h", "kind", "end"]).filter("id <> other").select("id", "other", "kind").distinct()
    pairs = pairs.join(hot.select("id", "word"), "id").join(hot.select(F.col("id").alias("other"), F.col("word").alias("best"), F.col("n").alias("best_n")), "other")

    @F.udf(T.BooleanType(), useArrow=True)
    def near(word: str, other: str, kind: int) -> bool:
        return one_apart(word, other) and meets(word, other, kind)

    return pairs.filter(near("word", "best", "kind")).select("word", F.lit(1).cast("bigint").alias("n_near"), "best_n", "best")


def near_words(words: DataFrame, shard: int = SHARD, hot: int = HOT, alike: int = ALIKE, most_ends: int = MOST_ENDS) -> DataFrame:
    """``word, n_near, best_n, best`` of the ``word, n`` that have near words: how many, and the most frequent (of those the smallest)."""
    components.ensure_checkpoint_dir(words)
    kept = words.select("word", "n", F.monotonically_increasing_id().alias("id")).checkpoint()
    ends = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.substring("word", 1, _END).alias("end")), F.struct(F.lit(1).alias("kind"), F.substring("word", -_END, _END).alias("end"))))
    ends = kept.select("id", "word", "n", ends.alias("e")).select("id", "word", "n", "e.kind", "e.end")
    half = F.floor(F.length("word") / 2).cast("int")
    segment = F.when(F.col("kind") == 0, F.substring("word", F.lit(1), half)).otherwise(F.substring("word", half + 1, F.length("word")))
    groups = ends.groupBy("kind", "end", F.length("word").alias("length"), segment.alias("segment")).agg(F.count(F.lit(1)).alias("size"))
    sizes = groups.groupBy("kind", "end").agg(F.sum("size").alias("size"), F.max("size").alias("most")).checkpoint()
    n_ends = sizes.agg(F.sum("size")).first()[0] or 0
    large = sizes.filter((F.col("size") > hot) | (F.col("most") > alike)).select("kind", "end")
    n_large = large.count()
    if not n_large:
        found = _by_automaton(ends, n_ends, shard)
    else:
        large = F.broadcast(large) if n_large <= most_ends else large
        found = _by_automaton(ends.join(large, ["kind", "end"], "left_anti"), n_ends, shard).unionByName(_by_deletion(ends.join(large, ["kind", "end"], "left_semi").checkpoint()))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: where following forms ends. Each round doubles the steps; a form is at least ``TIMES`` times as
    frequent as its word, so five rounds are enough for any counts. A form has no more words than it has near ones."""
    now = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).checkpoint()
        now = far.drop("moved")
        if far.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, shard: int = SHARD, hot: int = HOT, alike: int = ALIKE, most_ends: int = MOST_ENDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the ``vocabulary``.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, of which only A to Z are lower-cased; a run whose crc32 after its document's id divides
    by ``EVERY`` loses a character. A null text has no words, a null id counts as an empty one, repeated rows count as often as they are there, and
    other columns are not read. Ties are broken by the words' code points. Words of any length are compared, in time in proportion to it. A
    table without words gives none. What meets in one task is bounded by ``shard``, ``hot`` and ``alike``, which change no result.
    """
    components.ensure_checkpoint_dir(docs)
    words = vocabulary(docs).checkpoint()
    found = words.join(near_words(words, shard, hot, alike, most_ends), "word", "left")
    fits = F.coalesce(F.col("best_n") >= TIMES * F.col("n"), F.lit(False))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")).checkpoint()
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
