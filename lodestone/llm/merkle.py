"""Document fingerprints by a Merkle tree over paragraphs and sections (list item 2).

Paragraphs are the text between newlines (the newline belongs to the one it ends); a section is a run of paragraphs that ends
with one whose digest is divisible by ``SECTION`` (or with the text), so that an edit moves no section boundary beyond its own. Below a paragraph,
leaves are runs of words that end with a sentence or with a word whose hash is less than those of the ``REACH`` words on either side: they tell how much of a changed paragraph is
still the same. Words of over ``LONG_WORD`` bytes (scripts without spaces) are cut within, where the bytes before a character have a hash
divisible by ``INNER``. All bytes of the text, white space too, lie in exactly one leaf.

A fingerprint is ``root/section;section;...``, a section ``digest:paragraph,paragraph,...``, a paragraph its digest and its
leaves (8 hex digits of digest, 4 of length in bytes each). Equal texts have equal fingerprints. Where two roots differ,
sections with equal digests are skipped, then paragraphs, so a comparison descends differing branches only.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import arrays
from lodestone.llm.windows import LAST

SECTION = 4
REACH = 2
LONG_WORD, INNER, LEAST_INNER = 48, 16, 24
LONGEST_LEAF = 0xFFFF
#: Ranges of documents at most: the driver samples some 32 keys for each, and every task holds the key that each starts at.
MOST_RANGES = 1 << 16
_BRANCHES = pa.list_(pa.struct([("section", pa.int32()), ("paragraph", pa.int32())]))
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True


@dataclass(frozen=True)
class Tree:
    """``sections``: digest and paragraphs of each; a paragraph: digest and leaves of 12 hex digits."""

    root: str
    sections: tuple[tuple[str, tuple[tuple[str, str], ...]], ...]

    def __str__(self) -> str:
        return self.root + "/" + ";".join(d + ":" + ",".join(p + leaves for p, leaves in paragraphs) for d, paragraphs in self.sections)


def parse(fingerprint: str) -> Tree:
    """The tree that a fingerprint writes out."""
    root, _, rest = fingerprint.partition("/")
    parts = [s.partition(":") for s in rest.split(";")] if rest else []
    return Tree(root, tuple((d, tuple((p[:8], p[8:]) for p in ps.split(","))) for d, _, ps in parts))


def _digest(data: bytes, size: int = 4) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


def _least(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which words have a lesser hash than those before and none greater than those after, ``REACH`` either way, in their row."""
    out = np.ones(len(hashes), bool)
    for k in range(1, REACH + 1):
        apart = row[k:] != row[:-k]
        out[k:] &= (hashes[k:] < hashes[:-k]) | apart
        out[:-k] &= (hashes[:-k] <= hashes[k:]) | apart
    return out


def _inner_cuts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where long words are cut: before a character whose eight bytes ahead say so, ``LEAST_INNER`` bytes from the last cut at least."""
    long = end - start > LONG_WORD
    out = []
    for a, b in zip(start[long].tolist(), end[long].tolist()):
        for c in range(a + 8, b, arrays.PASS_BYTES):
            d = min(c + arrays.PASS_BYTES, b)
            ahead = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data[c - 8 : d - 1], 8)).view(np.uint64).reshape(-1)
            for p in (c + np.flatnonzero((arrays.mixed(ahead) % np.uint64(INNER) == 0) & ((data[c:d] & 0xC0) != 0x80))).tolist():
                if p - (out[-1] if out and out[-1] > a else a) >= LEAST_INNER:
                    out.append(p)
    return np.array(out, np.int64)


def trees(texts: list[bytes]) -> list[Tree]:
    """A tree for each UTF-8 text."""
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    start, end, first = arrays.words(data, offsets)
    closes = _least(arrays.span_hashes(data, start, end), np.repeat(np.arange(len(texts)), np.diff(first))) | _STOPS[data[end - 1]]
    closes[first[1:][np.diff(first) > 0] - 1] = False
    newline = np.flatnonzero(data == 0x0A) + 1
    # A leaf starts at a row's start, after a newline, after a closing word, within long words, and after LONGEST_LEAF bytes without any.
    cuts = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], newline[newline < len(data)], end[closes][end[closes] < len(data)], _inner_cuts(data, start, end))))
    sizes = np.diff(np.append(cuts, len(data)))
    if len(sizes) and sizes.max() > LONGEST_LEAF:
        cuts = np.concatenate([np.arange(a, a + n, LONGEST_LEAF) for a, n in zip(cuts, sizes)])
        sizes = np.diff(np.append(cuts, len(data)))
    digests = (arrays.span_hashes(data, cuts, cuts + sizes) >> np.uint64(32)).astype(">u4")
    leaf = np.empty((len(cuts), 6), np.uint8)
    leaf[:, :4] = digests.view(np.uint8).reshape(-1, 4)
    leaf[:, 4:] = sizes.astype(">u2").view(np.uint8).reshape(-1, 2)
    written = leaf.tobytes().hex()
    line_at = np.union1d(offsets[:-1][np.diff(offsets) > 0], newline[newline < len(data)])
    line_leaf = np.searchsorted(cuts, np.append(line_at, len(data))) * 12
    row_line = np.searchsorted(line_at, offsets).tolist()
    line_at, line_leaf, flat = np.append(line_at, len(data)).tolist(), line_leaf.tolist(), data.tobytes()
    out = []
    for row in range(len(texts)):
        sections, paragraphs = [], []
        last = row_line[row + 1] - 1
        for i in range(row_line[row], row_line[row + 1]):
            d = _digest(flat[line_at[i] : line_at[i + 1]], 8)
            paragraphs.append((d[:8], written[line_leaf[i] : line_leaf[i + 1]], d))
            if i == last or int(d[8:], 16) % SECTION == 0:
                full = _digest("".join(p[2] for p in paragraphs).encode(), 16)
                sections.append((full, tuple(p[:2] for p in paragraphs)))
                paragraphs = []
        root = _digest("".join(s[0] for s in sections).encode(), 16)
        out.append(Tree(root, tuple((s[0][:8], s[1]) for s in sections)))
    return out


def _differing(a, b):
    """Children of either side without an equal one (digest, what is below) on the other, and the bytes of those that have one."""
    left, right = Counter(a), Counter(b)
    return (left - right).elements(), (right - left).elements(), left & right


def _leaf_bytes(leaves: str) -> int:
    return sum(int(leaves[i + 8 : i + 12], 16) for i in range(0, len(leaves), 12))


def likeness(a: Tree, b: Tree) -> float:
    """Share of the bytes of both texts that lie in equal branches: 1 for equal roots, 0 where no leaf is shared."""
    if a.root == b.root:
        return 1.0
    left, right, same = _differing(a.sections, b.sections)
    total = 2 * sum(_leaf_bytes(leaves) * n for (_, ps), n in same.items() for _, leaves in ps)
    shared = total
    left, right, same = _differing((p for s in left for p in s[1]), (p for s in right for p in s[1]))
    agreed = 2 * sum(_leaf_bytes(leaves) * n for (_, leaves), n in same.items())
    total, shared = total + agreed, shared + agreed
    cut = lambda ps: Counter(leaves[i : i + 12] for _, leaves in ps for i in range(0, len(leaves), 12))
    left, right = cut(left), cut(right)
    weigh = lambda c: sum(int(x[8:], 16) * n for x, n in c.items())
    total += weigh(left) + weigh(right)
    return (shared + 2 * weigh(left & right)) / total if total else 0.0


def edits(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) of ``a`` whose branch has no equal one in ``b``: where ``a`` was edited."""
    if a.root == b.root:
        return []
    sections, paragraphs = Counter(b.sections), Counter(p for s in b.sections for p in s[1])
    out = []
    for i, s in enumerate(a.sections):
        if sections[s] > 0:
            sections[s] -= 1
            continue
        for j, p in enumerate(s[1]):
            if paragraphs[p] > 0:
                paragraphs[p] -= 1
            else:
                out.append((i, j))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint``. Null or empty text has the tree without branches; other columns pass, a clashing one is replaced."""

    @F.pandas_udf("string")
    def written(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([str(t) for t in trees([(x or "").encode() for x in part])], dtype=object)

    return docs.withColumn("fingerprint", written(F.col("text").cast("string")))


@arrays.tidy
def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered within each bucket and end with a guest, the document after the bucket's last one."""
    held = None
    for batch, _, _ in arrays.passes(batches, "text", 2 << 20):
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))))
        rows = [(b, g, i, t or "") for b, g, i, t in rows]
        own = trees([r[3].encode() for r in rows])
        pairs = []
        for row in zip(rows, own):
            if held and held[0][0] == row[0][0] and not held[0][1]:
                pairs.append((held, row))
            held = row
        edited = []
        for ((_, _, _, text), _), ((_, _, _, after), _) in pairs:
            half = len(text) // 2
            edited.append((text[: len(text) - half] + after[:half]).encode())
        new = trees(edited)
        out = [
            {"doc_id": a[0][2], "n_chars": len(a[0][3]), "edited_sha256": hashlib.sha256(e).hexdigest(), "fingerprint": str(a[1]), "edited_fingerprint": str(t), "near_edited": likeness(a[1], t), "near_next": likeness(a[1], b[1]), "edited_branches": [{"section": i, "paragraph": j} for i, j in edits(t, a[1])]}
            for (a, b), e, t in zip(pairs, edited, new)
        ]
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edited_branches", _BRANCHES)]))


def _bounds(docs: DataFrame, rows: int, parts: int, each: int = 32) -> tuple[tuple[int, int] | None, list[tuple[int, int]]]:
    """The first document's key, and keys of documents at which ranges of about equal numbers start.

    Like the ranges of a sort, they come from a sample: about ``each`` keys a partition, picked by their hash.
    """
    key = F.struct("rank", "tie")
    first = docs.agg(F.min(key).alias("k")).select("k.*").first()
    some = docs.filter(F.pmod(F.xxhash64("rank", "tie"), F.lit(max(1, rows // (each * parts)))) == 0).select("rank", "tie").distinct().toArrow()
    keys = sorted(zip(some.column("rank").to_pylist(), some.column("tie").to_pylist()))
    first = tuple(first) if first and first[0] is not None else None
    return first, sorted({k for k in keys[:: max(1, -(-len(keys) // parts))] if k != first})


def compare_with_next(docs: DataFrame, bytes_each: int = 12 << 20) -> DataFrame:
    """Fingerprints each document and its edited text (its last half replaced from the next document) and compares them.

    One row per input row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_branches`` (sections and
    paragraphs of the edited text that the document's tree does not have: where the edit is). Documents
    follow each other by ``doc_id``, null last, rows of one id by a hash of their text; the last is followed by the first, a
    single one by itself. Null text is empty; an empty text is edited to an empty one. Columns besides ``doc_id`` and
    ``text`` are ignored. An empty table gives an empty result.

    Documents are dealt to ranges of (``doc_id``, hash) in one shuffle; the first document of each range also goes to the range before, so each
    range can be walked in order alone. As ranges start at keys of documents, it is known by its key. There are at most ``MOST_RANGES``, whatever the input: a larger one
    has larger ranges, which are sorted with spills and walked as a stream.
    """
    arrays.session_limits(docs)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumns({"rank": F.coalesce("doc_id", F.lit(int(LAST))), "tie": F.coalesce(F.xxhash64("text"), F.lit(0))})
    rows, total = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = min(MOST_RANGES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((total or 0) // bytes_each) + 1))
    dealt = docs.withColumn("place", F.explode(_places(*_bounds(docs, rows, parts))("rank", "tie")))
    dealt = dealt.select("doc_id", "text", "rank", "tie", F.shiftright("place", 1).alias("bucket"), (F.col("place") % 2 == 1).alias("guest"))
    ordered = dealt.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "guest", "rank", "tie")
    return ordered.select("bucket", "guest", "doc_id", "text").mapInArrow(_with_next, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_branches array<struct<section:int,paragraph:int>>")


def _places(first: tuple[int, int] | None, bounds: list[tuple[int, int]]):
    """Of each key its range, doubled, and, one more than double, that in which its document is the guest."""
    guests = {k: i for i, k in enumerate(bounds)} | {first: len(bounds)}

    @F.pandas_udf("array<int>")
    def places(rank: pd.Series, tie: pd.Series) -> pd.Series:
        keys = list(zip(rank.tolist(), tie.tolist()))
        return pd.Series([[2 * bisect.bisect_right(bounds, k), 2 * guests[k] + 1] if k in guests else [2 * bisect.bisect_right(bounds, k)] for k in keys])

    return places
