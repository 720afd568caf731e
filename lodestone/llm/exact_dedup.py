"""Exact dedup by recipes of content-defined chunks (list item 12), in DataFrame functions only.

A normalised text is cut where its own characters say so. Its recipe is the ordered list of its chunks' identifiers, 128-bit hashes that are
verified: all chunks of one identifier are one text. Documents are equal when their recipes are equal lists, and the 128-bit key of a list is
verified in the same way before it stands for the list. Where any of them stands for two things, all are made anew with another salt.

Texts are read twice and never moved whole. The first reading leaves a narrow table of recipes; a document whose key no other has is alone. The
second reading cuts the others again and shuffles their distinct chunks once, for the verification.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import components

#: A chunk's least and greatest number of characters.
LEAST, MOST = 384, 2048
#: Keys that every task may hold, 16 bytes each; more are not sent, and the chunks of all documents are verified.
MOST_KEYS = 1 << 17
#: Two longs, from a salt and a column.
Hash = Callable[[int, Column], Column]


def hashed(salt: int, value: Column) -> Column:
    return F.array(F.xxhash64(F.lit(2 * salt), value), F.xxhash64(F.lit(2 * salt + 1), value))


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    """A chunk ends, from ``least`` characters on, after three characters whose code points (below 256) leave 3 at division by 4, or after
    a full stop of Asian scripts; else at ``most``, or at the text's end."""
    chosen = "".join(f"\\x{c:02X}" for c in range(0x21, 0x100) if c % 4 == 3)
    return f"(?s).{{{least},{most - 3}}}?(?:[{chosen}]{{3}}|[。！？])|.{{1,{most}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def chunks(plain: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a normalised text, in order; an empty text has none."""
    return F.regexp_extract_all(plain, F.lit(chunk_pattern(least, most)), F.lit(0))


def _cut(docs: DataFrame, salt: int, hash_: Hash, least: int, most: int) -> DataFrame:
    """``docs`` with ``plain``, ``chunks``, ``recipe`` (two longs a chunk) and ``key`` (two longs)."""
    rows = docs.withColumn("plain", normalised(F.col("text"))).withColumn("chunks", chunks(F.col("plain"), least, most))
    rows = rows.withColumn("recipe", F.flatten(F.transform("chunks", lambda c: hash_(salt, c))))
    return rows.withColumn("key", hash_(salt, F.col("recipe")))


def _is_shared(pairs: DataFrame, name: str) -> bool:
    """Whether in ``pairs``, without repeats, one ``name`` stands for two things."""
    return not pairs.groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def recipes(docs: DataFrame, least: int = LEAST, most: int = MOST, hash_: Hash = hashed, most_keys: int = MOST_KEYS) -> DataFrame:
    """``doc_id, row, n_chars, sha256, recipe, key`` of every document, stored; ``row`` tells rows of one id apart.

    Equal keys are equal recipes, and equal recipes of two documents are equal texts.
    """
    components.ensure_checkpoint_dir(docs)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    for salt in count():
        cut = _cut(docs, salt, hash_, least, most)
        n_chars = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
        base = cut.select("doc_id", F.monotonically_increasing_id().alias("row"), n_chars.alias("n_chars"), F.unhex(F.sha2("plain", 256)).alias("sha256"), "recipe", "key").checkpoint()
        repeated = base.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key").checkpoint()
        if repeated.count() <= most_keys:
            cut, lists = (df.join(F.broadcast(repeated), "key", "left_semi") for df in (cut, base))
        else:
            lists = base
        named = cut.select(F.explode("chunks").alias("chunk")).select(hash_(salt, F.col("chunk")).alias("id"), "chunk").distinct()
        if not _is_shared(named, "id") and not _is_shared(lists.select("key", "recipe").distinct(), "key"):
            return base


def groups(docs: DataFrame, least: int = LEAST, most: int = MOST, hash_: Hash = hashed, most_keys: int = MOST_KEYS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    Texts are equal when they are after white space (``[\\x20\\x09-\\x0D]``) is deleted; null is empty, and empty texts are equal. Of a group, the row
    of most characters stays, then the smallest id (known ids before null), then one of the rows that agree in both: exactly one row
    of each group is kept, and ``keep_id`` is its id. Other columns are not read. A text of any length is cut where it is read. Groups
    are counted before they are shuffled, and the largest are broadcast, so copies of one text never meet in one task.
    """
    base = recipes(docs, least, most, hash_, most_keys)
    # A smaller number has the larger complement, without overflow.
    rank = F.struct("n_chars", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row"))
    best = base.groupBy("key").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("copies")).checkpoint()
    classes = best.select("key", F.bitwise_not("best.id").alias("keep_id"), F.bitwise_not("best.row").alias("keep_row"), F.col("copies").alias("group_size"), "copies")
    found = components.of_class(base.select("key", "doc_id", "row", "sha256"), classes, "key")
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of equal texts, by ``groups``; ids must differ."""
    return docs.join(groups(docs).filter("kept").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
