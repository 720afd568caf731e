"""Content-derived keys. A missing value is written as the text None."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parent numbers: text parents count by section, atomic blocks from here on.
SECTION_STEP, ATOMIC_START = 1000, 100_000


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def parent_id(source: Column, page: Column, section: Column, index: Column) -> Column:
    """``par_`` and 12 hex digits of the md5 of source, page, section and number."""
    said = F.concat(_text(source), F.lit("|p"), _text(page), F.lit("|"), _text(section), F.lit("|"), _text(index))
    return F.concat(F.lit("par_"), F.substring(F.md5(said), 1, 12))


def content_hash(source: Column, page: Column, content: Column) -> Column:
    """The export key: md5 of source, page and the first 80 characters; two chunks may share it."""
    return F.md5(F.concat(_text(source), F.lit("|"), _text(page), F.lit("|"), F.substring(F.coalesce(content, F.lit("")), 1, 80)))


def chunk_id(source: Column, page: Column, parent: Column, index: Column, content: Column) -> Column:
    """An id that a repeated ingest gives again, from all of the chunk."""
    return F.sha2(F.concat_ws("\u0001", *map(_text, (source, page, parent, index, content))), 256)


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def sorted_hash(hashes: Column, separator: str) -> Column:
    """Aggregate: md5 of the group's values in order, joined. The values of one group are gathered, so pass short ones."""
    return F.md5(F.array_join(F.array_sort(F.collect_list(hashes)), separator))
