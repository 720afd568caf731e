"""Schemas of blocks, chunks and points, and the canonical projection of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.numbers import round_binary

BLOCK = "content string, page int, type string, source string, heading string, section_path string, bbox array<double>, page_width double, page_height double, image_path string"
CHUNK = BLOCK + ", parent_content string, parent_id string, chunk_index int, total_chunks int, strategy string, source_url string"
SPAN = "source string, page int, block int, line int, span int, text string, size double"

#: The keys of a search result, with the value of a missing one (fixed values).
CANONICAL: dict[str, tuple[str, object]] = {
    "content": ("string", ""),
    "source": ("string", "unknown"),
    "page": ("int", None),
    "type": ("string", "text"),
    "heading": ("string", ""),
    "section_path": ("string", ""),
    "image_path": ("string", ""),
    "parent_id": ("string", ""),
    "parent_content": ("string", ""),
    "chunk_index": ("int", None),
    "total_chunks": ("int", None),
    "score": ("double", 0.0),
    "bbox": ("array<double>", None),
    "page_width": ("double", None),
    "page_height": ("double", None),
    "source_url": ("string", ""),
}


def canonical(df: DataFrame, *keep: str) -> DataFrame:
    """``df`` as search results: all canonical keys, in order, after the columns to ``keep``.

    A null is taken as missing and gets the default; ``score`` is rounded to 4 places.
    """

    def value(name: str, kind: str, default: object) -> Column:
        have = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        out = have if default is None else F.coalesce(have, F.lit(default))
        return (round_binary(out, 4) if name == "score" else out).alias(name)

    return df.select(*keep, *(value(n, k, d) for n, (k, d) in CANONICAL.items() if n not in keep))
