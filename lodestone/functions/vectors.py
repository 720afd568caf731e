"""Vector functions as column expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.numbers import round_binary


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def normalised(a: Column) -> Column:
    """Scaled to length 1; a vector without length stays."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: (x / size).cast("float"))).otherwise(a)


def highlight_box(bbox: Column, width: Column, height: Column) -> Column:
    """A box in points (top-left origin) as shares of the page."""
    return F.array(*(F.round(bbox[i] / (width if i % 2 == 0 else height), 4) for i in range(4)))


def rounded_box(bbox: Column) -> Column:
    """A box of four numbers to two places; what has not four is null."""
    return F.when(F.size(bbox) == 4, F.transform(bbox, lambda v: round_binary(v.cast("double"), 2)))


def box_text(bbox: Column) -> Column:
    """A box as JSON, as payloads keep it; null stays."""
    return F.to_json(bbox)


def box(text: Column) -> Column:
    """A box from JSON; what is none is null."""
    return F.from_json(text, "array<double>")
