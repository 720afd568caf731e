"""Text splitters: pure functions over one text, and their column form."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: where a recursive splitter may cut, best first; the empty one cuts between characters.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", ", ", " ", "")


def merged(pieces: Sequence[str], size: int, overlap: int, joiner: str = "") -> list[str]:
    """Pieces gathered to chunks of at most ``size``; a chunk begins with the last pieces of the one before, up to ``overlap``.

    A piece longer than ``size`` is a chunk of its own. Chunks are stripped, and empty ones dropped.
    """
    out: list[str] = []
    held: list[str] = []
    length = 0

    def more(n: int) -> int:
        return n + (len(joiner) if held else 0)

    def emit() -> None:
        text = joiner.join(held).strip()
        if text:
            out.append(text)

    for piece in pieces:
        if held and length + more(len(piece)) > size:
            emit()
            while held and (length > overlap or length + more(len(piece)) > size):
                length -= len(held.pop(0)) + (len(joiner) if held else 0)
        length += more(len(piece))
        held.append(piece)
    if held:
        emit()
    return out


def recursive(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Cut at the first separator that the text has (it stays at the start of what follows); pieces that are still too long are cut
    at the next ones, and short ones in between are merged."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    if separator:
        head, *rest = text.split(separator)
        pieces = [head, *(separator + r for r in rest)]
    else:
        pieces = list(text)
    out: list[str] = []
    short: list[str] = []
    for piece in filter(None, pieces):
        if len(piece) < size:
            short.append(piece)
            continue
        out += merged(short, size, overlap)
        short = []
        out += recursive(piece, size, overlap, finer) if finer else [piece]
    return out + merged(short, size, overlap)


def fixed(text: str, size: int, overlap: int) -> list[str]:
    """Lines merged to chunks; a longer line stays whole."""
    return merged(list(filter(None, text.split("\n"))), size, overlap, "\n")


def split_column(text: Column, how: str, size: int, overlap: int) -> Column:
    """``array<string>`` of a text's chunks, by ``recursive`` or ``fixed``; null has none."""
    split = {"recursive": recursive, "fixed": fixed}[how]

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split(t, size, overlap) if t else [])

    return chunks(text)
