"""Models as pluggable vectorised functions, with deterministic stand-ins that need no weights.

The stand-ins are named so: a hashed bag of tokens embeds, token overlap reranks, an echo answers. A real model is
registered by name as a function that loads it (once in each worker) and returns a function of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import batches
from lodestone.functions.text import QUERY_PREFIX, tokenize

Embed = Callable[[list[str]], np.ndarray]
_EMBEDDERS: dict[str, tuple[Callable[[], Embed], int]] = {}
_GENERATORS: dict[str, Callable[[], Callable[[list[str]], list[str]]]] = {}


def register_embedder(name: str, load: Callable[[], Embed], batch: int = 64) -> None:
    _EMBEDDERS[name] = (load, batch)


def register_generator(name: str, load: Callable[[], Callable[[list[str]], list[str]]]) -> None:
    _GENERATORS[name] = load


def hashed_embedder(dimension: int = 64) -> Callable[[], Embed]:
    """Stand-in: each token adds 1 or -1 at a place that its hash tells."""

    def load() -> Embed:
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension), np.float32)
            for i, text in enumerate(texts):
                for token in text.lower().split():
                    h = crc32(token.encode())
                    out[i, h % dimension] += 1 if h >> 31 else -1
            return out

        return embed

    return load


register_embedder("hashed_stand_in", hashed_embedder())
register_generator("echo_stand_in", lambda: lambda prompts: [p[-200:] for p in prompts])


def embed(text: Column, name: str = "hashed_stand_in", query: bool = False) -> Column:
    """``array<float>`` of length 1; a query gets its prefix first. A text that embeds to nothing stays zero."""
    if name not in _EMBEDDERS:
        raise LookupError(f"no embedder {name!r}; there are {', '.join(sorted(_EMBEDDERS))}")
    load, size = _EMBEDDERS[name]
    prefix = QUERY_PREFIX if query else ""
    batches.bounded(SparkSession.active())

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            texts = [prefix + (t or "").strip() for t in part]
            rows = [model(texts[i : i + size]) for i in range(0, len(texts), size)]
            m = np.concatenate(rows) if rows else np.zeros((0, 1), np.float32)
            length = np.linalg.norm(m, axis=1, keepdims=True)
            yield pd.Series(list(np.divide(m, length, out=np.zeros_like(m), where=length > 0)), dtype=object)
        batches.give_back()

    return run(text)


def overlap(query: Column, passage: Column) -> Column:
    """Stand-in for a cross-encoder: the share of the query's tokens that the passage has."""
    q, p = F.array_distinct(tokenize(query)), tokenize(passage)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, p)) / F.size(q)).otherwise(0.0)


def generate(prompt: Column, name: str = "echo_stand_in") -> Column:
    """An answer for each prompt, by a registered generator."""
    if name not in _GENERATORS:
        raise LookupError(f"no generator {name!r}; there are {', '.join(sorted(_GENERATORS))}")
    load = _GENERATORS[name]
    batches.bounded(SparkSession.active())

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            yield pd.Series(model([p or "" for p in part]), dtype=object)
        batches.give_back()

    return run(prompt)
