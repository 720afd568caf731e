"""The retrieval plan: dense and lexical legs, fusion, diversity, rerank, parents, context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.models import generate, overlap
from lodestone.operators import context, dense, fusion, inverted, lexical
from lodestone.operators.stages import stored

Index = lexical.Index | inverted.InvertedIndex


@dataclass(frozen=True)
class Settings:
    """Sizes and thresholds of the plan."""

    top_k: int = 20
    rerank_k: int = 5
    rrf_k: int = 60
    weights: tuple[float, float] = (1.0, 1.0)
    like: float = 0.70
    least_score: float = 0.0

    @property
    def fetch(self) -> int:
        """Candidates of each leg."""
        return max(3 * self.top_k, 20)


def hybrid(chunks: DataFrame, queries: DataFrame, settings: Settings = Settings(), pin: Column | None = None, pin_scope: str = "both", index: Index | None = None) -> DataFrame:
    """Ranked chunks for a batch of queries; chunks of equal content are one, that of the smallest id.

    ``chunks``: ``id, content, vector`` and metadata; ``queries``: ``query_id, text, vector``; ids of any type that orders. ``pin`` filters the
    chunks of both legs, or, with ``pin_scope="dense"``, of the dense leg only. An ``index`` of the chunks spares making one (it can't serve a pin of
    both legs), and tells that they are a stored table, such as a store's, which is then read and not written again. Without one the chunks
    are stored first, as their vectors may have to be made.
    """
    chunks, queries = chunks if index is not None else stored(chunks), stored(queries)
    seen = chunks if pin is None else chunks.filter(pin)
    near = dense.top_k(seen, queries, settings.fetch, "id", "vector", "query_id")
    if index is None or not (pin is None or pin_scope == "dense"):
        index = lexical.build(chunks if pin_scope == "dense" else seen, "id", "content")
    search = index.search if isinstance(index, inverted.InvertedIndex) else partial(lexical.search, index)
    words = search(queries, settings.fetch, "id", "query_id")
    # What the legs found meets its content; a content that a leg found more than once counts by its best rank.
    content = chunks.join(near.select("id").unionByName(words.select("id")).distinct(), "id", "left_semi").select("id", F.xxhash64(F.coalesce("content", F.lit(""))).alias("said"), "vector")
    content = stored(content.withColumn("one", F.min("id").over(Window.partitionBy("said"))))
    legs = [fusion.renumbered(fusion.best_of(leg.join(content.select("id", "one"), "id").select("query_id", F.col("one").alias("id"), "rank"), "id")) for leg in (near, words)]
    fused = stored(fusion.above(fusion.rrf(*legs, "id", settings.rrf_k, settings.weights), "rrf_score", settings.least_score))
    thinned = fusion.diverse(fused.join(content.select("id", "vector"), "id"), "id", "vector", settings.top_k, settings.like)
    scored = thinned.join(fused.select("query_id", "id", F.col("rrf_score").alias("score")), ["query_id", "id"])
    return scored.join(chunks.drop("vector", "score"), "id")


def answer_passages(chunks: DataFrame, queries: DataFrame, settings: Settings = Settings(), index: Index | None = None) -> DataFrame:
    """``hybrid``, reranked, expanded to parents and reranked again: at most five passages a query."""
    found = hybrid(chunks, queries, settings, index=index).join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    first = fusion.rerank(found, overlap(F.col("question"), F.col("content")), settings.rerank_k)
    parents = fusion.expand_to_parents(first)
    again = parents.withColumn("score", F.col("retrieval_score"))
    return fusion.rerank(again, overlap(F.col("question"), F.col("content")), settings.rerank_k)


def offline(chunks: DataFrame, queries: DataFrame, reranker: bool = True, k: int = 5, settings: Settings = Settings(), index: Index | None = None) -> DataFrame:
    """What an answer without a generator shows: with a ``reranker`` the passages that ``answer_passages`` picks, else the first ``k`` chunks as retrieved."""
    if reranker:
        return answer_passages(chunks, queries, settings, index)
    return hybrid(chunks, queries, settings, index=index).filter(F.col("rank") <= k)


def prompts(passages: DataFrame, queries: DataFrame, limit: int = context.CONTEXT_LIMIT, general: Callable[[Column], Column] = lambda question: question) -> DataFrame:
    """``query_id, mode, prompt`` of every query, also of those without a passage; ``general`` makes theirs of the question."""
    packed = context.packed(context.within_limit(context.blocks(passages), limit))
    best = context.best_score(passages.withColumn("score", F.col("rerank_score")), queries)
    each = queries.select("query_id", "text").join(packed, "query_id", "left").join(best, "query_id", "left")
    mode = context.mode(F.col("context"), F.col("best"))
    return each.select("query_id", mode.alias("mode"), F.when(mode == "grounded", context.prompt(F.col("text"), F.col("context"))).otherwise(general(F.col("text"))).alias("prompt"))


def ask(chunks: DataFrame, queries: DataFrame, settings: Settings = Settings(), generator: str = "echo_stand_in", index: Index | None = None) -> DataFrame:
    """``query_id, mode, prompt, answer, citations`` (numbered, as text) of every query, by a registered generator.

    Questions that are blank or longer than ``context.QUESTION_LENGTH`` are left out, as the service refuses them.
    """
    asked = stored(context.valid_questions(queries))
    passages = stored(answer_passages(chunks, asked, settings, index))
    cited = context.citations(passages).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("number", "citation"))).alias("c"))
    said = prompts(passages, asked, general=context.general_prompt).withColumn("answer", generate(F.col("prompt"), generator)).join(cited, "query_id", "left")
    none = F.array().cast("array<string>")
    return said.select("query_id", "mode", "prompt", "answer", F.when(F.col("mode") == "grounded", F.coalesce(F.col("c.citation"), none)).otherwise(none).alias("citations"))
