"""From ranked passages to a prompt: context under a limit, citations, gate and answer cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import or_else, strip

CONTEXT_LIMIT = 6000
LEAST_CONFIDENCE = 0.1
QUESTION_LENGTH, SESSION_LENGTH = 2000, 64


def header() -> Column:
    """``[Source: … | Page: … | Section: …]``, without parts that are missing."""
    section = or_else(F.col("section_path"), F.nullif(F.col("heading"), F.lit("")))
    return F.concat(F.lit("[Source: "), F.coalesce("source", F.lit("unknown")), F.coalesce(F.concat(F.lit(" | Page: "), F.col("page").cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(" | Section: "), section), F.lit("")), F.lit("]"))


def blocks(ranked: DataFrame) -> DataFrame:
    """``query_id, rank, block``: each passage under its header."""
    return ranked.select("query_id", "rank", F.concat(header(), F.lit("\n"), F.col("content")).alias("block"))


def within_limit(ranked: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """Rows of ``query_id, rank, block`` before the first one that would make the blocks longer than ``limit``; separators are free."""
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("_total", F.sum(F.length("block")).over(so_far)).filter(F.col("_total") <= limit).drop("_total")


def packed(ranked: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """``query_id, context``: the blocks in order."""
    each = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(each, lambda x: x["block"]), separator).alias("context"))


def citation_key() -> Column:
    return or_else(F.col("parent_id"), F.concat(F.coalesce("source", F.lit("None")), F.lit("|"), F.coalesce(F.col("page").cast("string"), F.lit("None"))))


def citations(ranked: DataFrame, by: Column | None = None) -> DataFrame:
    """The best passage of each parent (else of each source and page), numbered in order, with its written form."""
    key = citation_key() if by is None else by
    first = ranked.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_key").orderBy("rank"))).filter("_n = 1")
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("bigint")
    out = first.withColumn("number", number).drop("_n", "_key")
    said = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("source"), F.coalesce(F.concat(F.lit(", p. "), F.col("page").cast("string")), F.lit("")))
    return out.select("query_id", "number", "rank", "source", "page", "parent_id", said.alias("citation"))


def best_score(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, best``: the first passage's score, 0 for a query without passages."""
    top = ranked.filter("rank = 1").select("query_id", F.coalesce("score", F.lit(0.0)).alias("best"))
    return queries.select("query_id").join(top, "query_id", "left").select("query_id", F.coalesce("best", F.lit(0.0)).alias("best"))


def mode(context: Column, best: Column, least: float = LEAST_CONFIDENCE) -> Column:
    """``grounded``, or ``general`` where there is no context or no confidence in it."""
    blank = strip(F.coalesce(context, F.lit(""))) == ""
    return F.when(blank | (F.coalesce(best, F.lit(0.0)) < least), "general").otherwise("grounded")


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer from the context alone.\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question)


def general_prompt(question: Column) -> Column:
    """The prompt where no passage answers."""
    return F.concat(F.lit("No passage of the collection answers this. Answer from general knowledge, and say that you do.\n\nQuestion: "), question)


def valid_questions(queries: DataFrame, longest: int = QUESTION_LENGTH) -> DataFrame:
    """``queries`` (``query_id, text``) whose text has 1 to ``longest`` characters besides white space around it, and whose ``session_id``, where
    there is one, at most ``SESSION_LENGTH``."""
    fits = F.length(strip(F.col("text"))).between(1, longest)
    if "session_id" in queries.columns:
        fits &= F.coalesce(F.length("session_id"), F.lit(0)) <= SESSION_LENGTH
    return queries.filter(fits)


def cards(ranked: DataFrame) -> DataFrame:
    """Passages as the offline answer shows them: ten fields, under their query and rank."""
    text = or_else(F.col("parent_content"), F.col("content"))
    return ranked.select("query_id", "rank", "source", "page", "heading", "section_path", text.alias("content"), F.col("score"), F.col("type").alias("chunk_type"), "bbox", "page_width", "page_height")
